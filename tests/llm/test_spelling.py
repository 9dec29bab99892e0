"""Words one edit apart by pairs of trie nodes, against comparing all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from hpcstats.llm.spelling import ORACLE, count_words, node_pairs, number_nodes, query, spelling_forms
from llm_helpers import SF, docs, empty, fold, odd


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_forms(counts, factor=5):
    """{word: (form, root, n, n_near, form_n)}"""
    around = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)] for w in counts}
    form = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, len(around[w]), counts.get(form[w])) for w, n in counts.items()}


def brute_counts(rows, chars=6, least=5):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= chars and n >= least}


def results(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


@pytest.mark.parametrize("letters", ["ab", "abcdefghéÿ"])
def test_forms_equal_all_pairs(spark, letters):
    """Rows of equal letters, ties of n, ways over several forms."""
    rng = random.Random(len(letters))
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 5, 5, 10, 25, 30, 150, 800]) for _ in range(350)}
    got, expected = results(spelling_forms(table(spark, counts))), brute_forms(counts)
    assert got == expected
    assert any(e[0] and e[0] != e[1] for e in expected.values())


def test_nodes_are_numbered_once(spark):
    """Equal prefixes have one number over all ranges; a word's place is its rank."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(1, 14))) for _ in range(400)})
    frame = number_nodes(table(spark, dict.fromkeys(words, 1)), "word", "ahead", "t")
    number, of = {}, {}
    for r in frame.collect():
        assert words[r["rank"]] == r["word"] and len(r["ahead"]) == len(r["word"]) + 1
        for i, x in enumerate(r["ahead"]):
            assert number.setdefault(r["word"][:i], x) == x and of.setdefault(x, r["word"][:i]) == r["word"][:i]


def test_counting_equals_plain_counting(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, i]), " ".join(rng.choice(["Spelling", "spellINg", "Änderung", "änderung", "x×y÷zzzz", "short", "dictionary"])
                                             + rng.choice([".", "", " 5", "中"]) for _ in range(60))) for i in range(60)] + [(1, None), (2, "")]
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = brute_counts(rows)
    assert got == expected and len(expected) > 5


def test_a_run_is_damaged_once(spark):
    """A run that becomes another run of its text, which is damaged too, loses one code point, not two."""
    hit = lambda i, size: zlib.crc32(f"{i}:{'a' * size}".encode()) % 199 == 0
    rows = []
    for size in range(7, 15):
        i = next(i for i in range(1_000_000) if hit(i, size) and hit(i, size - 1))
        long, short = "a" * size, "a" * (size - 1)
        rows += [(i, f"{long} {short} {short.upper()} " * 5), (i, f"{short} {long} " * 5)]
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_counts(rows)


def test_query_and_its_sql_on_the_shared_table(spark):
    import duckdb
    expected = brute_forms(brute_counts([(r["doc_id"], r["text"]) for r in docs(spark).collect()]))
    assert results(query(spark, SF)) == expected
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert {w: (form, root, n, many, form_n) for w, form, root, n, many, form_n in con.execute(ORACLE).fetchall()} == expected


def test_empty_odd_and_very_long(spark):
    assert spelling_forms(count_words(empty(spark))).count() == 0
    assert count_words(odd(spark)).count() == 0
    wide = spark.createDataFrame([(1, "wordings " * 5, 7, "x")], "doc_id long, text string, word long, n string")
    assert results(spelling_forms(count_words(wide))) == {"wordings": (None, "wordings", 5, 0, None)}
    long = "ab" * 20_000
    counts = {long: 100, long + "b": 10, long[:-1]: 1, "c" + long: 30}
    assert results(spelling_forms(table(spark, counts))) == {
        long: (None, long, 100, 3, None), long + "b": (long, long, 10, 1, 100), long[:-1]: (long, long, 1, 1, 100), "c" + long: (None, "c" + long, 30, 1, None)}
    with pytest.raises(ValueError):
        spelling_forms(table(spark, counts), factor=1)


def test_a_pair_joins_few_words(spark):
    """However many words there are, a pair of nodes is shared by one cut word and a word per letter at most."""
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(6)): 5 for _ in range(3000)}
    ahead = number_nodes(table(spark, counts), "word", "ahead", "t").withColumnRenamed("rank", "id")
    sizes = node_pairs(ahead).groupBy("p", "s").count().agg({"count": "max"}).first()[0]
    assert sizes <= 4
