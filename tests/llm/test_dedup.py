"""Exact dedup, phrase dedup and the chosen-path join against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from hpcstats.llm import chosen_path, components, phrase_dedup, run_merge
from llm_helpers import ODD_ROWS, WORD, docs, empty, fold, odd


# exact dedup

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t or "")].append(i)
    return sorted(((i, max((x for x in groups[fold(t or "")] if x is not None), default=None), len(groups[fold(t or "")]),
                    hashlib.sha256(fold(t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_groups_match_brute_force(spark, fan_in):
    table = docs(spark).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text")).repartition(9)
    rows = [tuple(r) for r in table.collect()]
    found = run_merge.exact_groups(table, fan_in=fan_in).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == exact_brute(rows)
    kept = defaultdict(int)
    for r in found:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_keep_smallest_and_filter(spark):
    smallest = run_merge.exact_groups(odd(spark), keep="smallest").where("text_sha256 = sha2('zz  q', 256)").collect()
    assert {r.keep_id for r in smallest} == {5}
    left = run_merge.exact_dedup(odd(spark)).collect()
    assert len(left) == len({fold(t or "") for _, t, *_ in ODD_ROWS})
    assert run_merge.exact_dedup(odd(spark)).columns == odd(spark).columns
    assert run_merge.exact_dedup(empty(spark)).count() == 0
    assert run_merge.exact_groups(empty(spark)).count() == 0


def test_a_hot_text_has_no_hot_join_key(spark):
    table = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Hot', concat('t', id)) as text").repartition(32)
    levels = run_merge.merge_runs(run_merge.digest_runs(table))
    entries = levels[0].groupBy("run", "digest").count()
    assert entries.where("count > 1").count() == 0 and len(levels) > 1
    assert run_merge.exact_groups(table).where("group_size = 1334 and keep_id = 3999").count() == 1334


# phrase dedup

def repeats_brute(rows, n=50):
    lowest = phrase_dedup.NO_ID
    coded = [(lowest if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in coded:
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in coded:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < i:
                gone[p:p + n] = b"\1" * n
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((None if i == lowest else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_phrase_dedup_matches_brute_force(spark, hot):
    rnd = random.Random(hot)
    base = ["".join(rnd.choice("ab cé") for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(120):
        t = "".join(rnd.choice([rnd.choice(base)[rnd.randint(0, 9):], "x" * rnd.randint(0, 90),
                                "".join(rnd.choice("pqrs ") for _ in range(rnd.randint(0, 80)))]) for _ in range(rnd.randint(0, 7)))
        rows.append((rnd.choice([i, i, i, 5, None, 2 ** 60 + i]), rnd.choice([t, t, t, t, None, ""])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = phrase_dedup.removed_repeats(table, block_bytes=2000, hot=hot).collect()
    assert sorted(map(tuple, found), key=str) == repeats_brute(rows)


def test_phrase_dedup_on_the_table_and_edge_cases(spark):
    table = docs(spark).select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(tuple, phrase_dedup.removed_repeats(table).collect()), key=str) == repeats_brute(rows)
    assert phrase_dedup.removed_repeats(empty(spark)).count() == 0
    assert phrase_dedup.removed_repeats(odd(spark)).count() == len(ODD_ROWS)
    text = phrase_dedup.removed_repeats(spark.createDataFrame([(1, "q" * 60), (2, "ab" + "q" * 60)], "doc_id long, text string"), texts=True)
    assert {r.doc_id: r.kept_text for r in text.collect()} == {1: "q" * 60, 2: "ab"}


def test_long_text_is_parsed_in_chunks():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 101, 5000, dtype=np.uint8)
    ends = np.array([10, 10, 2000, 5000])
    whole = phrase_dedup.phrases(data, ends)
    strings = lambda p: [(s + k, t) for s, n, t in zip(*p) for k in range(n)]
    assert strings(whole) == strings(phrase_dedup.phrases(data, ends, chunk=64))
    assert [s for s, _ in strings(whole)] == [p for p in range(4951) if p + 50 <= 2000 and p >= 10 or p >= 2000]


# chosen-path join

def shingle_set(text):
    w = WORD.findall(fold(text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_brute(rows, threshold=0.8):
    sets, where = [shingle_set(t) for _, t in rows], defaultdict(list)
    links, parent = defaultdict(set), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in where[g]:
                shared[j] += 1
            where[g].append(i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i].add(j)
                links[j].add(i)
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    name = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return sorted(((rows[i][0], name[root(i)], len(links[i]), len(members[root(i)])) for i in range(len(rows))), key=str)


def test_near_duplicates_match_brute_force(spark):
    table = docs(spark, "/root/testdata/sf0.01").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(tuple, chosen_path.near_duplicates(table).collect()), key=str) == near_brute(rows)


def test_dense_groups_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rnd = random.Random(3)
    base = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(120)]
    rows = []
    for i in range(330):  # one large group of near copies, each with changes of its own
        words = list(base)
        for _ in range(rnd.randint(1, 3)):
            words[rnd.randrange(len(words))] = f"c{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rnd.randint(0, 10 ** 6)}" for _ in range(60)) + " " + " ".join(base[:12])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, chosen_path.near_duplicates(table).collect()), key=str) == near_brute(rows)


def test_near_dedup_keeps_one_of_each_class(spark):
    left = chosen_path.near_dedup(odd(spark))
    assert left.columns == odd(spark).columns
    # different texts of one id both stay, of copies of which some have no id one does
    assert sorted((r.doc_id, fold(r.text or "")) for r in left.collect()) == [
        (1, "a b c d e f g"), (1, "other text"), (2, ""), (3, ""), (5, "zz  q"), (6, "n")]
    copies = spark.createDataFrame([(None, "one two three four five six")] * 3 + [(None, "quite another text, that has no copy at all")], "doc_id long, text string")
    assert sorted(r.text[:3] for r in chosen_path.near_dedup(copies).collect()) == ["one", "qui"]
    assert chosen_path.near_dedup(empty(spark)).count() == 0
    assert chosen_path.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 200)] + [(rnd.randint(300, 600), rnd.randint(300, 600)) for _ in range(150)] + [(7, 7)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert found == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_recall_of_the_runs():
    assert chosen_path.runs_for(0.999) >= 19
    assert chosen_path.runs_for(0.9) < chosen_path.runs_for(0.999)
