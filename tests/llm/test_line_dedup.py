"""Line dedup by sharded cuckoo filters against brute force; insertions and deletions undo each other."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hpcstats.llm.cuckoo import Cuckoo
from hpcstats.llm.line_dedup import LineIndex, line_dedup, query
from hpcstats.llm.shared import scratch_path
from llm_helpers import SF, docs, empty, fold, odd

SPACE = " \t\n\v\f\r"


def brute(rows, least=3, chars=20):
    """{(doc_id, text): (n_lines, n_dropped, kept text)} for rows with different non-NULL ids."""
    holders = defaultdict(set)
    key = lambda line: fold(line.strip(SPACE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def cleaned(frame):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"])
            for r in frame.select("row.doc_id", "n_lines", "n_dropped", "text").collect()}


def state(index):
    """Counts and what the filters say of every key, in a form that does not depend on how they came about."""
    return sorted((bytes(r["key"]), r["n"]) for r in index.counts().collect())


def made(rng, ids, pool):
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line of document {i} number {j}" for j in range(rng.randint(0, 8))))
            for i in ids]


POOL = [f"  A line That many documents share, number {k}{' ' * (k % 3)}" for k in range(25)] + ["short", "", "\t \r", "ÄÖ" * 12]


def test_cuckoo_filter_has_what_it_holds():
    rng = random.Random(3)
    keys = [rng.randbytes(16) for _ in range(30_000)]
    filt = Cuckoo.built(keys[:20_000])
    assert filt.has(keys[:20_000]).all() and filt.has(keys[20_000:]).mean() < 0.001
    filt.delete(keys[:15_000])
    assert filt.items() == 5_000 and filt.has(keys[15_000:20_000]).all() and filt.has(keys[:15_000]).mean() < 0.001
    again = Cuckoo.from_bytes(filt.to_bytes())
    assert again.insert(keys[20_000:]) and again.has(keys[15_000:]).all()
    with pytest.raises(ValueError):
        Cuckoo.built(keys[:10]).delete(keys[500:501])
    assert not Cuckoo.sized(10).insert(keys[:100])


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = made(rng, range(200), POOL)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert cleaned(line_dedup(frame)) == brute(rows)


def test_query_on_the_shared_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()]
    expected = brute(rows)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in query(spark, SF).collect()}
    assert got == {i: e[:2] for i, e in expected.items()} and sum(e[1] for e in expected.values()) > 0


@pytest.mark.parametrize("shard_keys", [2, 32_768])
def test_deletion_undoes_insertion(spark, shard_keys):
    """Small shards: filters are built anew when they fill up, and all of them when there are too few."""
    rng = random.Random(2)
    first, second = made(rng, range(0, 80), POOL), made(rng, range(80, 200), POOL)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    options = dict(shard_keys=shard_keys, shard_refs=50)
    only = LineIndex(spark, scratch_path(spark, "t"), **options).insert(frame(first))
    path = scratch_path(spark, "t")
    both = LineIndex(spark, path, **options).insert(frame(first)).insert(frame(second))
    assert cleaned(both.cleaned(frame(first + second))) == brute(first + second)
    both.insert(frame(second[:10]))  # known documents: nothing changes
    assert cleaned(both.cleaned(frame(first + second))) == brute(first + second)
    again = LineIndex(spark, path, **options)  # a new session's view of the folder
    assert again.version == both.version
    again.delete(frame(second).select("doc_id"))
    assert state(again) == state(only)
    assert cleaned(again.cleaned(frame(first))) == brute(first)
    again.insert(frame(second))
    assert cleaned(again.cleaned(frame(first + second))) == brute(first + second)


def test_filters_hold_shared_keys(spark):
    rng = random.Random(4)
    frame = spark.createDataFrame(made(rng, range(100), POOL), "doc_id long, text string")
    index = LineIndex(spark, scratch_path(spark, "t"), shard_keys=4).insert(frame)
    index.delete(spark.range(40).select(F.col("id").alias("doc_id")))
    bits = index._bits()
    filters = {r["shard"]: Cuckoo.from_bytes(r["slots"]) for r in index.filters().collect()}
    shared = [bytes(r["key"]) for r in index.counts().where("n >= 3").collect()]
    assert bits > 0 and sum(f.items() for f in filters.values()) == len(shared)
    assert all(filters[(k[0] << 8 | k[1]) >> 16 - bits].has([k])[0] for k in shared)


def test_odd_rows(spark):
    """Repeated rows are one document, NULL ids are smaller than others, other columns (with clashing names) stay."""
    line = "one line that three documents hold"
    rows = [(1, line, "x", 1), (1, line, "x", 1), (2, line.upper(), None, 2), (2, "another text\n" + line, "key", 3), (None, line, None, None),
            (None, "\n " + line + " \n", "z", 4), (7, None, None, 5), (8, "", "", 6)]
    schema = "doc_id long, text string, `keys` string, row long"
    got = [(r["row"]["doc_id"], r["row"]["row"], r["text"], r["n_dropped"]) for r in line_dedup(spark.createDataFrame(rows, schema)).collect()]
    # of the two documents with id 2, the one with the larger hash keeps the line
    kept = [g for g in got if line in g[2].lower()]
    assert len(got) == 8 and len(kept) == 1 and kept[0][0] == 2
    assert (7, 5, "", 0) in got and (8, 6, "", 0) in got and (None, 4, "\n", 1) in got
    assert [g for g in got if g[0] == 1] == [(1, 1, "", 1)] * 2
    twice = spark.createDataFrame([(1, line, "", 0), (1, line, "", 0), (2, line, "", 0)], schema)
    assert all(r["n_dropped"] == 0 for r in line_dedup(twice).collect())  # two documents only


def test_empty_and_shared_odd_tables(spark):
    assert line_dedup(empty(spark)).count() == 0
    assert line_dedup(odd(spark)).count() == odd(spark).count()
    assert line_dedup(spark.createDataFrame([(5,)], "n long")).select("text", "n_lines").collect() == [("", 1)]


def test_very_long_text_and_a_line_in_every_document(spark):
    line = "the licence line that every document holds"
    long = "\n".join(f"line number {i} of a long document" for i in range(50_000))
    rows = [(i, f"{line}\nown {i}") for i in range(300)] + [(300, long + "\n" + line), (301, long), (302, long + "\n" + line)]
    got = cleaned(line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert got[300][1] == 50_001 and got[302][1] == 0 and re.search(line, got[302][2])
