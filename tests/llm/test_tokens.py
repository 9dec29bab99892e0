"""Token codes and packing: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pytest

from hpcstats.llm import packing, token_codes
from hpcstats.llm.tokens import TextEncoder, sliced, vocabulary_path, worker_encoder
from llm_helpers import ODD_ROWS, docs, empty, odd


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_memo_gives_the_ids_of_whole_texts(reference):
    rnd = random.Random(5)
    parts = ["a", "b", " ", "\n", "é", "'s", ".", ",", "12", "\t", "  ", "<|endoftext|>", "\0", "ñ", "\r\n", "\x1c", "don't", " x", "中",
             "\x85", "_", "\u2028", " the", " word,", "Word.", "\xa0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    assert TextEncoder(vocabulary_path(), memo_pieces=3000).encode(texts) == reference(texts)
    encoder = TextEncoder(vocabulary_path(), memo_pieces=200)
    assert [x for a, b in sliced(texts, 3000) for x in encoder.encode(texts[a:b])] == reference(texts)


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_operators_encode_plainly(plain):
    encoder = worker_encoder(vocabulary_path())
    ids = lambda texts: [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)]
    assert ids(["a <|endoftext|> b"]) == [[64, 220, 50256, 275]]
    rnd = random.Random(6)
    parts = ["a", " ", "\n", "é", ".", ",", "<|endoftext|>", "<|endoftext", "|>", "<", " the", " word,", "Word."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    assert ids(texts) == plain(texts)


def test_added_tokens_in_the_tables(spark, plain):
    texts = ["a b", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y", "c d"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = [len(x) + 1 for x in plain(texts)]
    found = token_codes.read_documents(token_codes.write_tokens(table)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in found] == sizes and [r.start for r in found] == (np.cumsum(sizes) - sizes).tolist()
    pieces = packing.pack_documents(table)
    assert dict(pieces.groupBy("doc_id").sum("length").collect()) == dict(enumerate(sizes))


@pytest.mark.parametrize("ids", [[], [0], [0, 2 ** 32 - 1, 255, 256, 4095, 4096, 65535, 65536],
                                 np.random.default_rng(1).integers(0, 50257, 3000).tolist()])
def test_codes_are_directly_addressable(ids):
    segment = token_codes.Segment(token_codes.encode_segment(np.array(ids, dtype=np.uint32)))
    assert segment.ids().tolist() == ids
    assert [segment.token(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        segment.token(len(ids))


def test_tokens_of_the_table(spark, reference):
    table = docs(spark).select("doc_id", "text").orderBy("doc_id").collect()
    codes = [c + b"\0\0\0\0" for c in reference([r.text for r in table])]
    sizes = np.array([len(c) // 4 for c in codes])
    segments = token_codes.write_tokens(docs(spark), segment_tokens=5000)
    found = token_codes.read_documents(segments).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == list(zip([r.doc_id for r in table], (np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), map(zlib.crc32, codes)))
    whole = np.frombuffer(b"".join(codes), dtype="<u4")
    places = spark.range(0, len(whole) + 50, 997).toDF("place")
    assert {r.place: r.id for r in token_codes.read_tokens(segments, places).collect()} == {p: int(whole[p]) for p in range(0, len(whole), 997)}


def test_token_edge_cases(spark):
    found = token_codes.read_documents(token_codes.write_tokens(odd(spark))).collect()
    assert len(found) == len(ODD_ROWS)
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, None, 1, 1, 1, 2, 3, 5, 6]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    assert [r.n_tokens for r in ordered if r.doc_id in (2, 3)] == [1, 1]
    assert token_codes.read_documents(token_codes.write_tokens(empty(spark))).count() == 0


def fill(counts, size):
    taken, ranks = {}, {n: [] for n in counts}
    for n, rank, pieces, first, offset in packing.plan_packing(counts, size):
        ranks[n] += range(rank, rank + pieces)
        for s in range(first, first + pieces):
            taken.setdefault(s, []).append((offset, n))
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    for places in taken.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(taken)


def fewest(items, size):
    best, items = len(items), sorted(items, reverse=True)

    def search(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                search(i + 1, [*rest, r - items[i]])
        search(i + 1, [*rooms, size - items[i]])
    search(0, [])
    return best


def test_plan_is_near_the_optimum():
    rnd, over = random.Random(3), 0
    for _ in range(300):
        size = rnd.choice([10, 20, 50])
        items = [rnd.randint(1, size) for _ in range(rnd.randint(1, 9))]
        counts = {n: items.count(n) for n in items}
        got, best = fill(counts, size), fewest(items, size)
        assert got <= best + 1
        over += got > best
    assert over <= 3


def test_plan_work_does_not_grow_with_the_counts():
    lengths = np.minimum(2048, np.random.default_rng(0).lognormal(6.3, 1, 50_000).astype(int) + 1)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    assert fill(counts, 2048) <= lengths.sum() / 2048 * 1.002 + 1
    assert len(packing.plan_packing({n: c * 10 ** 9 for n, c in counts.items()})) < 3 * len(packing.plan_packing(counts))


def test_packing_of_the_table(spark, reference):
    pieces = packing.pack_documents(docs(spark), ids=True)
    rows = pieces.collect()
    table = docs(spark).collect()
    whole = {r.doc_id: c + b"\0\0\0\0" for r, c in zip(table, reference([r.text for r in table]))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert b"".join(r.ids for r in parts) == whole[doc]
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 2048 for r in parts[1:])
        assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= total / 2048 * 1.01 + 1
    made = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert sum(len(r.ids) for r in made.values()) == 4 * total


def test_packing_edge_cases(spark):
    rows = packing.pack_documents(odd(spark)).collect()
    assert len(rows) == len(ODD_ROWS) and len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(empty(spark)).count() == 0
