"""Substring dedup by prefix-free parsing: remove what an earlier document already says.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id.  All 50-byte strings of the corpus are compared, by parsing
instead of sorting every suffix:

* Triggers and phrases.  A rolling hash runs over all ``TRIGGER``-byte strings;
  the smallest in a 50-byte string is its trigger.  Neighbouring strings with
  the same trigger make a phrase, so phrases overlap by 49 bytes, each 50-byte
  string lies in exactly one, and equal strings lie in phrases of equal trigger
  wherever they stand.
* Parse.  Every block of documents reports its different triggers to the
  trigger's bucket.  A trigger found in one document only cannot be part of a
  repetition; its phrases are dropped, and with them most of the corpus.
* Dictionary.  The other phrases go to their trigger's bucket, one for equal
  phrases of a block (the smallest doc_id's; the rest are covered by it).
  There all suffixes of the phrases are ordered by a fingerprint of their first
  50 bytes - equality, not alphabetical order, decides - and the smallest
  doc_id of every run of equal suffixes marks the others as repeated.

A trigger that occurs in very many different phrases (a stock expression in a
third of the texts) would fill its bucket: above ``HOT`` its 50-byte strings
travel singly, dealt by their own fingerprints.  Documents lie in blocks of
about ``BLOCK_BYTES``, stored once; what buckets answer is small and joined to
the blocks by their numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import batch_rows, documents, shuffle_parts, stored, with_columns
from hpcstats.llm.wordhash import BASE, BYTE_VALUES, mixed, powers

LENGTH = 50
TRIGGER = 20
BLOCK_BYTES = 1_000_000
BUCKET_BYTES = 4_000_000
BATCH_BLOCKS = 16  # blocks handed to Python at a time
HOT = 20_000
NO_ID = np.iinfo(np.int64).min


def _times(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every string of the length: doubled up from single bytes."""
    total, size, have = None, 0, BYTE_VALUES[data]
    step, bits = 1, length
    while bits:
        if bits & 1:
            if total is None:
                total, size = have, step
            else:  # strings of size + step: the longer part first
                n = len(data) - size - step + 1
                total = have[:n] * _times(size) + total[step:step + n]
                size += step
        bits >>= 1
        if bits:
            n = len(have) - step
            have = have[:n] * _times(step) + have[step:]
            step *= 2
    return mixed(total)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return np.minimum(low[:len(low) - (width - span)], low[width - span:]) if width > span else low


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER, chunk: int = 1 << 18):
    """Start, number of strings and trigger of every phrase of texts that lie end to end (``ends``)."""
    starts, counts, triggers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    over = length - 1
    for a in range(0, len(data) - over, chunk):
        part = data[a:a + chunk + over]
        least = _sliding_least(rolling(part, trigger), length - trigger + 1)
        inside = np.ones(len(least) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        for e in ends[np.searchsorted(ends, a + 1):np.searchsorted(ends, a + len(part))]:
            inside[max(1, e - over - a + 1):max(1, e - a + 1)] = False
        change = least[1:] != least[:-1]
        first = inside[1:-1] & ~inside[:-2]
        first[1:] |= inside[2:-1] & change
        last = inside[1:-1] & ~inside[2:]
        last[:-1] |= inside[1:-2] & change
        at = np.flatnonzero(first)
        starts.append(at + a)
        counts.append(np.flatnonzero(last) - at + 1)
        triggers.append(least[at])
    # least hashes are small numbers: mixed once more, they fill all buckets alike
    return np.concatenate(starts), np.concatenate(counts), mixed(np.concatenate(triggers) + np.uint64(1))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(data))
    sizes = np.frombuffer(raw, dtype=np.int64, offset=8, count=len(types)).tolist()
    out, at = [], 8 + 8 * len(types)
    for kind, size in zip(types, sizes):
        out.append(np.frombuffer(raw, dtype=kind, offset=at, count=size // np.dtype(kind).itemsize))
        at += size
    return out


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Stored blocks: block, n_bytes, ids (int64, ``NO_ID`` for NULL), ends (int64), data (texts end to end, UTF-8)."""
    def run(batches):
        part, number = None, 0
        for frame in batches:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            ids, texts, size = [], [], 0
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids.append(NO_ID if doc is None else int(doc))
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= block_bytes:
                    yield close(part, number, ids, texts)
                    ids, texts, size, number = [], [], 0, number + 1
            if ids:
                yield close(part, number, ids, texts)
                number += 1

    def close(part, number, ids, texts):
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return pd.DataFrame({"block": [part << 32 | number], "n_bytes": [int(ends[-1])], "ids": [np.array(ids, dtype=np.int64).tobytes()],
                             "ends": [ends.tobytes()], "data": [b"".join(texts)]})

    rows = with_columns(docs, doc_id="string", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    return stored(rows.mapInPandas(run, "block long, n_bytes long, ids binary, ends binary, data binary"), "blocks")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _parts(frame: pd.DataFrame):
    """The blocks of a frame as (block, ids, ends, data)."""
    for block, ids, ends, data in zip(frame["block"], frame["ids"], frame["ends"], frame["data"]):
        yield int(block), np.frombuffer(ids, dtype=np.int64), np.frombuffer(ends, dtype=np.int64), np.frombuffer(data, dtype=np.uint8)


def _different(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes in order, how often each comes, and whether more than one owner has it."""
    order = np.argsort(hashes, kind="stable")
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(h)))
    several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first) if len(h) else np.zeros(0, dtype=bool)
    return h[first], count, several


def repeated_triggers(blocks: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """Per block, answers of the buckets: block, answers (place of the first trigger, bits: repeated, bits: hot)."""
    def report(batches):
        for frame in batches:
            for block, ids, ends, data in _parts(frame):
                starts, _, triggers = phrases(data, ends)
                known, count, several = _different(triggers, ids[np.searchsorted(ends, starts, side="right")])
                cuts = np.searchsorted(_bucket(known, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({
                    "bucket": full, "block": block, "place": cuts[full],
                    # within a bucket the low half of a hash and a few high bits tell triggers apart; a chance match costs work only
                    "data": [_pack(known[a:b].astype(np.uint32), np.minimum(count[a:b], 255).astype(np.uint8), several[a:b])
                             for a, b in zip(cuts[full], cuts[full + 1])]})

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(d, np.uint32, np.uint8, bool) for d in frame["data"]]
        known, count, several = (np.concatenate(x) for x in zip(*parts))
        values, at, blocks_with = np.unique(known, return_inverse=True, return_counts=True)
        live = blocks_with > 1
        live[at[several]] = True
        often = np.bincount(at, weights=count, minlength=len(values)) > hot
        bits = [(live[x], (often & live)[x]) for x in np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])]
        return pd.DataFrame({"block": frame["block"], "answer": [_pack(np.array([p, len(a)], dtype=np.int64), np.packbits(a), np.packbits(b))
                                                                 for p, (a, b) in zip(frame["place"], bits)]})

    reports = blocks.mapInPandas(report, "bucket int, block long, place long, data binary")
    answers = reports.groupBy("bucket").applyInPandas(answer, "block long, answer binary")
    return stored(answers.groupBy("block").agg(F.collect_list("answer").alias("answers")), "triggers")


def _dictionary(block, ids, ends, data, answers, buckets):
    """Rows (bucket, block, local, data) of a block's phrases with repeated triggers, and what it settles itself."""
    starts, counts, triggers = phrases(data, ends)
    order = np.argsort(triggers, kind="stable")
    known = triggers[order]
    live, hot = np.zeros(len(known), dtype=bool), np.zeros(len(known), dtype=bool)
    first = np.flatnonzero(np.concatenate([[True], known[1:] != known[:-1]])) if len(known) else np.zeros(0, dtype=np.int64)
    rank = np.zeros(len(known), dtype=np.int64)
    rank[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(known))))
    for packed in answers:
        (place, n), a, b = _unpack(packed, np.int64, np.uint8, np.uint8)
        live[place:place + n], hot[place:place + n] = (np.unpackbits(x, count=n).astype(bool) for x in (a, b))
    live, hot = live[rank], hot[rank]
    singles = live & hot
    # strings of hot triggers travel singly, by their own fingerprints
    at = ragged(starts[singles], counts[singles])
    strings = ragged(starts[singles], counts[singles] + LENGTH - 1)
    key = _suffixes(data[strings], counts[singles]) if len(at) else np.zeros(0, dtype=np.uint64)
    live &= ~hot
    starts, counts = np.concatenate([starts[live], at]), np.concatenate([counts[live], np.ones(len(at), dtype=np.int64)])
    key = np.concatenate([triggers[live], key])
    if not len(starts):
        return
    doc = np.searchsorted(ends, starts, side="right")
    # equal phrases of this block: all but the smallest doc_id's are covered
    running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), dtype=np.uint64)])
    stops = starts + counts + LENGTH - 1
    shift = powers(BASE, len(data))[len(data) - 1 - starts]  # the same power for all places
    content = mixed(mixed((running[stops] - running[starts]) * shift + counts.astype(np.uint64)) ^ key)
    _, same = np.unique(content, return_inverse=True)
    least = np.full(same.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids[doc])
    covered = ids[doc] > least[same]
    yield 0, block, True, _pack(starts[covered], stops[covered])
    rest = np.flatnonzero(~covered)
    bucket = _bucket(key[rest], buckets).astype(np.int64)
    rest = rest[np.argsort(bucket, kind="stable")]
    cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        x = rest[cuts[b]:cuts[b + 1]]
        text = data[ragged(starts[x], counts[x] + LENGTH - 1)]
        yield int(b), block, False, _pack(ids[doc[x]], starts[x], counts[x], text)


def _suffixes(text: np.ndarray, counts: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
    """Fingerprint of the first ``LENGTH`` bytes of every suffix of phrases that lie end to end, some phrases at a time."""
    sizes = counts + LENGTH - 1
    ends = np.cumsum(sizes)
    out, i = [], 0
    while i < len(counts):
        start = ends[i] - sizes[i]
        j = max(i + 1, int(np.searchsorted(ends, start + chunk)))
        out.append(rolling(text[start:ends[j - 1]], LENGTH)[ragged(ends[i:j] - sizes[i:j] - start, counts[i:j])])
        i = j
    return np.concatenate(out)


def _repeats(frame: pd.DataFrame) -> pd.DataFrame:
    """A bucket of the dictionary: byte ranges (block, ranges) whose 50-byte strings start in a smaller doc_id too."""
    local, frame = frame[frame["local"]], frame[~frame["local"]]
    out = [pd.DataFrame({"block": local["block"], "ranges": local["data"]})]
    if len(frame):
        parts = [_unpack(d, np.int64, np.int64, np.int64, np.uint8) for d in frame["data"]]
        ids, starts, counts, text = (np.concatenate(x) for x in zip(*parts))
        where = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        suffix = _suffixes(text, counts)
        at = np.arange(len(suffix))
        owner = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(suffix)
        ordered = suffix[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        least = np.minimum.reduceat(ids[owner[order]], first)
        repeated = np.zeros(len(at), dtype=bool)
        repeated[order] = ids[owner[order]] > np.repeat(least, np.diff(np.append(first, len(at))))
        # neighbouring repeated strings of a phrase make one range
        edge = np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        breaks = np.cumsum(counts)[:-1]
        inner = breaks[repeated[breaks] & repeated[breaks - 1]] if len(breaks) else breaks
        begin, end = np.sort(np.concatenate([begin, inner])), np.sort(np.concatenate([end, inner]))
        offset = begin - (np.cumsum(counts) - counts)[owner[begin]]
        a = starts[owner[begin]] + offset
        b = a + (end - begin) + LENGTH - 1
        by = where[owner[begin]]
        cuts = np.searchsorted(by, np.arange(len(parts) + 1))
        out.append(pd.DataFrame({"block": frame["block"].to_numpy(), "ranges": [_pack(a[x:y], b[x:y]) for x, y in zip(cuts, cuts[1:])]})[np.diff(cuts) > 0])
    return pd.concat(out)


def _answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with their answers, joined by block at every size: the answers grow with the corpus."""
    return blocks.join(answers.hint("shuffle_merge"), "block", "left")


def repeated_ranges(blocks: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """Per block: block, ranges (packed starts and ends of repeated bytes, from the block's buckets)."""
    def parse(batches):
        for frame in batches:
            for (block, ids, ends, data), answers in zip(_parts(frame), frame["answers"]):
                rows = list(_dictionary(block, ids, ends, data, answers if answers is not None else [], buckets))
                if rows:
                    yield pd.DataFrame(rows, columns=["bucket", "block", "local", "data"])

    known = _answered(blocks, repeated_triggers(blocks, buckets, hot))
    phrase_rows = known.mapInPandas(parse, "bucket int, block long, local boolean, data binary")
    # ranges settled in the block need no bucket: they are dealt by block
    dealt = phrase_rows.withColumn("task", F.when(F.col("local"), F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("bucket")))

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        return _repeats(frame)

    found = dealt.groupBy("task").applyInPandas(find, "block long, ranges binary")
    return stored(found.groupBy("block").agg(F.collect_list("ranges").alias("ranges")), "ranges")


def removed_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for).

    NULL and empty texts have no bytes.  A NULL doc_id counts as smaller than
    any other; rows that share a doc_id are not earlier than each other.  An
    empty table gives no rows; columns other than doc_id and text are ignored.
    ``kept_text`` decodes the remaining bytes, replacing what is cut inside a
    character.
    """
    blocks = text_blocks(docs, block_bytes)
    total = blocks.select(F.sum("n_bytes")).first()[0] or 0
    buckets = max(2 * shuffle_parts(docs.sparkSession), -(-total // BUCKET_BYTES))

    def cut(batches):
        for frame in batches:
            for (_, ids, ends, data), ranges in zip(_parts(frame), frame["ranges"]):
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                for packed in ranges if ranges is not None else []:
                    a, b = _unpack(packed, np.int64, np.int64)
                    np.add.at(cover, a, 1)
                    np.add.at(cover, b, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out = []
                for doc, a, b in zip(ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                    own = gone[a:b]
                    kept = data[a:b][~own].tobytes()
                    spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + bool(len(own) and own[0])
                    out.append((str(doc) if doc != NO_ID else None, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(),
                                kept.decode("utf-8", "replace") if texts else None))
                yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    with batch_rows(docs.sparkSession, BATCH_BLOCKS):
        marked = _answered(blocks, repeated_ranges(blocks, buckets, hot))
        rows = marked.mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
        return stored(rows if texts else rows.drop("kept_text"), "cut")


def query(spark, sf_dir: str) -> DataFrame:
    return removed_repeats(documents(spark, sf_dir))
