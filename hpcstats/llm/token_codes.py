"""Token ids as directly addressable codes: random access to any token, no block is decoded.

An id is cut into chunks, lowest bits first; level 0 holds the first chunk of
every id of a segment, level 1 the second chunk of those ids that need one, and
so on.  Level k has one bit per entry telling whether the id goes on at level
k + 1, and a directory with the number of set bits before every ``RANK_BITS``
bits.  Token i is found by reading entry i of level 0, and as long as its bit
is set, counting the set bits before it (one directory entry and at most
``RANK_BITS`` bits) and reading that entry of the next level.

A file (a Parquet row of the segment table) holds whole documents of about
``SEGMENT_TOKENS`` tokens; documents follow each other by doc_id, and
``first_token`` gives the place of the segment's first token in the corpus.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.llm.shared import SMALL_ROWS, documents, shuffle_parts, stored, with_columns
from hpcstats.llm.tokens import sliced, vocabulary_path, worker_encoder

MAGIC = b"DAC1"
WIDTHS = (8, 4, 4, 16)  # chunk bits of the levels; together they hold any 32-bit id
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
END_ID = 0


def encode_segment(ids: np.ndarray, widths=WIDTHS) -> bytes:
    """Header (magic, levels, tokens; width and entries per level), then per level: entries, bits, directory."""
    values, head, body = np.asarray(ids, dtype=np.uint32), [], []
    total = len(values)
    for k, width in enumerate(widths):
        if k and not len(values):
            break
        low = values & np.uint32((1 << width) - 1)
        values = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        more = values != 0
        head.append((width, len(low)))
        body += [_pack(low, width), np.packbits(more, bitorder="little").tobytes(), _directory(more)]
        values = values[more]
    if len(values):
        raise ValueError("an id is wider than all levels together")
    return MAGIC + struct.pack("<BQ", len(head), total) + b"".join(struct.pack("<BQ", *h) for h in head) + b"".join(body)


def _pack(low: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return low.astype(f"<u{width // 8}").tobytes()
    if width == 4:
        low = np.append(low, 0) if len(low) % 2 else low
        return (low[::2] | low[1::2] << 4).astype(np.uint8).tobytes()
    raise ValueError(f"unsupported chunk width {width}")


def _unpack(data: memoryview, width: int, n: int) -> np.ndarray:
    if width == 4:
        pairs = np.frombuffer(data, dtype=np.uint8)
        out = np.empty(2 * len(pairs), dtype=np.uint32)
        out[::2], out[1::2] = pairs & 15, pairs >> 4
        return out[:n]
    return np.frombuffer(data, dtype=f"<u{width // 8}").astype(np.uint32)


def _directory(more: np.ndarray) -> bytes:
    blocks = -(-len(more) // RANK_BITS)
    padded = np.zeros(blocks * RANK_BITS, dtype=np.uint32)
    padded[:len(more)] = more
    sums = padded.reshape(blocks, RANK_BITS).sum(axis=1, dtype=np.uint64)
    return np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u8").tobytes() if blocks else b""


class Segment:
    """Reads one segment; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.view, levels = memoryview(data), data[4]
        self.tokens = struct.unpack_from("<Q", data, 5)[0]
        at, self.levels = 13 + 9 * levels, []
        for k in range(levels):
            width, n = struct.unpack_from("<BQ", data, 13 + 9 * k)
            sizes = ((n * width + 7) // 8, (n + 7) // 8, 8 * -(-n // RANK_BITS))
            places = []
            for size in sizes:
                places.append((at, at + size))
                at += size
            self.levels.append((width, n, places))

    def token(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for width, _, ((low, _), (bits, _), (ranks, _)) in self.levels:
            if width == 4:
                value |= (self.view[low + i // 2] >> 4 * (i % 2) & 15) << shift
            else:
                value |= int.from_bytes(self.view[low + i * width // 8:low + (i + 1) * width // 8], "little") << shift
            if not self.view[bits + i // 8] >> i % 8 & 1:
                break
            block = i // RANK_BITS
            before = int.from_bytes(self.view[bits + block * RANK_BITS // 8:bits + i // 8 + 1], "little")
            before &= (1 << i - block * RANK_BITS) - 1
            i = int.from_bytes(self.view[ranks + 8 * block:ranks + 8 * block + 8], "little") + before.bit_count()
            shift += width
        return value

    def ids(self) -> np.ndarray:
        """All ids."""
        out, where, shift = np.zeros(self.tokens, dtype=np.uint32), None, 0
        for width, n, ((low, low_end), (bits, bits_end), _) in self.levels:
            chunk = _unpack(self.view[low:low_end], width, n) << np.uint32(shift)
            out[slice(None) if where is None else where] |= chunk
            more = np.unpackbits(np.frombuffer(self.view[bits:bits_end], dtype=np.uint8), bitorder="little", count=n).astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            shift += width
        return out


def _segments(path: str, end_id: int, segment_tokens: int):
    def run(batches):
        encoder, ids, lengths, docs, tokens, part = worker_encoder(path), [], [], [], 0, None
        end, number = np.uint32(end_id).tobytes(), 0

        def close():
            return pd.DataFrame({"part": [part], "segment": [number], "n_tokens": [tokens], "doc_ids": [docs], "doc_tokens": [lengths],
                                 "data": [encode_segment(np.frombuffer(b"".join(ids), dtype="<u4"))]})

        for batch in batches:
            texts = batch["text"].tolist()
            part = int(batch["part"].iloc[0]) if len(batch) else part
            # a NULL id would become NaN: it travels as a flag and an arbitrary number
            names = [None if m else int(d) for d, m in zip(batch["doc_id"], batch["missing"])]
            for a, b in sliced(texts):
                for doc, code in zip(names[a:b], encoder.encode(texts[a:b])):
                    ids += [code, end]
                    docs.append(doc)
                    lengths.append(len(code) // 4 + 1)
                    tokens += lengths[-1]
                    if tokens >= segment_tokens:
                        yield close()
                        ids, lengths, docs, tokens, number = [], [], [], 0, number + 1
        if docs:
            yield close()
    return run


def write_tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encode documents in ascending doc_id order into segments: part, segment, first_token, n_tokens, doc_ids, doc_tokens, data.

    NULL texts are empty (one end id).  NULL ids come first; rows with the same
    id are ordered by their text's hash, and repeated rows stay.  An empty table
    gives no segments.  Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    rows = with_columns(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text",
        F.spark_partition_id().alias("part"))
    schema = "part int, segment int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, data binary"
    segments = stored(sorted_rows.mapInPandas(_segments(path or vocabulary_path(), end_id, segment_tokens), schema), "segments")
    # places in the corpus: a sum over the few parts, then inside each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        F.col("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    index = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside")).join(parts, "part")
    index = index.select("part", "segment", (F.col("part_start") + F.col("inside")).alias("first_token"))
    # one row per segment: broadcast if counted small, else a shuffle by segment
    if segments.count() <= SMALL_ROWS:
        index = F.broadcast(index)
    return segments.join(index, ["part", "segment"])


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the segments: doc_id, start, n_tokens, ids_crc32 (ids as little-endian 32-bit)."""
    def run(batches):
        for batch in batches:
            for first, docs, lengths, data in zip(batch["first_token"], batch["doc_ids"], batch["doc_tokens"], batch["data"]):
                lengths = np.asarray(lengths, dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = memoryview(Segment(bytes(data)).ids().astype("<u4").tobytes())
                yield pd.DataFrame({"place": np.arange(len(lengths)), "start": first + ends - lengths, "n_tokens": lengths,
                                    "ids_crc32": [zlib.crc32(ids[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())],
                                    "doc_id": pd.array([None if d is None or d != d else int(d) for d in docs], dtype="Int64")})
    return segments.select("first_token", "doc_ids", "doc_tokens", "data").mapInPandas(
        run, "place int, start long, n_tokens long, ids_crc32 long, doc_id long").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_tokens(segments: DataFrame, places: DataFrame) -> DataFrame:
    """Random access: (place) to (place, id) for any places in the corpus; unknown places are left out, repeated ones answered once."""
    width = SEGMENT_TOKENS
    spans = segments.select("first_token", "n_tokens", "data", F.explode(F.sequence(
        F.floor(F.col("first_token") / width), F.floor((F.col("first_token") + F.col("n_tokens") - 1) / width))).alias("cell"))
    asked = places.select(F.col("place").cast("long").alias("place"), F.floor(F.col("place") / width).alias("cell"))
    found = asked.join(spans.select("cell", "first_token", "n_tokens"), "cell").where(
        (F.col("place") >= F.col("first_token")) & (F.col("place") < F.col("first_token") + F.col("n_tokens")))
    wanted = found.groupBy("first_token").agg(F.collect_set("place").alias("places"))

    def run(batches):
        for batch in batches:
            for first, asked_places, data in zip(batch["first_token"], batch["places"], batch["data"]):
                segment = Segment(bytes(data))
                yield pd.DataFrame({"place": asked_places, "id": [segment.token(int(p) - int(first)) for p in asked_places]})
    return wanted.join(segments.select("first_token", "data"), "first_token").mapInPandas(run, "place long, id long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(documents(spark, sf_dir)))
