"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of 1 to ``size`` tokens, and only the *number* of
pieces of each length decides how they are packed: at most ``size`` counts,
however large the corpus.  The plan is made on these counts.

1. Reduction.  From the largest open length down, a set is fixed for good if
   it dominates every other set that could hold that piece: the piece with the
   largest partner that fits, when nothing else fits beside it, when the two
   fill the sequence, or when no two shorter pieces together fill the place
   better than that partner (and three never fit).  Identical pieces are fixed
   together, as many as the counts allow.
2. Best fit, decreasing, of the remainder: all pieces of a length go into the
   open sequences with the least room that holds them, whole groups of equal
   sequences at a time.

The plan says, for each length and each range of ranks among the pieces of that
length, the sequence of the first piece and the place in it.  Ranks come from
the stored piece table (a number within its part and length, plus the counts of
the parts before), so neither a hot length nor the whole table meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.llm.shared import SMALL_ROWS, documents, stored, with_columns
from hpcstats.llm.tokens import sliced, vocabulary_path, worker_encoder

SIZE = 2048
END_ID = 0


def cut_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Tokenised pieces: doc_id, row, piece, start, length, ids (binary, little-endian 32-bit), ids_crc32, part, rank.

    A document is its ids and one end id (NULL text: the end id alone).  Longer
    ones are cut into pieces of ``size``, the first taking what is over.  ``row``
    tells documents repeated with the same id apart.  Stored, so that ``part``
    and ``rank`` (number among the pieces of this length in its part) stay.
    """
    path = path or vocabulary_path()

    def run(batches):
        encoder, seen, end = worker_encoder(path), np.zeros(size + 1, dtype=np.int64), np.uint32(end_id).tobytes()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in sliced(texts):
                out = []
                for doc, row, part, code in zip(batch["doc_id"][a:b], batch["row"][a:b], batch["part"][a:b], encoder.encode(texts[a:b])):
                    code += end
                    n = len(code) // 4
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        ids = code[4 * x:4 * y]
                        out.append((doc, row, k, x, y - x, ids, zlib.crc32(ids), part, int(seen[y - x])))
                        seen[y - x] += 1
                yield pd.DataFrame(out, columns=["doc_id", "row", "piece", "start", "length", "ids", "ids_crc32", "part", "rank"])

    rows = with_columns(docs, doc_id="string", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("part"))
    schema = "doc_id string, row long, piece int, start long, length long, ids binary, ids_crc32 long, part int, rank long"
    return stored(rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")), "pieces")


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Length counts to rows (length, first rank, pieces, first sequence, offset).

    The pieces of ranks first .. first + pieces - 1 go to the sequences first
    sequence, first sequence + 1, ..., each at the offset.  Work grows with the
    number of different lengths, not with the counts.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    given = dict.fromkeys(left, 0)
    rows, sequences = [], 0

    def place(length, pieces, first, offset):
        rows.append((length, given[length], pieces, first, offset))
        given[length] += pieces
        left[length] -= pieces
        if not left[length]:
            lengths.remove(length)

    def smallest(many, without):
        """The sum of the smallest ``many`` open pieces, one of length ``without`` not counted."""
        total = found = 0
        for n in lengths:
            c = min(left[n] - (n == without), many - found)
            total, found = total + n * c, found + c
            if found == many:
                return total
        return size + 1

    def largest(room, without):
        """The largest open length of at most ``room`` (0: none), one piece of ``without`` not counted."""
        i = bisect_left(lengths, room + 1) - 1
        while i >= 0 and left[lengths[i]] == (lengths[i] == without):
            i -= 1
        return lengths[i] if i >= 0 else 0

    def best_pair(room, without):
        best, i, j = 0, 0, len(lengths) - 1
        while i <= j:
            a, b = lengths[i], lengths[j]
            need = 2 if a == b else 1
            if a + b > room or left[b] - (b == without) < need:
                j -= 1
            elif left[a] - (a == without) < need:
                i += 1
            else:
                best, i = max(best, a + b), i + 1
        return best

    # 1. reduction, from the largest length down; a length that no rule fixes is left for the second step
    for n in sorted(left, reverse=True):
        while left[n]:
            room = size - n
            mate = largest(room, n)
            if mate and mate != room and smallest(2, n) <= room:
                if smallest(3, n) <= room or best_pair(room, n) > mate:
                    break
            pieces = left[n] if not mate else left[n] // 2 if mate == n else min(left[n], left[mate])
            place(n, pieces, sequences, 0)
            if mate:
                place(mate, pieces, sequences, n)
            sequences += pieces

    # 2. best fit of the remainder: open groups of equal sequences by room
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def open_group(room, first, many):
        if room and many:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, many))

    for n in sorted(left, reverse=True):
        while left[n]:
            i = bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
                pieces = min(many, left[n])
                open_group(room, first + pieces, many - pieces)
            else:  # none has room: as many new sequences as these pieces fill, each with all it holds
                room, first = size, sequences
                pieces = max(1, left[n] // (size // n))
                sequences += pieces
            place(n, pieces, first, size - room)
            open_group(room - n, first, pieces)
    return rows


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces (length, part, rank, ...) with sequence_id and offset, all columns kept."""
    parts = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most ``size`` rows: bounded by the sequence length, not by the data
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(counts, size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if parts.count() <= SMALL_ROWS:
        starts = F.broadcast(starts)
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first")
    table = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        rows = shared.value
        key = rows[:, 0] * (1 << 50) + rows[:, 1]
        for batch in batches:
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(key, batch["length"].to_numpy() * (1 << 50) + rank, side="right") - 1
            batch["sequence_id"] = rows[at, 3] + rank - rows[at, 1]
            batch["offset"] = rows[at, 4]
            yield batch

    ranked = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(place, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    NULL and empty texts are one end id; NULL doc_ids and rows repeated with an
    id are packed like any others; an empty table gives no pieces.  Columns
    other than doc_id and text are ignored.
    """
    pieces = cut_pieces(docs, path, size, end_id)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if ids else [])]
    return pack(pieces.select(*columns, "part", "rank"), size).select(*columns, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary), doc_ids, lengths; from pieces with ids.

    A group is one sequence: at most ``size`` ids.
    """
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"),
                       F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"), F.expr("transform(p, x -> x.length)").alias("lengths"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
