"""Conversation structure repair by depth-first branch-and-bound.

A conversation is its rows by turn.  Each row has at most one fault, the first
of: blank (no character but white space), duplicate (role and text seen
earlier), truncated (its last such character ends no sentence).  Edits make its
roles, by their first characters, ``(s?(ua)+)?``: keep a row, give it the role
that belongs there, delete it (blank and duplicate rows must go), insert an
empty turn.  The cheapest edits are sought; among equally cheap ones those whose
letters (D, I, K, R) come first in ASCII order.

``cheapest`` is the search: an explicit stack of prefixes (rows done, state of
the role pattern, cost, letters); a lower bound of what is left, per row and
state; the incumbent (cost, letters); and per node the best prefix that reached
it, which dominates every worse one, as whatever follows a prefix can follow the
other (two prefixes of one node and cost are never the beginning of one
another: they have as many row letters, and inserts cost).  The search ends when
the stack is empty, which proves the incumbent to be best.

Scale.  Rows equal in everything are folded into one with a count.  What is
"seen earlier" is a minimum per text, aggregated before it is shuffled.  Rows are
partitioned by ranges of (conversation, turn, ...), so a conversation that holds
a third of all rows lies over many tasks, and are cut into blocks of bounded rows
and characters.  A conversation that lies whole in one block is repaired there.
Of others, each block gives the cheapest edits from every state to every other
(by the dominance above, nothing else can be part of the best), a fold over the
blocks picks those that fit together, and a last pass over the blocks applies
them.  That last pass streams a conversation through one task, one block at a
time, as the digest of a whole text takes its bytes in order.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import shuffle_parts, stored, with_columns

SPACE = " \t\n\v\f\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
BLOCK_ROWS, BLOCK_CHARS = 256, 4_000_000

# States of the role pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, DONE = range(4)
STATES = (START, SYSTEM, USER, DONE)
ACCEPT = (START, DONE)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): DONE, (DONE, "u"): USER}
# What an inserted or rewritten turn says in each state, and the state behind it.
SAYS = {START: "user", SYSTEM: "user", USER: "assistant", DONE: "user"}
NEXT = {s: MOVES[s, SAYS[s][0]] for s in STATES}
FAR = float("inf")


def suffix_bounds(rows: list[tuple], goals) -> list[list[float]]:
    """Least cost of the rows from each place on, from each state to one of ``goals``."""
    bounds = [[0.0 if s in goals else FAR for s in STATES]]
    for must, initial, cut, times in reversed(rows):
        _inserted(bounds[-1])
        after, here = bounds[-1], []
        for s in STATES:
            least = DELETE * times + after[s]
            if not must:
                least = min(least, REROLE + cut + after[NEXT[s]])
                if (to := MOVES.get((s, initial))) is not None:
                    least = min(least, cut + after[to])
            here.append(least)
        bounds.append(here)
    _inserted(bounds[-1])
    return bounds[::-1]


def _inserted(bound: list[float]) -> None:
    """Let inserts shorten the way: twice, for a user and an assistant turn."""
    for _ in range(3):
        for s in STATES:
            bound[s] = min(bound[s], INSERT + bound[NEXT[s]])


def cheapest(rows: list[tuple], entry: int = START, goals=ACCEPT) -> tuple[int, str] | None:
    """(cost, letters) of the best edits of rows (must go, role initial, truncated, times); None if no edits reach a goal."""
    bounds, n = suffix_bounds(rows, goals), len(rows)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, s, cost, letters = stack.pop()
        least = cost + bounds[i][s]
        if least == FAR or best and (least > best[0] or least == best[0] and letters > best[1][:len(letters)]):
            continue
        if (i, s) in reached and reached[i, s] <= (cost, letters):
            continue
        reached[i, s] = cost, letters
        if i == n and s in goals and (best is None or (cost, letters) < best):
            best = cost, letters
        ways = []
        if i < n:
            must, initial, cut, times = rows[i]
            ways.append((i + 1, s, cost + DELETE * times, letters + "D" * times))
        ways.append((i, NEXT[s], cost + INSERT, letters + "I"))
        if i < n and not must:
            if (s, initial) in MOVES:
                ways.append((i + 1, MOVES[s, initial], cost + cut, letters + "K"))
            ways.append((i + 1, NEXT[s], cost + REROLE + cut, letters + "R"))
        stack.extend(reversed(ways))
    return best


def table(rows: list[tuple]) -> dict[tuple[int, int], tuple[int, str]]:
    """The best edits of a block from every state to every other."""
    return {(a, b): found for a in STATES for b in STATES if (found := cheapest(rows, a, (b,))) is not None}


class Applied:
    """Applies letters to rows as they come and digests the repaired conversation."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START
        self.digest, self.begun = hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        line = f"{role}:{text}"
        self.digest.update((("\n" if self.begun else "") + line).encode("utf-8", "surrogatepass"))
        self.begun = True
        self.state = MOVES[self.state, role[:1]]

    def _inserts(self) -> None:
        while self.letters[self.at:self.at + 1] == "I":
            self._say(SAYS[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, times: int) -> None:
        self._inserts()
        letter = self.letters[self.at]
        if letter == "D":
            self.at += times
            return
        self._say(role if letter == "K" else SAYS[self.state], text)
        self.at += 1

    def sha256(self) -> str:
        self._inserts()
        return self.digest.hexdigest()


class Block:
    """Rows of one conversation, one after another: what is to be searched, and sums."""

    def __init__(self):
        self.rows: list[tuple] = []      # role, text, must go, truncated, times
        self.chars = 0
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.lowest = self.highest = self.first = self.last = None

    def add(self, turn, role: str, text: str, seen: bool, copies: int) -> None:
        initial = role[:1]
        self.sums["illegal"] += (self.last is not None and self.last + initial not in ("su", "ua", "au")) + copies - 1
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.sums["turns"] += turn != self.highest
            self.lowest, self.highest = turn if self.lowest is None else self.lowest, turn
        self.chars += len(text) + len(role)
        bare = text.strip(SPACE)
        if not bare or seen:
            self.sums["blank" if not bare else "duplicate"] += copies
            self.rows.append((role, text, True, 0, copies))
            return
        cut = CUT if bare[-1] not in ENDS else 0
        self.sums["truncated"] += cut
        self.rows.append((role, text, False, cut, 1))
        if copies > 1:
            self.sums["duplicate"] += copies - 1
            self.rows.append((role, "", True, 0, copies - 1))

    def search(self) -> list[tuple]:
        return [(must, role[:1], cut, times) for role, _, must, cut, times in self.rows]

    def result(self, cost: int, letters: str, digest: str) -> dict:
        return _report(self.sums | {"lowest": self.lowest, "highest": self.highest}, cost, letters, digest)


def _report(sums: dict, cost: int, letters: str, digest: str | None) -> dict:
    gaps = 0 if sums["lowest"] is None else sums["highest"] - sums["lowest"] + 1 - sums["turns"]
    return {"gaps": gaps} | {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {
        "cost": cost, "audit": letters, "repaired_sha256": digest}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCKS = ("has_conv boolean, conv long, part int, no int, whole boolean, lowest string, highest string, first string, last string, turns long, "
          + RESULT + ", edits array<struct<a: int, b: int, cost: bigint, letters: string>>, "
          "rows array<struct<role: string, text: string, must: boolean, cut: int, times: bigint>>")


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by crc32(conv_id:turn) % 20; NULLs become one space."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows with ``copies`` and ``seen`` (role and text are in an earlier turn of the conversation)."""
    text = F.coalesce("text", F.lit(" "))
    clean = with_columns(rows, conv_id="long", turn="long", role="string", text="string").select(
        F.col("conv_id").isNotNull().alias("has_conv"), F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    folded = clean.groupBy(*clean.columns).agg(F.count(F.lit(1)).alias("copies"))
    folded = stored(folded.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")}), "repair-rows")
    key = ["has_conv", "conv", "role", "t1", "t2"]
    place = F.struct("has_turn", "turn")
    first = folded.groupBy(*key).agg(F.min(place).alias("first"))
    return folded.join(first, key).withColumn("seen", place != F.col("first")).drop("first", "t1", "t2")


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Conversations cut into blocks: results where the whole conversation is one block, else edits and rows."""
    order = ["has_conv", "conv", "has_turn", "turn", "role"]
    marked = _marked(rows)
    dealt = marked.repartitionByRange(shuffle_parts(marked.sparkSession), *order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")

    def flushed(key, no: int, block: Block, whole: bool) -> dict:
        out = dict(zip(("has_conv", "conv"), key)) | {"part": TaskContext.get().partitionId(), "no": no, "whole": whole}
        out |= {"lowest": _text(block.lowest), "highest": _text(block.highest), "first": block.first, "last": block.last, "turns": block.sums["turns"]}
        if whole:
            cost, letters = cheapest(block.search())
            applied = Applied(letters)
            for role, text, _, _, times in block.rows:
                applied.row(role, text, times)
            return out | block.result(cost, letters, applied.sha256()) | {"edits": None, "rows": None}
        edits = [{"a": a, "b": b, "cost": c, "letters": x} for (a, b), (c, x) in table(block.search()).items()]
        kept = [dict(zip(("role", "text", "must", "cut", "times"), r)) for r in block.rows]
        return out | block.result(0, "", None) | {"edits": edits, "rows": kept}

    def run(frames):
        key, block, no, first = None, Block(), 0, True
        for frame in frames:
            out = []
            for has_conv, conv, has_turn, turn, role, text, copies, seen in frame.itertuples(index=False, name=None):
                if key != (has_conv, conv):
                    if key is not None:  # neither the task's first nor its last conversation: it lies in no other task
                        out.append(flushed(key, no, block, no == 0 and not first))
                        first = False
                    key, block, no = (has_conv, conv), Block(), 0
                elif len(block.rows) >= block_rows or block.chars >= block_chars:
                    out.append(flushed(key, no, block, False))
                    block, no = Block(), no + 1
                block.add(turn if has_turn else None, role, text, seen, copies)
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([flushed(key, no, block, False)])

    columns = ["has_conv", "conv", "has_turn", "turn", "role", "text", "copies", "seen"]
    return stored(dealt.select(*columns).mapInPandas(run, BLOCKS), "repair-blocks")


def _text(turn) -> str | None:
    """A turn as text: pandas would round a long in a column with NULLs."""
    return None if turn is None else str(int(turn))


def _by_conversation(df: DataFrame, *order) -> DataFrame:
    return df.repartition(shuffle_parts(df.sparkSession), "has_conv", "conv").sortWithinPartitions("has_conv", "conv", *order)


def _chosen(cut: DataFrame) -> DataFrame:
    """For conversations of several blocks: the edits that fit together best, and the sums over the blocks."""
    def told(key, sums, ways) -> dict:
        cost, letters = min(found for s, found in ways.items() if s in ACCEPT)
        return dict(zip(("has_conv", "conv"), key)) | _report(sums, cost, letters, None)

    def run(frames):
        key, sums, ways = None, None, None
        for frame in frames:
            out = []
            for b in frame.to_dict("records"):
                if key != (b["has_conv"], b["conv"]):
                    if key is not None:
                        out.append(told(key, sums, ways))
                    key, ways = (b["has_conv"], b["conv"]), {START: (0, "")}
                    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"lowest": None, "highest": None, "last": None}
                fits: dict[int, tuple[int, str]] = {}
                for e in b["edits"]:
                    if e["a"] in ways:
                        cost, letters = ways[e["a"]]
                        found = cost + e["cost"], letters + e["letters"]
                        if e["b"] not in fits or found < fits[e["b"]]:
                            fits[e["b"]] = found
                ways = fits
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    sums[c] += b[c]
                sums["illegal"] += sums["last"] is not None and sums["last"] + b["first"] not in ("su", "ua", "au")
                if b["lowest"] is not None:
                    sums["turns"] -= sums["highest"] == int(b["lowest"])
                    sums["lowest"] = int(b["lowest"]) if sums["lowest"] is None else sums["lowest"]
                    sums["highest"] = int(b["highest"])
                sums["last"] = b["last"]
            if out:
                yield pd.DataFrame(out)
        if key is not None:
            yield pd.DataFrame([told(key, sums, ways)])

    sorted_ = _by_conversation(cut.drop("rows", *[c.split()[0] for c in RESULT.split(", ")[-3:]]), "part", "no")
    return stored(sorted_.mapInPandas(run, "has_conv boolean, conv long, " + RESULT), "repair-chosen")


def _digests(cut: DataFrame, chosen: DataFrame) -> DataFrame:
    """Digest of every repaired conversation of several blocks: its letters first, then its blocks in order."""
    head = chosen.select("has_conv", "conv", F.lit(-1).alias("part"), F.lit(0).alias("no"), F.col("audit").alias("letters"),
                         F.lit(None).cast(cut.schema["rows"].dataType).alias("rows"))
    both = head.unionByName(cut.select("has_conv", "conv", "part", "no", F.lit(None).cast("string").alias("letters"), "rows"))

    def run(frames):
        key, applied = None, None
        for frame in frames:
            out = []
            for has_conv, conv, _, _, letters, rows in frame.itertuples(index=False, name=None):
                if letters is not None:
                    if key is not None:
                        out.append((*key, applied.sha256()))
                    key, applied = (has_conv, conv), Applied(letters)
                    continue
                for r in rows:
                    applied.row(r["role"], r["text"], r["times"])
            if out:
                yield pd.DataFrame(out, columns=["has_conv", "conv", "repaired_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, applied.sha256())], columns=["has_conv", "conv", "repaired_sha256"])

    return _by_conversation(both, "part", "no").mapInPandas(run, "has_conv boolean, conv long, repaired_sha256 string")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (NULL turns first); rows of one turn by role, then text.
    NULL roles and texts are one space (such a role fits nowhere, such a text is
    blank); a NULL conv_id is a conversation of its own.  Rows equal in
    everything are repeats, so all but one of them are duplicates.  ``gaps``
    counts the turns missing between the least and the largest (0 without any);
    ``illegal`` counts neighbouring rows whose role initials are not su, ua or
    au.  An empty table gives no rows; columns other than conv_id, turn, role
    and text are ignored.  The audit is one text: a conversation of two thousand
    million rows exceeds what a Spark value holds.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]
    cut = blocks(rows, block_rows, block_chars)
    whole, parts = cut.where("whole").select("has_conv", "conv", *names), cut.where("not whole")
    chosen = _chosen(parts)
    told = chosen.drop("repaired_sha256").join(_digests(parts, chosen), ["has_conv", "conv"])
    return whole.unionByName(told).select(F.when(F.col("has_conv"), F.col("conv")).alias("conv_id"), *names)


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="long", turn="long", role="string", text="string")
    repaired = repair(damage(rows))
    every = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows")).select(F.col("conv_id").alias("own_id"))
    out = every.join(repaired, F.col("own_id").eqNullSafe(F.col("conv_id")), "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    names = [c.split() for c in RESULT.split(", ")]
    return out.select(F.col("own_id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(empty.get(c, 0)).cast(t)).alias(c) for c, t in names])
