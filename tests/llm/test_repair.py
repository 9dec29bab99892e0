"""Conversation repair by branch-and-bound against plain searches."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from hpcstats.llm.repair import STATES, cheapest, damage, query, repair, table
from llm_helpers import SF

SPACE = " \t\n\v\f\r"
PATTERN = re.compile(r"(s?(ua)+)?")


def every_way(rows, inserts=3):
    """All edits of a few rows: (cost, audit, repaired), by the pattern alone."""
    def step(i, cost, audit, said, left):
        if i == len(rows) and PATTERN.fullmatch("".join(r[:1] or "?" for r, _ in said)):
            yield cost, audit, said
        if left:
            for role in ("user", "assistant"):
                yield from step(i, cost + 2, audit + "I", [*said, (role, "")], left - 1)
        if i < len(rows):
            role, text, must, cut = rows[i]
            yield from step(i + 1, cost + 3, audit + "D", said, left)
            if not must:
                yield from step(i + 1, cost + cut, audit + "K", [*said, (role, text)], left)
                for new in ("user", "assistant"):
                    yield from step(i + 1, cost + cut + 2, audit + "R", [*said, (new, text)], left)
    return min(step(0, 0, "", [], inserts), key=lambda w: w[:2])


def nearest(rows):
    """The same for more rows: prefixes in the order of (cost, audit), so the first to reach a node is its best."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, said
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for role in ("user", "assistant"):
            if role[0] in fits:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*said, (role, ""))))
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, said))
            if not must:
                if role[:1] and role[:1] in fits:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role[0], (*said, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in fits:
                        heapq.heappush(heap, (cost + cut + 2, audit + "R", i + 1, new[0], (*said, (new, text))))


def expected(rows, search=nearest):
    """Result of one conversation's rows (turn, role, text), without damage."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, items = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        items.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = search(items)
    text = "\n".join(f"{r}:{t}" for r, t in said)
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    """{conv_id: rows after damage}, of (conv_id, turn, role, text)."""
    out = {}
    say = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = say(role), say(text)
        kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def results(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def random_rows(rng, convs, most):
    texts = ["Fine.", "Well!", "cut off", " ", "", "Other one?", "no end \n"]
    return [(c, rng.choice([None, *range(most + 2)]), rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]), rng.choice(texts))
            for c in range(convs) for _ in range(rng.randint(1, most))]


def test_search_equals_trying_everything():
    rng = random.Random(5)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool"]), "t", rng.random() < 0.25, int(rng.random() < 0.4)) for _ in range(rng.randint(0, 4))]
        found = cheapest([(must, role[:1], cut, 1) for role, _, must, cut in rows])
        assert found == every_way(rows)[:2] == nearest(rows)[:2], rows


def test_blocks_combine_to_the_whole():
    """Edits of two parts from every state to every other hold the best edits of both together."""
    rng = random.Random(6)
    for _ in range(100):
        rows = [(rng.random() < 0.2, rng.choice("uast"), int(rng.random() < 0.3), rng.choice([1, 1, 2])) for _ in range(8)]
        rows = [(must, i, 0 if must else cut, times if must else 1) for must, i, cut, times in rows]
        one, two = table(rows[:3]), table(rows[3:])
        both = min((one[0, m][0] + two[m, e][0], one[0, m][1] + two[m, e][1]) for m in STATES for e in (0, 3) if (0, m) in one and (m, e) in two)
        assert both == cheapest(rows)


@pytest.mark.parametrize("block_rows", [1, 3, 256])
def test_equals_plain_search(spark, block_rows):
    rows = random_rows(random.Random(7), 60, 9)
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "cut"), (77, None, None, None)]
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    got = results(repair(spark.createDataFrame(rows, SCHEMA), block_rows))
    assert got == {c: expected(r) for c, r in by.items()}


def test_damage(spark):
    rows = random_rows(random.Random(8), 120, 6) + [(None, None, None, None), (None, 3, "user", "x!")]
    frame = damage(spark.createDataFrame(rows, SCHEMA))
    got = sorted(map(tuple, frame.collect()), key=repr)
    assert got == sorted([(c, *r) for c, kept in damaged(rows).items() for r in kept], key=repr)


def test_query_on_the_shared_table(spark):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    got = results(query(spark, SF))
    assert got == {c: expected(kept) for c, kept in damaged(rows).items()}
    assert len(got) == len({r[0] for r in rows}) and any(g[5] for g in got.values())


def test_one_conversation_with_most_rows(spark):
    """Long, with repeats and long texts: many blocks over several tasks."""
    rng = random.Random(9)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "word " * rng.randint(1, 400), f"Number {t}."])) for t in range(1500)]
    rows += [(2, 0, "user", "Hello there."), (2, 1, "assistant", "x" * 3_000_000)] + [(3, 0, "user", "the same.")] * 400
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(tuple(r))
    got = results(repair(spark.createDataFrame(rows, SCHEMA), block_rows=50))
    assert got == {c: expected(r) for c, r in by.items()}


def test_empty_and_clashing_names(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yes.", 6, "y")], SCHEMA + ", part int, rows string")
    assert results(repair(wide)) == {1: expected([(0, "user", "Hi."), (1, "assistant", "Yes.")])}
