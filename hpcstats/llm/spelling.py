"""Spelling variants: words one edit apart, by a dictionary of pairs of trie nodes.

Every prefix of a word is a node of a trie, every suffix a node of the trie of
reversed words, and nodes have numbers.  A word without its i-th code point is
the pair (prefix node before it, suffix node behind it); a word cut at i is the
pair (prefix node, suffix node) with nothing left out.  Two words differ by one
replaced code point if they share a pair with one left out; by an inserted one if
the longer's pair with one left out is a pair of the shorter with none.  The
numbers are exact, so a join on them gives the neighbours and nothing else.

A pair is shared by at most one cut word and one word per letter of the
alphabet, whatever the corpus, so no group of the join grows.  A word may lose
any of several equal code points in a row and give the same shorter word: only
the last of them counts, so each neighbour is met once.

Nodes are numbered without building a trie in one place: words are sorted over
ranges, a word makes nodes for the prefixes that it does not share with the word
before it, and a range's numbers start where those of the range before it end.
The driver sees one row per range (its first word and the nodes of its last),
which also tells what prefixes reach over a range's border.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import documents, shuffle_parts, stored, with_columns

RUN = re.compile(rb"[a-z\xc0-\xff]+")  # of latin-1 bytes, A-Z lower-cased
DAMAGE = 199
MIN_CHARS = 6
MIN_COUNT = 5
FACTOR = 5          # a form has at least so many times its variant's occurrences
MOST_COUNTED = 400_000


def damaged_runs(text: str, prefix: int) -> Counter:
    """Runs of letters of a text (as latin-1) after damage; ``prefix``: crc32 of what stands before the run."""
    runs = Counter(RUN.findall(text.encode("latin-1", "replace").lower()))  # bytes.lower: A-Z only
    hit = [(r, h % len(r)) for r in runs if (h := zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), prefix)) % DAMAGE == 0]
    # all are taken out before any is put back: what one becomes may be another that is hit
    for run, at, n in [(run, at, runs.pop(run)) for run, at in hit]:
        runs[run[:at] + run[at + 1:]] += n
    return runs


def count_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of all documents, damaged, that are long and frequent enough; counted per task first."""
    rows = with_columns(docs, doc_id="string", text="string").select(F.coalesce("doc_id", F.lit("")).alias("doc_id"),
                                                                     F.coalesce("text", F.lit("")).alias("text"))

    def told(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())})

    def run(frames):
        total: Counter = Counter()
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                for word, n in damaged_runs(text, zlib.crc32(f"{doc_id}:".encode())).items():
                    if len(word) >= min_chars:
                        total[word] += n
                if len(total) > MOST_COUNTED:
                    yield told(total)
                    total.clear()
        if total:
            yield told(total)

    counted = rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= min_count), "spell-words")


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def number_nodes(rows: DataFrame, key: str, nodes: str, label: str) -> DataFrame:
    """Add ``nodes`` (numbers of the trie nodes of all beginnings of ``key``, the empty one is 0) and ``rank`` (place in order).

    ``key`` must not repeat.  Equal beginnings have one number, wherever their
    words lie; numbers start at 1 and rise by ranges.
    """
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), key).sortWithinPartitions(key)
    names = rows.columns

    def number(frames):
        part, made, path, before, place = TaskContext.get().partitionId(), 0, [], "", 0
        for frame in frames:
            paths = []
            for word in frame[key]:
                same = _shared(before, word)
                path = path[:same] + list(range(made, made + len(word) - same))
                made += len(word) - same
                before = word
                paths.append(path)
            yield frame.assign(part=part, place=np.arange(place, place + len(frame)), path=paths)
            place += len(frame)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = stored(dealt.mapInPandas(number, f"{kinds}, part int, place long, path array<long>"), label)
    # one row per range: how many words and nodes it has, its first word, its last word and that word's nodes
    of = lambda f, c: f(F.col(c), F.col("place"))
    ranges = local.groupBy("part").agg(F.count(F.lit(1)).alias("words"), F.max(F.array_max("path")).alias("top"), of(F.min_by, key).alias("first"),
                                       of(F.max_by, key).alias("last"), of(F.max_by, "path").alias("path")).orderBy("part").collect()
    starts, known, node, words, last, end = {}, {}, 1, 0, "", []
    for r in ranges:
        same = _shared(last, r["first"])
        starts[r["part"]] = node, words
        # the first word's beginnings that earlier ranges have numbered; its nodes are the range's first
        known[r["part"]] = end[:same]
        end = [end[x] if x < same else node + x for x in r["path"]]
        last, node, words = r["last"], node + r["top"] + 1, words + r["words"]

    def resolve(frames):
        for frame in frames:
            paths, ranks = [], []
            for part, place, path in zip(frame["part"], frame["place"], frame["path"]):
                (node, words), earlier = starts[part], known[part]
                given = path + node
                for i in range(min(len(earlier), len(path))):
                    if path[i] < len(earlier):
                        given[i] = earlier[path[i]]
                paths.append(np.concatenate([[0], given]))
                ranks.append(words + place)
            yield frame[names].assign(rank=ranks, **{nodes: paths})

    return local.mapInPandas(resolve, f"{kinds}, rank long, `{nodes}` array<long>")


def node_pairs(ahead: DataFrame) -> DataFrame:
    """(id, word, n, ahead: prefix nodes) to (p, s, kind, id, n): pairs of every word with one code point left out (kind 0;
    1 if it is the last of a row of equal ones) and with none (kind 2)."""
    turned = ahead.select("id", "n", "ahead", F.reverse("word").alias("turned"))
    both = number_nodes(turned, "turned", "behind", "spell-behind")

    def run(frames):
        for frame in frames:
            sizes = frame["turned"].str.len().to_numpy()
            for at in range(0, len(frame), 20_000):
                part, size = frame.iloc[at:at + 20_000], sizes[at:at + 20_000]
                ahead, behind = np.concatenate(part["ahead"].tolist()), np.concatenate(part["behind"].tolist())
                chars = np.frombuffer("".join(part["turned"]).encode("utf-32-le"), dtype="<u4")
                ids, n = part["id"].to_numpy(), part["n"].to_numpy()
                # place of each word's nodes (size + 1 of them) and code points (size) in the flat arrays
                node0, char0 = np.cumsum(size + 1) - (size + 1), np.cumsum(size) - size
                w = np.repeat(np.arange(len(part)), size)
                i = np.arange(len(w)) - char0[w]
                # code point i of the word is code point size - 1 - i of the turned one
                here = char0[w] + size[w] - 1 - i
                final = (i == size[w] - 1) | (chars[here] != chars[np.maximum(here - 1, 0)])
                yield pd.DataFrame({"p": ahead[node0[w] + i], "s": behind[node0[w] + size[w] - 1 - i], "kind": final.astype(np.int8),
                                    "id": ids[w], "n": n[w]})
                w = np.repeat(np.arange(len(part)), size + 1)
                i = np.arange(len(w)) - node0[w]
                yield pd.DataFrame({"p": ahead, "s": behind[node0[w] + size[w] - i], "kind": np.full(len(w), 2, dtype=np.int8),
                                    "id": ids[w], "n": n[w]})

    return both.select("id", "n", "ahead", "turned", "behind").mapInPandas(run, "p long, s long, kind byte, id long, n long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """Per word that has any: id, n_near and best (n, -id) of its near words."""
    member = F.struct("n", "id", "kind")
    groups = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("members")).where("size(members) > 1")
    near = F.expr("""explode(transform(members, m -> named_struct('id', m.id, 'near',
        transform(filter(members, o -> (m.kind < 2 and o.kind < 2 and m.id <> o.id) or (m.kind = 1 and o.kind = 2) or (m.kind = 2 and o.kind = 1)),
                  o -> named_struct('n', o.n, 'order', -o.id)))))""")
    found = groups.select(near.alias("x")).select("x.id", F.size("x.near").alias("many"), F.array_max("x.near").alias("best")).where("many > 0")
    return found.groupBy("id").agg(F.sum("many").alias("n_near"), F.max("best").alias("best"))


def spelling_forms(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n) to word, form, root, n, n_near, form_n.

    ``words`` must not repeat.  Near words differ by one inserted, deleted or
    replaced code point; the form is the near word of largest n (ties: the
    smallest in code-point order) if that n is at least ``factor`` times the
    word's own; the root is the last on the way over forms.  As every step
    multiplies n by ``factor`` (2 or more), the way is short; words are resolved from the
    roots on, so no join key has more rows than a word has neighbours.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    # a word's id is its place in code-point order
    ahead = number_nodes(words.select("word", "n"), "word", "ahead", "spell-ahead").withColumnRenamed("rank", "id")
    found = neighbours(node_pairs(ahead))
    known = stored(ahead.drop("ahead").join(found, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.order")).alias("form_id")), "spell-near")
    forms = known.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    known = stored(known.join(forms, "form_id", "left"), "spell-forms")
    done = known.where("form_id is null").withColumn("root", F.col("word"))
    last, left = done, known.where("form_id is not null")
    while not left.isEmpty():
        roots = last.select(F.col("id").alias("form_id"), "root")
        step = stored(left.join(roots, "form_id", "left"), "spell-roots")
        last, left = step.where("root is not null"), step.where("root is null").drop("root")
        done = done.unionByName(last)
    return done.select("word", "form", "root", "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """NULL and empty texts have no words, a NULL doc_id is written as nothing before the colon; repeated rows count
    again; an empty table gives no rows; columns other than doc_id and text are ignored."""
    return spelling_forms(count_words(documents(spark, sf_dir)))


# crc32 bit by bit: a byte is taken in, then eight (-1) steps of one bit each
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM r),
b AS (SELECT run, n, list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(bytes), 2), lambda k:
        [('0x' || substr(bytes, k, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS steps FROM x),
h AS (SELECT run, n, xor(list_reduce(steps, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
        4294967295::BIGINT) AS h FROM b),
w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
skips AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (SELECT s.word, t.word AS other, t.n FROM skips s JOIN skips t ON s.i = t.i AND s.a = t.a AND s.b = t.b AND s.word <> t.word
         UNION SELECT s.word, t.word, t.n FROM skips s JOIN words t ON s.a || s.b = t.word
         UNION SELECT t.word, s.word, s.n FROM skips s JOIN words t ON s.a || s.b = t.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * words.n THEN other END AS form,
        CASE WHEN other_n >= {FACTOR} * words.n THEN other_n END AS form_n FROM words LEFT JOIN best ON words.word = best.word),
ways AS (SELECT word, word AS root FROM forms WHERE form IS NULL UNION ALL SELECT f.word, ways.root FROM forms f JOIN ways ON f.form = ways.word)
SELECT f.word, f.form, ways.root, f.n, f.n_near, f.form_n FROM forms f JOIN ways ON f.word = ways.word
"""
