"""N-gram Jaccard join by chosen paths: near-duplicate texts and their classes.

Texts are sets of five-word shingles (A-Z lower-cased).  A set is embedded as
``COORDINATES`` min-hashes: two sets agree in a coordinate with probability
equal to their Jaccard similarity.

Chosen path.  A run's tree starts with all sets in one bucket.  At every node
each coordinate is chosen with probability ``1 / (threshold * COORDINATES)`` by
a hash of the node; a set goes on to the child (coordinate, its value there).
Two sets of similarity s share s / threshold children on average, so similar
pairs stay together down the tree and others part quickly.  Buckets of at most
``LEAF`` sets are searched by brute force; larger ones are split again, as long
as that helps.  A bucket that does not shrink is a dense group of similar sets
and is searched whole, in blocks.  Runs repeat until a pair at the threshold is
found with probability ``RECALL``.

Search.  In a leaf the 8-bit min-hashes of two sets estimate their similarity;
pairs that may reach the threshold (five deviations of slack) are joined into
preliminary groups, which a graph pass completes.  Inside a group every pair is
then compared exactly, on the full shingle sets, in blocks of ``BLOCK`` texts.
The results are links per text and the components of the exact links; no pair
leaves the task that found it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.components import components
from hpcstats.llm.shared import SMALL_ROWS, WORD_PATTERN, documents, shuffle_parts, stored, with_columns
from hpcstats.llm.tokens import sliced
from hpcstats.llm.wordhash import STEP, Batch, mixed

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 128
RECALL = 0.999
DEPTH = 4  # levels for which the recall is meant; pairs found higher up have more
LEAF = 200
BLOCK = 512
SEED = 77
MOST_LEVELS = 12


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold has met in a leaf of the depth with the wanted probability."""
    found = 1.0
    for _ in range(depth):
        found = 1 - math.exp(-found)
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def _multipliers() -> np.ndarray:
    return mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(SEED)) | np.uint64(1)


def _chosen(nodes: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean (node, coordinate): the coordinates chosen at each node."""
    limit = np.uint64(int(2.0 ** 64 / (threshold * COORDINATES)))
    places = mixed(np.arange(COORDINATES, dtype=np.uint64) * STEP + np.uint64(SEED))
    return mixed(nodes[:, None] ^ places[None, :]) < limit


def _children(nodes: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mixed(mixed(nodes + STEP * (coordinate.astype(np.uint64) + np.uint64(1))) ^ value.astype(np.uint64))


def shingles(batch: Batch, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles, text by text; a text of fewer than k words but some has its words as its only one."""
    hashes, at = batch.windows(k)
    owner = batch.word_doc[at]
    words = batch.words()
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(words)])
        extra = []
        for d in short:
            h = np.uint64(words[d])
            for w in batch.word_hash[first[d]:first[d] + words[d]]:
                h = h * STEP + w
            extra.append(h)
        hashes = np.concatenate([hashes, mixed(np.array(extra, dtype=np.uint64))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def signatures(docs: DataFrame, threshold: float = THRESHOLD, runs: int | None = None) -> DataFrame:
    """Stored: row, doc_id, text_hash, key1, key2 (of the word sequence), n_words, coarse (8-bit min-hashes), paths.

    ``paths`` are the first children of every run's root, made with the full 32-bit min-hashes.
    """
    roots = mixed(np.arange(1, (runs or runs_for()) + 1, dtype=np.uint64) * STEP)
    run_no, coordinate = np.nonzero(_chosen(roots, threshold))

    def run(batches):
        factors = _multipliers()
        with np.errstate(over="ignore"):
            for frame in batches:
                texts = frame["text"].tolist()
                for a, b in sliced(texts, 1_000_000):
                    batch = Batch(texts[a:b], fold=True)
                    words = batch.words()
                    hashes, owner = shingles(batch)
                    starts = np.flatnonzero(np.diff(owner, prepend=-1))
                    lows = np.zeros((batch.docs, COORDINATES), dtype=np.uint32)
                    if len(hashes):
                        for t in range(COORDINATES):
                            lows[owner[starts], t] = np.minimum.reduceat((hashes * factors[t]) >> np.uint64(32), starts)
                    firsts = np.concatenate([[0], np.cumsum(words)])
                    inside = np.arange(len(batch.word_hash)) - firsts[batch.word_doc]
                    sums = []
                    for salt in (1, 2):
                        parts = mixed(batch.word_hash + mixed(inside.astype(np.uint64) * STEP + np.uint64(salt)))
                        running = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(parts, dtype=np.uint64)])
                        sums.append(mixed(running[firsts[1:]] - running[firsts[:-1]] + words.astype(np.uint64)).view(np.int64))
                    paths = _children(roots[run_no][None, :], coordinate[None, :], lows[:, coordinate]).view(np.int64)
                    coarse = lows.astype(np.uint8)
                    yield pd.DataFrame({
                        **{c: frame[c].iloc[a:b].to_numpy() for c in ("row", "doc_id", "text_hash")}, "key1": sums[0], "key2": sums[1],
                        "n_words": words, "coarse": [c.tobytes() for c in coarse], "paths": list(paths)})

    rows = with_columns(docs, doc_id="string", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    schema = ("row long, doc_id string, text_hash long, key1 long, key2 long, n_words long, coarse binary, paths array<long>")
    return stored(rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")), "signatures")


def chosen_path_leaves(sets: DataFrame, threshold: float = THRESHOLD, leaf: int = LEAF) -> DataFrame:
    """(row, coarse, paths) to leaves of two sets or more: (node, n, row)."""
    def split(batches):
        for frame in batches:
            nodes = frame["node"].to_numpy().view(np.uint64)
            low = np.frombuffer(b"".join(frame["coarse"]), dtype=np.uint8).reshape(-1, COORDINATES)
            for at in range(0, len(frame), 4096):
                part = nodes[at:at + 4096]
                i, c = np.nonzero(_chosen(part, threshold))
                yield pd.DataFrame({"row": frame["row"].to_numpy()[at + i], "node": _children(part[i], c, low[at + i, c]).view(np.int64)})

    level = sets.select("row", F.explode("paths").alias("node"))
    coarse = sets.select("row", "coarse")
    leaves, before = None, None
    for depth in range(MOST_LEVELS):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = stored(level.join(sizes, "node").select("node", "n", "row"), f"paths{depth}")
        small, large = sized.where(F.col("n") <= leaf), sized.where(F.col("n") > leaf)
        many = large.count()
        # splitting on ends when the rows in large buckets hardly get fewer: what is left are dense groups
        dense = before is not None and many > 0.7 * before
        found = sized if dense or depth + 1 == MOST_LEVELS else small
        leaves = found if leaves is None else leaves.unionByName(found)
        if not many or dense:
            return leaves
        before = many
        level = large.select("row", "node").join(coarse, "row").mapInPandas(split, "row long, node long").distinct()
    return leaves


def _least_matches(threshold: float) -> int:
    """Equal 8-bit coordinates below which a pair can be left out: five deviations under the expectation."""
    match = threshold + (1 - threshold) / 256
    return math.floor(COORDINATES * match - 5 * math.sqrt(COORDINATES * match * (1 - match)))


def _leaf_edges(node: np.ndarray, row: np.ndarray, low: np.ndarray, least: int) -> np.ndarray:
    """Edges (row, row) of likely pairs, one star per group found, over many leaves at once.

    Small leaves compare all pairs, aligned by distance in the sorted order.
    In a large one each open set is compared with all others; pairs already in
    one group are skipped, so a dense group costs its size, not its square.
    """
    order = np.lexsort((row, node))
    node, row, low = node[order], row[order], low[order]
    starts = np.flatnonzero(np.diff(node, prepend=node[0] - 1 if len(node) else 0))
    ends = np.append(starts[1:], len(node))
    sizes = ends - starts
    out = [np.zeros((0, 2), dtype=np.int64)]
    few = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(few)
    for distance in range(1, int(sizes[sizes <= 64].max(initial=1))):
        left = at[at + distance < len(node)]
        left = left[node[left] == node[left + distance]]
        if not len(left):
            break
        for k in range(0, len(left), 65536):
            x = left[k:k + 65536]
            hits = x[(low[x] == low[x + distance]).sum(axis=1) >= least]
            out.append(np.stack([row[hits], row[hits + distance]], axis=1))
    for s, e in zip(starts[sizes > 64], ends[sizes > 64]):
        labels = np.arange(e - s)
        for i in range(e - s):
            other = np.flatnonzero(labels[i + 1:] != labels[i]) + i + 1
            if len(other):
                hits = other[(low[s + other] == low[s + i]).sum(axis=1) >= least]
                if len(hits):
                    for label in np.unique(labels[hits]):
                        out.append(np.array([[row[s + i], row[s + hits[labels[hits] == label][0]]]]))
                        labels[labels == label] = labels[i]
    return np.unique(np.concatenate(out), axis=0)


def preliminary_edges(leaves: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges (a, b) between sets that share a leaf and may reach the threshold."""
    spark, least = leaves.sparkSession, _least_matches(threshold)
    block = 8 * BLOCK
    # a leaf of more than one block is searched as pairs of blocks, each a task of its own
    blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    dealt = leaves.select("row", "node", F.explode(pairs).alias("p")).select("row", F.xxhash64("node", "p.i", "p.j").alias("node"))

    def search(batches):
        rest: list[pd.DataFrame] = []
        for frame in batches:
            # rows come sorted by node: all but the last node are complete
            last = frame["node"].iloc[-1] if len(frame) else None
            done = frame[frame["node"] != last]
            if len(done):
                yield edges([*rest, done])
                rest = [frame[frame["node"] == last]]
            else:
                rest.append(frame)
        if rest:
            yield edges(rest)

    def edges(frames):
        frame = pd.concat(frames) if len(frames) > 1 else frames[0]
        low = np.frombuffer(b"".join(frame["coarse"]), dtype=np.uint8).reshape(-1, COORDINATES)
        found = _leaf_edges(frame["node"].to_numpy(), frame["row"].to_numpy(), low, least)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    ready = dealt.join(sets.select("row", "coarse"), "row").repartition(shuffle_parts(spark), "node").sortWithinPartitions("node")
    return stored(ready.mapInPandas(search, "a long, b long").distinct(), "path-edges")


def exact_links(groups: DataFrame, docs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, grp, n) with their texts to stored rows (a, b, links): all pairs of a group compared on whole shingle sets.

    ``links`` counts, for set a, the documents (copies included) linked to it
    that the task saw; (a, b) is an edge to another set of its component, or b
    is a itself.
    """
    wanted = groups.join(sets.select("row", "doc_id", "text_hash", "copies"), "row").withColumnsRenamed({"doc_id": "id", "text_hash": "mark"})
    texts = with_columns(docs, doc_id="long", text="string").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    if wanted.count() <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("mark")))
    # groups of one block share tasks of some blocks' rows; larger ones are dealt as pairs of blocks
    blocks = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    tasks = max(1, groups.count() // BLOCK)
    task = F.when(F.col("n") <= BLOCK, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(F.xxhash64("grp", "p.i", "p.j"))
    dealt = found.select("row", "grp", "n", "copies", "text", mine.alias("block"), F.explode(pairs).alias("p")).select(
        "row", "grp", "copies", "text", "block", "p", task.alias("task"))

    def compare(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in frame.groupby(["grp", "i", "j"]):
            part = part.drop_duplicates("row")
            sides = [part[part["block"] == part["i"].iloc[0]], part[part["block"] == part["j"].iloc[0]]]
            out.append(_exact_part(sides[0], sides[1] if part["i"].iloc[0] != part["j"].iloc[0] else None, threshold))
        return pd.concat(out)

    flat = dealt.select("task", "row", "grp", "copies", "text", "block", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
    return stored(flat.groupBy("task").applyInPandas(compare, "a long, b long, links long"), "links")


def _sets(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (owner, shingle) of the texts."""
    texts = frame["text"].fillna("").tolist()
    hashes, owners = [], []
    for a, b in sliced(texts, 2_000_000):
        h, o = shingles(Batch(texts[a:b], fold=True))
        hashes.append(h)
        owners.append(o + a)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return o[first], h[first]


def _exact_part(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Links among the texts of ``left``, or between left and right."""
    same = right is None
    right = left if same else right
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": [], "links": []}, dtype="int64")
    (lo, lh) = _sets(left)
    (ro, rh) = (lo, lh) if same else _sets(right)
    sizes = np.bincount(lo, minlength=len(left)), np.bincount(ro, minlength=len(right))
    # only shingles that two texts have can add to an intersection
    values, counts = np.unique(lh if same else np.concatenate([np.unique(lh), np.unique(rh)]), return_counts=True)
    values = values[counts > 1]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    lat, rat = np.searchsorted(values, lh), np.searchsorted(values, rh)
    lin = (lat < len(values)) & (values[np.minimum(lat, max(len(values) - 1, 0))] == lh) if len(values) else np.zeros(len(lh), dtype=bool)
    rin = (rat < len(values)) & (values[np.minimum(rat, max(len(values) - 1, 0))] == rh) if len(values) else np.zeros(len(rh), dtype=bool)
    for c in range(0, len(values), 8192):
        x, y = (np.zeros((n, min(8192, len(values) - c)), dtype=np.float32) for n in (len(left), len(right)))
        p, q = lin & (lat >= c) & (lat < c + 8192), rin & (rat >= c) & (rat < c + 8192)
        x[lo[p], lat[p] - c] = 1
        y[ro[q], rat[q] - c] = 1
        both += x @ y.T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    linked = (both >= threshold * union - 1e-9) & (union > 0)
    if same:
        np.fill_diagonal(linked, False)
    a, b = left["row"].to_numpy(), right["row"].to_numpy()
    copies = left["copies"].to_numpy(), right["copies"].to_numpy()
    ids = a if same else np.concatenate([a, b])
    root = ids[_groups(linked, same)]
    links = (linked * copies[1][None, :]).sum(axis=1)
    if not same:
        links = np.concatenate([links, (linked * copies[0][:, None]).sum(axis=0)])
    return pd.DataFrame({"a": ids, "b": root, "links": links})


def _groups(linked: np.ndarray, same: bool) -> np.ndarray:
    """For every text (left, then right if it is another block) a text of its component of the links."""
    shift = 0 if same else linked.shape[0]
    label = np.arange(shift + linked.shape[1])
    for x in np.flatnonzero(linked.any(axis=1)):
        others = label[np.flatnonzero(linked[x]) + shift]
        if (others != label[x]).any():
            label[np.isin(label, others)] = label[x]
    return label


def _texts_classified(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and per different text (key1, key2): copies, least_id, root (of its class), n_links."""
    sigs = signatures(docs, threshold, runs_for(recall))
    worded = sigs.where("n_words > 0")
    texts = stored(worded.groupBy("key1", "key2").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"),
                                                      F.count(F.lit(1)).alias("copies")), "texts")
    sets = stored(sigs.select("row", "doc_id", "text_hash", "coarse", "paths").join(texts.select("row", "copies"), "row"), "sets")
    edges = preliminary_edges(chosen_path_leaves(sets, threshold), sets, threshold)
    rough = components(edges)
    sizes = rough.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    groups = stored(rough.join(sizes, "root").select(F.col("node").alias("row"), F.col("root").alias("grp"), "n"), "groups")
    links = exact_links(groups, docs, sets, threshold)
    classes = components(links.select("a", "b"))
    counted = links.groupBy("a").agg(F.sum("links").alias("links"))
    # per text: its class (the least row stands for it) and links
    known = (texts.join(classes.withColumnRenamed("node", "row"), "row", "left")
             .join(counted.withColumnRenamed("a", "row"), "row", "left")
             .select("key1", "key2", "copies", "least_id", F.coalesce("root", "row").alias("root"),
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return sigs, known


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, class_size.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``threshold``; a class is a component of the links,
    named by its least doc_id (NULL if it has none).  ``n_links`` counts the
    other documents linked to this one, exact copies included.  A text of one
    to four words is its own single shingle; NULL, empty and wordless texts
    have no shingle, no link and a class of their own.  Repeated rows count as
    copies; an empty table gives no rows; columns other than doc_id and text
    are ignored.
    """
    sigs, known = _texts_classified(docs, threshold, recall)
    worded = sigs.where("n_words > 0")
    named = known.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    answer = stored(known.join(named, "root").select("key1", "key2", "class_id", "class_size", "n_links"), "classes")
    out = worded.select("doc_id", "key1", "key2").join(answer, ["key1", "key2"]).select("doc_id", "class_id", "n_links", "class_size")
    alone = sigs.where("n_words = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                                             F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone)


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names: one row per class of near duplicates.

    It is the row with the smallest doc_id (NULL ids after all others), then
    the smallest text hash; of rows equal in both, any one stays.  Rows that
    share an id but not a class are judged apart.  Texts without words have no
    class and stay, all of them.  An empty table gives no rows.
    """
    sigs, known = _texts_classified(docs, threshold, recall)
    # per text first, so that a text which many rows hold is one row in the join
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = sigs.where("n_words > 0").groupBy("key1", "key2").agg(F.min(place).alias("first"))
    winners = first.join(known.select("key1", "key2", "root"), ["key1", "key2"]).groupBy("root").agg(F.min("first").alias("first"))
    key = lambda c: [F.coalesce(c["doc_id"], F.lit(0)).alias("id"), c["doc_id"].isNull().alias("none"), c["text_hash"].alias("text_hash")]
    kept = stored(winners.select(*key({c: F.col(f"first.{c}") for c in ("doc_id", "text_hash")})), "near-kept")
    column = lambda c, t: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t)
    text = F.coalesce(column("text", "string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), *key({"doc_id": column("doc_id", "long"), "text_hash": F.xxhash64(text)}),
                       F.regexp_like(text, F.lit(WORD_PATTERN)).alias("worded"))
    names = ["id", "none", "text_hash"]
    one = rows.where("worded").join(kept, names, "left_semi").dropDuplicates(names)
    return one.unionByName(rows.where("not worded")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
