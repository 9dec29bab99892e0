"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

A document of a source whose target is ``f`` times its size is taken ``f``
times in expectation: ``floor(f)`` copies are certain, the fraction is a
probability.  Rounding every document on its own would let the mix drift from
its target, so the fractions of a source are rounded *dependently*: two
documents move mass (words) between each other, by random amounts that keep
both expectations, until one of them is a whole copy.  The other one goes on to
the next pairing.  Every move keeps the words of the source as they are, so a
source misses its target by at most half of its last open document.

The pairings form a reduction tree.  A level deals the open documents of a
source into nodes of about ``NODE`` members by a hash of the document, folds
every node with ``aggregate`` and hands its one remainder to the next level; a
source that holds a third of all rows only has more nodes.  All random numbers
are hashes of document ids and the seed, so a rerun or a recomputed task gives
the same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.llm.shared import WORD_PATTERN, documents, stored, with_columns

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
NODE = 32
EPS = 1e-9
SEED = 20260


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source, docs, source_size, target.

    Sources in code point order, NULL last, get the weights in turn.  The words
    of the mix (``share`` of all) are dealt by weight; no source gets more than
    ``most`` times its size, and what it cannot take goes to the others by
    weight.  The level of the open sources is found in one pass: ordered by
    capacity for their weight, a source is full as long as an even deal of what
    is left among it and all later ones would exceed its capacity.
    """
    by_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    table = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    table = table.withColumn("total", share * F.sum("source_size").over(every)) \
        .withColumn("level", (F.col("total") - before) / ahead)
    table = table.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # the first open source of the order fixes the level of all open ones; its level is the largest of theirs
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    return table.select("source", "docs", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _uniform(*parts) -> str:
    """SQL of a number in [0, 1) that depends on the parts only."""
    return f"(pmod(xxhash64({', '.join(map(str, parts))}), 9007199254740992) / 9007199254740992.0D)"


def _fold(level: int, seed: int) -> str:
    """SQL of a node's fold: state (open, done); the open document meets the next one, one of the two comes out whole.

    ``up`` words can move from the next document to the open one, ``down`` the
    other way, until one of them reaches 0 or 1; up is chosen with probability
    down / (up + down), which keeps both expectations.
    """
    u = _uniform("s.open.uid", "e.uid", level, seed)
    moved = f"""
      transform(array(named_struct(
          'up', least((1 - s.open.x) * s.open.size, e.x * e.size),
          'down', least(s.open.x * s.open.size, (1 - e.x) * e.size))), m ->
        if({u} * (m.up + m.down) < m.down, m.up, -m.down))[0]"""
    pair = f"""
      transform(array({moved}), d -> named_struct(
          'a', named_struct('uid', s.open.uid, 'size', s.open.size, 'x', s.open.x + d / s.open.size),
          'b', named_struct('uid', e.uid, 'size', e.size, 'x', e.x - d / e.size)))[0]"""
    whole = lambda x: f"({x} <= {EPS}D or {x} >= 1 - {EPS}D)"
    none = "cast(null as struct<uid:bigint,size:bigint,x:double>)"
    return f"""
      aggregate(slice(items, 2, greatest(size(items) - 1, 0)),
        named_struct('open', items[0], 'done', cast(array() as array<struct<uid:bigint,size:bigint,x:double>>)),
        (s, e) -> if(s.open is null, named_struct('open', e, 'done', s.done),
          transform(array({pair}), p -> named_struct(
            'open', case when {whole('p.a.x')} and {whole('p.b.x')} then {none}
                         when {whole('p.a.x')} then p.b else p.a end,
            'done', concat(s.done, filter(array(p.a, p.b), q -> {whole('q.x')}))))[0]))"""


def round_copies(items: DataFrame, node: int = NODE, seed: int = SEED) -> DataFrame:
    """(group, uid, size, x) with 0 < x < 1 and size > 0 to (uid, whole): 0 or 1 for every uid.

    E[whole] = x but for the one remainder of a group, which takes the nearer
    whole number; the sum of size * whole over a group differs from that of
    size * x by at most half a size.
    """
    counts = items.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "mix-counts")
    open_items = items.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, "grp")
    most = counts.select(F.max("n")).first()[0] or 0
    done = None
    level = 0
    while most > 0:
        nodes = F.ceil(F.col("n") / node)
        dealt = open_items.withColumn("node", F.pmod(F.xxhash64("uid", F.lit(seed + level)), nodes))
        folded = (dealt.groupBy("grp", "n", "node")
                  .agg(F.expr("sort_array(collect_list(struct(size, x, uid)), false)").alias("sorted"))
                  .withColumn("items", F.expr("transform(sorted, i -> named_struct('uid', i.uid, 'size', i.size, 'x', i.x))"))
                  .withColumn("state", F.expr(_fold(level, seed)))
                  .select("grp", F.ceil(F.col("n") / node).alias("n"), "state"))
        folded = stored(folded, f"mix-level{level}")
        rounds = folded.select(F.explode("state.done").alias("d")).select("d.uid", F.round("d.x").cast("int").alias("whole"))
        rest = folded.where("state.open is not null").select("grp", "state.open.uid", "state.open.size", "state.open.x", "n")
        last = most <= node
        if last:  # one remainder per group: the nearer whole number misses the target least
            rounds = rounds.unionByName(rest.select("uid", (F.col("x") >= 0.5).cast("int").alias("whole")))
        done = rounds if done is None else done.unionByName(rounds)
        open_items, most, level = rest, 0 if last else -(-most // node), level + 1
    return done if done is not None else items.select("uid", F.lit(0).alias("whole")).limit(0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, node: int = NODE,
        seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (= size * copies).

    ``size`` counts words (NULL text: 0).  A document without words is never
    taken; a source without words has the target 0.  NULL sources form one
    source, the last.  Rows repeated with the same doc_id, source and size are
    rounded as documents of their own.  An empty table gives no rows.
    """
    rows = with_columns(docs, doc_id="long", text="string", source="string")
    words = F.coalesce(F.expr(f"regexp_count(text, '{_sql_pattern()}')"), F.lit(0)).cast("long")
    sizes = rows.select("doc_id", "source", words.alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy_no"))
    # a document's identity is its content, not its place: reruns deal it alike
    uid = F.xxhash64("doc_id", "source", "size", "copy_no")
    sizes = stored(sizes.withColumn("uid", uid), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, most).withColumn("grp", F.xxhash64("source")), "mix-targets")
    few = targets.count() <= 100_000
    # source is the join key and may hold a third of the rows: broadcast the checked small table, else spread by a salt
    if few:
        joined = sizes.join(F.broadcast(targets), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumnRenamed("source", "s2")
        joined = sizes.withColumn("salt", F.pmod("uid", F.lit(32)).cast("int")).join(
            salted, F.col("source").eqNullSafe(F.col("s2")) & (salted["salt"] == F.pmod("uid", F.lit(32)).cast("int"))).drop("s2", "salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.floor(rate + EPS)
    part = F.greatest(rate - near, F.lit(0.0))
    joined = joined.withColumn("sure", F.when(F.col("size") > 0, near).otherwise(0)).withColumn(
        "x", F.when((F.col("size") > 0) & (part > EPS), part).otherwise(0.0))
    open_docs = joined.where("x > 0").select("grp", "uid", "size", "x")
    whole = round_copies(open_docs, node, seed)
    out = joined.join(whole, "uid", "left").withColumn("copies", (F.col("sure") + F.coalesce("whole", F.lit(0))).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).alias("taken"))


def _sql_pattern() -> str:
    return WORD_PATTERN.replace("\\", "\\\\")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns whatever their names.

    Rows that agree in doc_id, source and size share their copies evenly, the
    first ones in the order of their text's hash taking what is left over.
    Documents without words are not taken; an empty table gives no rows.
    """
    keys = ["id", "none", "of", "nowhere", "size"]
    key = lambda size: [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"),
                        F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("nowhere"), size.alias("size")]
    taken = mix(docs, **options).select(*key(F.col("size")), "copies")
    # rows repeated with one identity share their copies: so many rows, each taken copies / rows times, remainders first
    taken = taken.groupBy(*keys).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    words = F.coalesce(F.expr(f"regexp_count(text, '{_sql_pattern()}')"), F.lit(0)).cast("long")
    column = lambda c, t: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t).alias(c)
    own = docs.select(F.struct("*").alias("row"), column("doc_id", "long"), column("text", "string"), column("source", "string"))
    own = own.select("row", F.xxhash64("text").alias("hash"), *key(words))
    number = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).otherwise(1)
    joined = own.join(taken.where("copies > 0"), keys).withColumn("number", number)
    times = F.floor((F.col("copies") + F.col("rows") - F.col("number")) / F.col("rows")).cast("int")
    return joined.withColumn("times", times).where("times > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
