"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every partition of the digest table is a *run*: its rows reduced to one entry
per digest, sorted by digest, with the chosen identifier and the count.  Runs
merge in rounds: in each round the runs whose numbers agree but for the lowest
``log2(fan_in)`` bits exchange their entries and are merged into one, so that
after ``ceil(log(runs, fan_in))`` rounds (a binomial tree for fan-in 2) one
sorted run covers the table.  An exchange is hashed on (run, digest): a merged
run is spread over the cluster, and no task holds it whole.

The way back goes down the same tree: the final entry of a digest is handed to
the at most ``fan_in`` entries it was merged from, until each first run knows
the answers for its own rows.  No join key ever has more than ``fan_in``
matches above the first runs, so a text that makes up a third of all rows costs
no more than any other.

An entry is *verified* at every level: entries merge only if digest, byte
length and a second, unrelated 64-bit hash agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import documents, fold_case, stored, with_columns

FAN_IN = 16
KEY = ["digest", "n_bytes", "check"]


def digest_runs(docs: DataFrame) -> DataFrame:
    """Digest table: doc_id, row, digest, n_bytes, check, run (stored, so that runs and row numbers stay as they are)."""
    text = fold_case(F.coalesce(F.col("text"), F.lit("")))
    table = with_columns(docs, doc_id="long", text="string").select("doc_id", text.alias("t")).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("check"),
        F.spark_partition_id().cast("long").alias("run"))
    return stored(table, "digests")


def merge_runs(table: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> list[DataFrame]:
    """All levels of the tree: entries (run, key, best, rows), from the first runs up to the single last one."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    # a missing id never wins; the row number decides between rows repeated with the same id
    missing = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    first = table.select("run", *KEY, F.struct(missing.alias("rank"), "doc_id", "row").alias("best"), F.lit(1).cast("long").alias("rows"))
    top = table.select(F.max("run")).first()[0] or 0
    levels: list[DataFrame] = []
    while True:
        merged = first.groupBy("run", *KEY).agg(pick("best").alias("best"), F.sum("rows").alias("rows"))
        levels.append(stored(merged.sortWithinPartitions("run", "digest"), f"runs{len(levels)}"))
        if top == 0:
            return levels
        top //= fan_in
        first = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))


def exact_groups(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as the
    empty text, and all empty texts form one group.  ``keep_id`` is the largest
    (or smallest) doc_id of the group; a NULL id never wins over another one.
    Repeated rows count as copies, and of rows that share the kept id exactly
    one is ``kept``.  An empty table gives no rows.  Columns other than doc_id
    and text are ignored.
    """
    table = digest_runs(docs)
    levels = merge_runs(table, keep, fan_in)
    answer = levels[-1]
    for below in reversed(levels[:-1]):
        up = answer.select(F.col("run").alias("run_up"), *KEY, "best", "rows")
        answer = (below.select("run", *KEY, F.floor(F.col("run") / fan_in).cast("long").alias("run_up"))
                  .join(up, ["run_up", *KEY]).select("run", *KEY, "best", "rows"))
    return table.join(answer, ["run", *KEY]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names: one per group of equal texts.

    Rows are told apart by doc_id and text; of rows equal in both, any one stays
    (they may differ in other columns).  NULL texts are empty texts, a NULL id
    loses against any other; an empty table gives no rows.
    """
    own = with_columns(docs, doc_id="long", text="string").columns
    column = lambda c, t: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t)
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing")]
    kept = exact_groups(docs, keep, fan_in).where("kept").select(*key, F.col("text_sha256").alias("sha"))
    found = docs.select(F.struct("*").alias("row"), *[column(c, t).alias(c) for c, t in zip(own, ("long", "string"))])
    found = found.select("row", *key, F.sha2(fold_case(F.coalesce("text", F.lit(""))), 256).alias("sha"))
    names = ["id", "missing", "sha"]
    return found.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), s AS (SELECT doc_id, sha256(t) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256)
"""
