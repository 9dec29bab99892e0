"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

An index knows which documents hold which lines.  It consists of Parquet
tables in a folder, a new set for every change, so a lost executor or an
interrupted job leaves the last complete version as it was:

* ``refs``: one row per document and different key (``MIN_CHARS`` code points
  and more), appended by every insertion; ``gone``: the documents deleted;
* ``counts``: the exact reference count of every key;
* ``filters``: per shard (a range of key hashes) a cuckoo filter of the
  *shared* keys, those that at least ``min_docs`` documents hold.

Inserting documents adds to the counts; keys that reach ``min_docs`` enter
their shard's filter.  Deleting documents takes their references away; keys
that fall below ``min_docs`` leave it.  The exact counts say which, so a filter
never loses a key that is shared, and an index after a deletion equals one that
never had the documents.  A shard whose filter has no room is built anew from
the counts; when shards hold too many keys, all are, over more shards.

To find the lines to drop, references pass by their shard's filter, sorted so
that a task holds one filter at a time; only those that it lets pass (the shared
ones and a few of ten thousand others) meet the exact counts.  Shards with many references are
dealt over several tasks, each with a copy of the filter.
"""

from __future__ import annotations


import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.llm.cuckoo import Cuckoo
from hpcstats.llm.shared import documents, join_weighted, scratch_path, shuffle_parts, stored

MIN_DOCS = 3
MIN_CHARS = 20
SPACE = " \t\n\v\f\r"
SHARD_KEYS = 32_768       # shared keys a shard is planned for
SHARD_REFS = 500_000      # references that one copy of a shard's filter looks at
MAX_BITS = 16
DOC = ["has_id", "id", "t1", "t2"]
ROOM = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line without white space at its ends and with A-Z lower-cased; None if it is too short."""
    bare = line.strip(SPACE)
    if len(bare) < min_chars:
        return None
    return xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` as row (all columns) with the document's identity: its id (NULL below all others) and its text's hash."""
    own = lambda c, t: (F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(t)
    text = F.coalesce(own("text", "string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), own("doc_id", "long").isNotNull().alias("has_id"),
                       F.coalesce(own("doc_id", "long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("t1"),
                       F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row (DOC, place, key) per document and different key; rows equal in id and text are one document."""
    rows = identified(docs).select(*DOC, "text", F.monotonically_increasing_id().alias("stored_row"))

    def run(frames):
        for frame in frames:
            keys = [list({k: 1 for line in t.split("\n") if (k := line_key(line, min_chars))}) for t in frame.pop("text")]
            frame["key"] = keys
            frame = frame.explode("key").dropna(subset=["key"])
            frame["place"] = [k[0] << 8 | k[1] for k in frame["key"]]
            yield frame

    refs = stored(rows.mapInPandas(run, "has_id boolean, id long, t1 long, t2 long, stored_row long, key binary, place int"), "line-refs")
    repeats = stored(refs.groupBy(*DOC).agg(F.min("stored_row").alias("first"), F.max("stored_row").alias("last"))
                     .where("first < last").drop("last"), "line-repeats")
    if not repeats.isEmpty():
        refs = refs.join(repeats, DOC, "left").where("first is null or first = stored_row").drop("first")
    return refs.drop("stored_row")


class LineIndex:
    """Lines of a changing set of documents, kept in ``path`` (a folder that all executors reach)."""

    TABLES = {
        "refs": "has_id boolean, id long, t1 long, t2 long, key binary, place int, version int",
        "gone": "has_id boolean, id long, t1 long, t2 long, version int",
        "counts": "key binary, place int, before long, n long",
        "filters": "shard int, slots binary",
    }

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 shard_keys: int = SHARD_KEYS, shard_refs: int = SHARD_REFS):
        self.spark, self.path = spark, path.rstrip("/")
        self.min_docs, self.min_chars, self.shard_keys, self.shard_refs = min_docs, min_chars, shard_keys, shard_refs
        self.version = max(self._complete(), default=0)

    # ---- versions -------------------------------------------------------------

    def _folder(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _complete(self) -> list[int]:
        """Versions whose last table was written to its end (its name holds the shards' bits)."""
        fs, path = self._folder()
        found = fs.globStatus(path(f"{self.path}/filters/v=*/bits=*/_SUCCESS")) or []
        return sorted(int(str(f.getPath()).split("/v=")[-1].split("/")[0]) for f in found)

    def _bits(self) -> int:
        fs, path = self._folder()
        found = fs.globStatus(path(f"{self.path}/filters/v={self.version}/bits=*/_SUCCESS"))
        return int(str(found[0].getPath()).split("bits=")[-1].split("/")[0])

    def _read(self, table: str, version: int, bits: int | None = None) -> DataFrame:
        at = f"{self.path}/{table}/v={version}" + (f"/bits={bits}" if bits is not None else "")
        return self.spark.read.schema(self.TABLES[table]).parquet(at)

    def _write(self, df: DataFrame, table: str, version: int, bits: int | None = None) -> DataFrame:
        at = f"{self.path}/{table}/v={version}" + (f"/bits={bits}" if bits is not None else "")
        schema = T._parse_datatype_string(self.TABLES[table])
        df.select(*schema.names).write.mode("overwrite").option("compression", "zstd").parquet(at)
        return self._read(table, version, bits)

    def _all(self, table: str) -> DataFrame:
        """Rows that the versions so far wrote to ``table``."""
        fs, path = self._folder()
        found = [str(f.getPath()) for f in fs.globStatus(path(f"{self.path}/{table}/v=*")) or []]
        found = [f for f in found if int(f.split("/v=")[-1]) <= self.version]
        read = self.spark.read.schema(self.TABLES[table])
        return read.parquet(*found) if found else self.spark.createDataFrame([], self.TABLES[table])

    # ---- state ----------------------------------------------------------------

    def refs(self) -> DataFrame:
        """References of the documents that are in the index now."""
        refs, gone = self._all("refs"), self._all("gone")
        if gone.isEmpty():
            return refs
        last = gone.groupBy(*DOC).agg(F.max("version").alias("left_at"))
        return refs.join(last, DOC, "left").where("left_at is null or left_at < version").drop("left_at")

    def counts(self) -> DataFrame:
        """key, place, n: in how many documents every key is."""
        if not self.version:
            return self.spark.createDataFrame([], "key binary, place int, n long")
        return self._read("counts", self.version).where("n > 0").drop("before")

    def filters(self) -> DataFrame:
        return self._read("filters", self.version, self._bits())

    # ---- changes ----------------------------------------------------------------

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents (those already in the index stay as they are)."""
        new = line_refs(docs, self.min_chars)
        if self.version:
            new = new.join(self.refs().select(*DOC).distinct(), DOC, "left_anti")
        version = self.version + 1
        new = self._write(new.withColumn("version", F.lit(version)), "refs", version)
        return self._change(new, 1, version)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take out the documents whose doc_id is in ``ids`` (a NULL there means the documents without an id)."""
        wanted = ids.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")).distinct()
        version = self.version + 1
        old = stored(self.refs().join(wanted, ["has_id", "id"], "left_semi"), "line-gone")
        self._write(old.select(*DOC).distinct().withColumn("version", F.lit(version)), "gone", version)
        return self._change(old, -1, version)

    def _change(self, refs: DataFrame, sign: int, version: int) -> LineIndex:
        """Add or take away references: new counts, then the filters of the shards that changed."""
        changed = refs.groupBy("key", "place").agg((F.count(F.lit(1)) * sign).alias("d"))
        both = self.counts().select("key", "place", F.col("n").alias("before"), F.lit(0).cast("long").alias("d")).unionByName(
            changed.select("key", "place", F.lit(0).cast("long").alias("before"), "d"))
        merged = both.groupBy("key", "place").agg(F.sum("before").alias("before"), (F.sum("before") + F.sum("d")).alias("n"))
        counts = self._write(merged, "counts", version)
        shared, was = F.col("n") >= self.min_docs, F.col("before") >= self.min_docs
        many = counts.where(shared).count()
        bits = self._bits() if self.version else 0
        if not self.version or many > self.shard_keys << bits and bits < MAX_BITS:
            while many > self.shard_keys << bits and bits < MAX_BITS:
                bits += 1
            filters = self._built(counts.where(shared), bits)
        else:
            moved = counts.where(shared != was).select(self._shard(bits), "key", F.when(shared, 1).otherwise(-1).alias("d"))
            old = self.filters()
            tried = stored(moved.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_updated, "shard int, slots binary, full boolean"),
                           "line-filters")
            full = F.broadcast(tried.where("full").select("shard"))  # at most 2 ** MAX_BITS numbers
            anew = self._built(counts.where(shared).withColumn("shard", self._shard(bits)).join(full, "shard", "left_semi"), bits)
            filters = tried.where("not full").drop("full").unionByName(anew)
        self._write(filters, "filters", version, bits)
        self.version = version
        return self

    @staticmethod
    def _shard(bits: int):
        return F.shiftright("place", 16 - bits).alias("shard")

    def _built(self, keys: DataFrame, bits: int) -> DataFrame:
        """Filters of the given keys; a shard holds about ``shard_keys`` of them."""
        def build(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": frame["shard"].iloc[:1], "slots": [Cuckoo.built(frame["key"].tolist()).to_bytes()]})
        return keys.select(self._shard(bits), "key").groupBy("shard").applyInPandas(build, "shard int, slots binary")

    # ---- questions ----------------------------------------------------------------

    def maybe_shared(self) -> DataFrame:
        """The references that their shard's filter lets pass: all of shared keys, and a few others."""
        bits, refs, filters = self._bits(), self.refs().drop("version"), self.filters()
        load = self.counts().groupBy(self._shard(bits)).agg(F.sum("n").alias("refs"))
        # at most 2 ** MAX_BITS rows of numbers
        copies = F.broadcast(stored(load.select("shard", F.ceil(F.col("refs") / self.shard_refs).cast("int").alias("copies")), "line-shards"))
        dealt = refs.withColumn("shard", self._shard(bits)).join(copies, "shard").select(
            *DOC, "key", "shard", F.pmod(F.xxhash64(*DOC), F.col("copies")).cast("int").alias("copy"), F.lit(None).cast("binary").alias("slots"))
        # no NULL in a number: pandas would turn its column into rounded floats
        nobody = [F.lit(0).cast(t).alias(c) for c, t in zip(DOC, ("boolean", "long", "long", "long"))]
        held = filters.join(copies, "shard").select(*nobody, F.lit(b"").alias("key"), "shard",
                                                    F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "slots")
        both = dealt.unionByName(held).repartition(shuffle_parts(self.spark), "shard", "copy")
        both = both.sortWithinPartitions("shard", "copy", F.col("slots").isNull())  # a filter comes before its references

        def run(frames):
            at, held = None, None
            for frame in frames:
                parts = []
                for group, rows in frame.groupby(["shard", "copy"], sort=False):
                    given = rows["slots"].notna()
                    if group != at:
                        at, held = group, None
                    if given.any():
                        held = Cuckoo.from_bytes(rows.loc[given, "slots"].iloc[0])
                    asked = rows[~given]
                    if held is not None and len(asked):
                        parts.append(asked[held.has(asked["key"].tolist())])
                if parts:
                    yield pd.concat(parts)[[*DOC, "key"]]

        return both.mapInPandas(run, "has_id boolean, id long, t1 long, t2 long, key binary")

    def drops(self) -> DataFrame:
        """Per document that loses lines: DOC and the keys (an array) whose lines go: shared ones that a larger document holds."""
        maybe = stored(self.maybe_shared(), "line-maybe")
        doc = F.struct(*DOC)
        exact = self.counts().where(F.col("n") >= self.min_docs).select("key", "n")
        tops = stored(maybe.groupBy("key").agg(F.max(doc).alias("top")).join(exact, "key"), "line-tops")
        gone = join_weighted(maybe, tops, ["key"], "n").where(doc != F.col("top"))
        return gone.groupBy(*DOC).agg(F.collect_list("key").alias("keys"))

    def cleaned(self, docs: DataFrame) -> DataFrame:
        """Per row of ``docs``: row (all its columns), text (without the lines that go), n_lines (before), n_dropped.

        Documents that are not in the index keep all their lines.
        """
        min_chars = self.min_chars

        @F.pandas_udf(ROOM)
        def strip(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
            out, many, lost = [], [], []
            for text, drop in zip(texts, keys):
                lines = text.split("\n")
                if drop is not None and len(drop):
                    drop = set(drop)
                    kept = [x for x in lines if line_key(x, min_chars) not in drop]
                    text = "\n".join(kept)
                else:
                    kept = lines
                out.append(text)
                many.append(len(lines))
                lost.append(len(lines) - len(kept))
            return pd.DataFrame({"text": out, "n_lines": many, "n_dropped": lost})

        rows = identified(docs).drop("text").join(self.drops(), DOC, "left")
        text = F.coalesce(F.col("row.text").cast("string"), F.lit("")) if "text" in docs.columns else F.lit("")
        return rows.select("row", strip(text, "keys").alias("out")).select("row", "out.*")


def _updated(moved: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after keys left and entered it; ``full``: to be built anew (no room, or there was none)."""
    shard = (old if len(old) else moved)["shard"].iloc[0]
    if not len(old):
        return pd.DataFrame({"shard": [shard], "slots": [b""], "full": [True]})
    kept = Cuckoo.from_bytes(old["slots"].iloc[0])
    kept.delete(moved.loc[moved["d"] < 0, "key"].tolist())
    room = kept.insert(moved.loc[moved["d"] > 0, "key"].tolist())
    return pd.DataFrame({"shard": [shard], "slots": [kept.to_bytes() if room else b""], "full": [not room]})


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """All documents inserted into a new index and cleaned by it: row, text, n_lines, n_dropped.

    A document is what rows equal in doc_id and text have in common; a NULL
    text is empty (one empty line), a NULL doc_id is smaller than all others
    (documents without an id, and those that share one, are ordered by their
    texts' hashes).  Keys in at least ``min_docs`` documents stay in the largest
    document that holds them.  Repeated rows are cleaned alike; an empty table
    gives no rows; all columns of ``docs`` are in ``row``, whatever their names.
    """
    index = LineIndex(docs.sparkSession, scratch_path(docs.sparkSession, "line-index"), min_docs, min_chars)
    return index.insert(docs).cleaned(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line FROM d),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(g.top <> k.doc_id, FALSE) AS lost FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT lost THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
