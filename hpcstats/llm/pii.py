"""Personal data: exact base patterns, and boosted trees over further candidate spans.

Generators with high recall propose spans that may overlap: everything the base
patterns match or nearly match (written-out or spaced addresses, numbers in any
grouping, long mixed codes, values after words like "password").  Spans that
meet a base rule are reported as they are.  The others are judged by gradient
boosted trees on the span's format (length, shares of digits, separators,
groups, character mix) and on the words next to it.

No labels come with the data, so the trees learn from the base rules: for each
training span the features do *not* contain what the rule decides on, and the
tree has to tell spans that the rules accept from spans that they refuse.  All
spans that a base rule judges take part: a hash parts them into two halves, each
half trains a model, and the model of the one half scores the other.  Those
scores of all spans calibrate each kind's threshold, the lowest score at which
``PRECISION`` of the spans at or above it are accepted ones.  A further span's
score is the mean of the two models'.  A kind that has no such score adds nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import documents, stored, with_columns
from hpcstats.llm.tokens import sliced

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Possessive digits and the look-behind only spare retries that must fail.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Generators of further candidates: name of the kind they may add, and what they propose.
GENERATORS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]?(?:@|\bat\b)[)\]]? ?[A-Za-z0-9-]{1,64}(?: ?[(\[]?(?:\.|\bdot\b)[)\]]? ?[A-Za-z0-9-]{2,24}){1,4}")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.])[(]?[0-9][0-9().\x20/-]{5,24}[0-9](?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){11,22}(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?: ?[.\[\]()]{1,3} ?[0-9]{1,3}){2,4}(?![0-9A-Za-z])")),
)
HAS_EMAIL_WORD = re.compile(r"@|\bat\b.{1,70}\bdot\b", re.S)
CONTEXT_WORDS = ("phone", "tel", "call", "fax", "mail", "contact", "card", "visa", "pay", "ip", "host", "server", "version", "license")
PRECISION = 0.95
LEVELS = 1 << 16    # scores are compared in steps of one part in so many
SEED = 11
MAX_BINS = 256      # borders of a feature's values; the library finds them from MAX_BINS ** 2 rows or more
FEATURES = ["length", "digits", "digit_share", "letter_share", "separators", "groups", "longest_group", "shortest_group", "group_spread",
            "has_plus", "has_parens", "has_at", "dots", "dashes", "spaces", "before_alnum", "after_alnum", "line_start", "line_end",
            *(f"near_{w}" for w in CONTEXT_WORDS)]


def _email_spans(text: str):
    """Leftmost non-overlapping matches: around every @, the longest local part that the match before leaves."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def rule_holds(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern is accepted."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    d = _digits(s) if kind != "email" else ""
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(d) <= 15
    return True


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All matches of the base patterns with whether the rule accepts them (refused ones are not retried)."""
    out = [("email", a, b, True) for a, b in _email_spans(text)] if "@" in text else []
    if DIGIT.search(text):
        patterns = (("ip", IP), ("card", CARD)) + ((("phone", PHONE),) if "+" in text else ())
        out += [(k, m.start(), m.end(), rule_holds(k, m.group())) for k, p in patterns for m in p.finditer(text)]
    return out


def candidates(text: str, matches: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, int]]:
    """Spans for the trees: (kind, start, end, label); label 1: a base rule accepts it, 0: refuses it, -1: not known."""
    sure = sorted((a, b) for _, a, b, ok in matches if ok)
    starts = [a for a, _ in sure]
    reach = list(accumulate((b for _, b in sure), max))  # how far the accepted spans up to each reach

    def is_open(a: int, b: int) -> bool:  # not already reported in part
        i = bisect_left(starts, b)
        return not i or reach[i - 1] <= a

    out = [(k, a, b, int(ok)) for k, a, b, ok in matches if ok or sum("0" <= c <= "9" for c in text[a:min(b, a + 64)]) >= 3]
    for kind, pattern in GENERATORS:
        if kind == "email" and not HAS_EMAIL_WORD.search(text):
            continue
        if kind != "email" and not DIGIT.search(text):
            continue
        out += [(kind, m.start(), m.end(), -1) for m in pattern.finditer(text) if is_open(*m.span())]
    return out


def features(text: str, start: int, end: int) -> list[float]:
    s = text[start:min(end, start + 200)]
    n = max(len(s), 1)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    digits = sum(sizes)
    letters = sum(c.isalpha() for c in s)
    near = re.findall(r"[^\W\d_]+", (text[max(0, start - 40):start] + " " + text[end:end + 20]).lower())
    around = text[start - 1:start], text[end:end + 1]
    return [float(v) for v in (
        end - start, digits, digits / n, letters / n, n - digits - letters, len(groups), max(sizes), min(sizes), max(sizes) - min(sizes),
        "+" in s, "(" in s, "@" in s, s.count("."), s.count("-"), s.count(" "), around[0].isalnum(), around[1].isalnum(),
        around[0] in ("", "\n"), around[1] in ("", "\n"), *(w in near for w in CONTEXT_WORDS))]


def find_spans(docs: DataFrame) -> DataFrame:
    """Stored span table: doc_id, row, text_hash, kind, start, end, base, label, features; one row per match or candidate.

    Every document has a row at least (kind NULL if it has no span).
    """
    def run(batches):
        for frame in batches:
            texts = frame["text"].tolist()
            for a, b in sliced(texts, 2_000_000):
                out = []
                for doc, row, mark, text in zip(*(frame[c].iloc[a:b] for c in ("doc_id", "row", "text_hash")), texts[a:b]):
                    spans = candidates(text, base_matches(text))
                    out.append((doc, row, mark, None, 0, 0, False, -1, None))
                    out += [(doc, row, mark, k, s, e, label == 1, label, features(text, s, e)) for k, s, e, label in spans]
                yield pd.DataFrame(out, columns=["doc_id", "row", "text_hash", "kind", "start", "end", "base", "label", "features"])

    rows = with_columns(docs, doc_id="string", text="string").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    schema = "doc_id string, row long, text_hash long, kind string, start long, end long, base boolean, label int, features array<double>"
    return stored(rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long")), "pii-spans")


def with_level(spans: DataFrame, models: list) -> DataFrame:
    """Add ``level``: the models' mean score of the span's ``features``, in steps (0 to LEVELS)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out, score = spans.withColumn("vector", array_to_vector("features")).withColumn("score", F.lit(0.0)), vector_to_array("probability")[1]
    for model in models:
        out = model.transform(out).withColumn("score", F.col("score") + score).drop("rawPrediction", "probability", "prediction")
    return out.withColumn("level", F.floor(F.col("score") / len(models) * LEVELS)).drop("vector", "score")


def fit_thresholds(spans: DataFrame, precision: float = PRECISION):
    """(models, {kind: least level}) from all spans with a known label; ([], {}) if no half of them has both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    half = F.pmod(F.xxhash64("doc_id", "kind", "start", "end", F.lit(SEED)), F.lit(2))
    # spans alike are one row with their number as weight
    known = stored(spans.where("label >= 0").groupBy(half.alias("half"), "kind", "label", "features").agg(F.count(F.lit(1)).cast("double").alias("n")),
                   "pii-known")
    classes = {r["half"] for r in known.groupBy("half").agg(F.countDistinct("label").alias("c")).where("c = 2").collect()}
    models = {}
    for h in sorted(classes):
        rows = known.where(F.col("half") == h).select("label", "n", array_to_vector("features").alias("vector"))
        models[h] = GBTClassifier(labelCol="label", featuresCol="vector", weightCol="n", maxIter=20, maxDepth=4, maxBins=MAX_BINS, seed=SEED).fit(rows)
    tables = []
    for h, model in models.items():
        scored = with_level(known.where(F.col("half") == 1 - h), [model])
        tables.append(scored.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).toPandas())
    thresholds = {}
    levels = pd.concat(tables).groupby(["kind", "level"], as_index=False).sum() if tables else pd.DataFrame(columns=["kind"])  # a row per kind and level
    for kind, rows in levels.groupby("kind"):
        rows = rows.sort_values("level", ascending=False)
        share = rows["good"].cumsum() / rows["n"].cumsum()
        fine = rows["level"][(share >= precision) & (rows["level"] > LEVELS // 2)]
        if len(fine):
            thresholds[kind] = int(fine.min())
    return list(models.values()), thresholds


def selected_spans(docs: DataFrame) -> DataFrame:
    """All reported spans and one NULL-kind row per document: doc_id, row, text_hash, kind, start, end, base."""
    spans = find_spans(docs)
    models, thresholds = fit_thresholds(spans)
    columns = ["doc_id", "row", "text_hash", "kind", "start", "end", "base"]
    fixed = spans.where("kind is null or base").select(*columns)
    if not thresholds:
        return fixed
    least = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
    judged = with_level(spans.where("kind is not null and not base"), models)
    added = judged.where(F.col("level") >= least[F.col("kind")]).select(*columns).distinct()
    return fixed.unionByName(added)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans, spans, text_hash.

    Spans are ``kind:start:end`` in code points (end exclusive), ordered by
    start, then kind in the order of ``KINDS``, then end.  NULL and empty texts
    have none.  Repeated rows each have their own result; an empty table gives
    no rows; columns other than doc_id and text are ignored.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", place.alias("place"), "end", "base", "kind"))
    rows = selected_spans(docs).groupBy("row", "doc_id", "text_hash").agg(F.sort_array(F.collect_list(span)).alias("s"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], text(base).alias("base_spans"), text(F.col("s")).alias("spans"),
                       "text_hash")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) with the reported spans (of ``personal_data``) replaced by ``[kind]``; overlaps by the first."""
    def run(batches):
        for frame in batches:
            out = []
            for text, listed in zip(frame["text"], frame["spans"]):
                parts, at = [], 0
                for item in filter(None, (listed or "").split(",")):
                    kind, start, end = item.split(":")
                    if int(start) >= at:
                        parts += [text[at:int(start)], f"[{kind}]"]
                        at = int(end)
                out.append("".join(parts) + text[at:])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": out})

    texts = with_columns(docs, doc_id="string", text="string").where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    known = spans.select(F.col("doc_id").cast("string").alias("id"), F.col("text_hash").alias("mark"), "spans").distinct()
    joined = texts.join(known, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("mark")))
    return joined.select("doc_id", "text", "spans").mapInPandas(run, "doc_id string, text string").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
