"""URL filters: rules by host and path, and trust spread over the host graph.

The links of all pages give a weighted graph of hosts.  Trust is personalised
PageRank along the links, started from hosts that an allow rule covers;
distrust is the same against the links (who links to a blocked host is suspect)
started from hosts that a block rule covers.  Both are sums over the graph's
edges in Spark, repeated until what further rounds could still move is below
``TOLERANCE`` of the bar; a page that no rule fits is blocked if its host's
distrust exceeds its trust by ``MARGIN`` of a seed's own weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import SMALL_ROWS, fold_case, stored, with_columns

# The rules of the query, as verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
ROUNDS = 12  # between two looks at the change
TOLERANCE = 0.01
ROUNDING = 1e-13  # sums of doubles do not settle below it
MARGIN = 0.1
LINK = r"""(?i)\s(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
SALTS = 64


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty if the url is NULL or has no ``://``."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", fold_case(F.coalesce(host, F.lit("")))).withColumn("path", F.coalesce(path, F.lit("")))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add rule (host and path of the longest rule that fits, else NULL) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer rules win
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """Links of all pages between different hosts: src, dst, links (summed over the pages)."""
    found = with_host(pages).select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    # a link without a scheme (//host/...) has the page's
    target = with_host(found.select(F.col("host").alias("src"), F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("x:"), "link"))
                                    .otherwise(F.col("link")).alias("target")), "target")
    return (target.select("src", F.col("host").alias("dst")).where("src <> '' and dst <> '' and src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links")))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
           tolerance: float = ROUNDING) -> DataFrame:
    """Personalised PageRank: (src, dst, links) and (host, weight) to (host, score).

    Every round a host hands ``damping`` of its score to the hosts it links to,
    by links, and the seeds get the rest; what reaches a host without links
    ends there.  The scores are stored every four rounds to cut the lineage.
    After every ``rounds`` the summed change is looked at: a round shrinks the
    distance to the converged scores by ``damping`` at least, which bounds what
    is left of it; the spread ends when that is at most ``tolerance``.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    shares = stored(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")), "shares")
    total = seeds.select(F.sum("weight")).first()[0] or 0.0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("score"))
    start = stored(seeds.select("host", (F.col("weight") / total).alias("start")), "seeds")
    if shares.isEmpty():  # nothing to hand on: every round gives the seeds' own share
        return start.select("host", ((1 - damping) * F.col("start")).alias("score"))
    score = start.select("host", F.col("start").alias("score"))
    shrunk, left = damping ** rounds, None
    while left is None or left > max(tolerance, ROUNDING):
        before = score
        for r in range(rounds):
            flow = shares.join(score, shares["src"] == score["host"]).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("part"))
            base = start.select("host", ((1 - damping) * F.col("start")).alias("part"))
            score = base.unionByName(flow).groupBy("host").agg(F.sum("part").alias("score"))
            if r % 4 == 3 and r + 1 < rounds:
                score = stored(score, "score")
        score = stored(score, "score")
        moved = score.unionByName(before.select("host", (-F.col("score")).alias("score"))).groupBy("host").agg(F.abs(F.sum("score")).alias("moved"))
        left = moved.agg(F.sum("moved")).first()[0] * shrunk / (1 - shrunk)
    return score


def bar(seeds: int, margin: float) -> float:
    """What distrust must exceed trust by: ``margin`` of the mean seed's own share."""
    return margin * (1 - DAMPING) / max(seeds, 1)


def host_scores(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """Per host of the pages: host, trust, distrust (shares of all seed weight; 0 if nothing reaches it), distrust_seed."""
    ruled = with_rule(with_host(pages.select("url")), rules).where("host <> ''")
    hosts = stored(ruled.groupBy("host").agg(F.sum(F.when(F.col("rule_verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
                                             F.sum(F.when(F.col("rule_verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
                                             F.count(F.lit(1)).alias("n")), "hosts")
    edges = stored(host_edges(pages), "edges")
    exact = TOLERANCE * bar(hosts.where("blocked > 0").count(), margin)
    # a host is a seed by the share of its pages that the rules decide
    trust = spread(edges, hosts.where("allowed > 0").select("host", (F.col("allowed") / F.col("n")).alias("weight")), tolerance=exact)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = spread(back, hosts.where("blocked > 0").select("host", (F.col("blocked") / F.col("n")).alias("weight")), tolerance=exact)
    return hosts.select("host", (F.col("blocked") > 0).alias("distrust_seed")).join(trust.withColumnRenamed("score", "trust"), "host", "left").join(
        distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0)


def judge_urls(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A rule decides where one fits.  Other pages are blocked if their host's
    distrust is above its trust by more than ``margin`` times the mean seed's
    share of the distrust; without any evidence they are allowed.  A NULL url
    or one without ``://`` has an empty host and path and is allowed; NULL html
    has no links.  Repeated rows each have their own result; an empty table
    gives no rows; columns other than page_id, url and html are ignored.
    """
    rows = with_columns(pages, page_id="long", url="string", html="string")
    scores = stored(host_scores(rows, rules, margin), "host-scores")
    seeds = scores.where("distrust_seed").count()
    scores = scores.drop("distrust_seed")
    judged = with_rule(with_host(rows.select("page_id", "url")), rules).drop("url")
    if scores.count() <= SMALL_ROWS:
        joined = judged.join(F.broadcast(scores), "host", "left")
    else:  # a host may hold a third of the pages: spread it over salts
        salted = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(
            salted, ["host", "salt"], "left").drop("salt")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    suspect = distrust > trust + bar(seeds, margin)
    verdict = F.coalesce("rule_verdict", F.when(suspect, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
