"""Quality rules: exact word statistics, and perplexity bands from modified Kneser-Ney models.

The word model is over pairs of words as they are written (64-bit hashes of
their bytes: capitals, digits and every script apart).  Spark counts the pairs
of *all* texts, summed per task first and sent as sorted arrays; the model, one
row per different pair with the cost (-log P) of its second word after the
first and alone, grows with the corpus.  Its counts are kept as Parquet, sorted
by the left word and partitioned by ranges of the pair's hash.  Texts meet one
range after the other, pair and request in the same bucket of the hash; the
most frequent pairs, at most ``SMALL_ROWS``, are looked up in the workers, so
none fills a task.  Shuffles end with their job and the tables with the scores.

The spelling model is over characters, in an alphabet of 32 classes (the
letters a-z, one class each for capitals, digits, white space, punctuation,
other ASCII and everything beyond ASCII), of order 4: at most 32 ** 4 =
1,048,576 numbers, broadcast.

A text has three scores: the mean cost of its characters (``surprise``), of its
words alone (``word_surprise``) and after one another (``pair_surprise``).  A
language's bands are centred on the medians of its texts that pass the base
rules and are ``WIDTH`` robust deviations wide; the variance at a text's length
is a part of its own and a part for chance over the length, both fitted to the
spread of the scores at all lengths.  Texts above (noise, symbols,
capitals, unusual order) or below (monotony) are rejected, but not those with a
low ``pair_surprise``: that marks copies, which the dedup stages judge.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.llm.shared import SMALL_ROWS, deleted, documents, scratch_path, shuffle_parts, shuffles_dropped, stored, with_columns
from hpcstats.llm.tokens import sliced
from hpcstats.llm.wordhash import STEP, Batch, mixed, released

ORDER = 4
CLASSES = 32
WIDTH = 3.0
LEAST_DEVIATION = 0.02
MIN_SPREAD = 20  # texts of like length for a measured spread; fewer count only where no length has as many
# The scores and the column that holds how many costs each is the mean of.
SCORES = {"surprise": "n_chars", "word_surprise": "n_words", "pair_surprise": "n_words"}
BEGIN = np.uint64(0x9AE16A3B2F90404F)  # stands before the first word of a text
PARTS = 8  # ranges of the pairs' hashes that the counts are stored by
PART_WORDS = 1_000_000  # words for which a range of its own is read; fewer share one
PARTS_COUNTED = 4  # parts that are counted at a time
TASK_PAIRS = 500_000  # pairs that a task sums up before it sends them
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # percent of the words


def _classes() -> np.ndarray:
    table = np.full(256, 31, dtype=np.uint32)
    table[:128] = 30
    table[97:123] = np.arange(26)
    table[65:91] = 26
    for number, members in ((27, b"0123456789"), (28, b" \t\n\x0b\x0c\r"), (29, b".,;:!?'\"()-")):
        table[list(members)] = number
    return table


CLASS_OF = _classes()
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _gram_codes(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram code ending at every code point, and where each text starts and ends among them."""
    places = np.flatnonzero((batch.data & 0xC0) != 0x80)
    c = CLASS_OF[batch.data[places]]
    code = c.copy()
    for back in range(1, ORDER):
        code[back:] += c[:-back] << np.uint32(5 * back)
    return code, np.searchsorted(places, batch.starts), np.searchsorted(places, batch.ends)


def count_grams(texts: DataFrame) -> DataFrame:
    """(text) to (gram, n): all 4-grams of all texts, each text begun with white space."""
    def run(batches):
        total = np.zeros(CLASSES ** ORDER, dtype=np.int64)
        for frame in batches:
            values = frame["text"].tolist()
            for a, b in sliced(values, 2_000_000):
                code, starts, ends = _gram_codes(Batch(values[a:b]))
                edges = np.zeros(len(code) + 1, dtype=np.int32)
                np.add.at(edges, starts, 1)
                np.add.at(edges, ends, -1)
                total += np.bincount(code[np.cumsum(edges[:-1]) > 0], minlength=len(total))
        seen = np.flatnonzero(total)
        released()
        yield pd.DataFrame({"gram": seen, "n": total[seen]})
    return texts.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: np.ndarray, order: int = ORDER, classes: int = CLASSES) -> np.ndarray:
    """Dense counts of all grams (order axes) to P(last | the others), interpolated modified Kneser-Ney.

    Below the highest order a gram counts its different left neighbours; the
    discounts for counts of 1, 2 and more come from the counts of counts; order
    0 is uniform, so nothing has probability 0.
    """
    tables = {order: counts.reshape((classes,) * order).astype(np.float64)}
    for n in range(order - 1, 0, -1):
        tables[n] = (tables[n + 1] > 0).sum(axis=0).astype(np.float64)
    p = np.full((), 1.0 / classes)
    for n in range(1, order + 1):
        x = tables[n]
        have = [float((x == k).sum()) for k in (1, 2, 3, 4)]
        discounts = [0.5, 0.5, 0.5]
        if have[0] and have[1]:
            y = have[0] / (have[0] + 2 * have[1])
            discounts = [k - (k + 1) * y * have[k] / have[k - 1] if have[k - 1] else 0.5 for k in (1, 2, 3)]
        d1, d2, d3 = (min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), discounts))
        taken = np.select([x >= 3, x == 2, x == 1], [d3, d2, d1], 0.0)
        total = x.sum(axis=-1, keepdims=True)
        spare = taken.sum(axis=-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, (x - taken) / total + spare / total * p, np.broadcast_to(p, x.shape))
    return p


def train(texts: DataFrame) -> np.ndarray:
    """The model's sorted array: -log P of every gram, in the order of the gram's code (its collision-free hash)."""
    grams = count_grams(texts).toPandas().sort_values("gram")  # at most 32 ** 4 rows
    counts = np.zeros(CLASSES ** ORDER, dtype=np.int64)
    counts[grams["gram"].to_numpy()] = grams["n"].to_numpy()
    return -np.log(kneser_ney(counts)).reshape(-1).astype(np.float32)


def _pair_hash(rows: pd.DataFrame) -> np.ndarray:
    left, word = (rows[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("left", "word"))
    return mixed(left * STEP + word)


def _looked_up(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _pairs(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word before every word (BEGIN for a text's first) and of the two as a pair."""
    left = np.full(len(batch.word_hash), BEGIN, dtype=np.uint64)
    inside = np.flatnonzero(batch.word_doc[1:] == batch.word_doc[:-1]) + 1
    left[inside] = batch.word_hash[inside - 1]
    return left, mixed(left * STEP + batch.word_hash)


def _blobs(bucket: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket: the bytes of its values, in their order, of each column."""
    order = np.argsort(bucket, kind="stable")
    seen, first = np.unique(bucket[order], return_index=True)
    cuts = list(zip(first, np.append(first[1:], len(order))))
    return pd.DataFrame({"bucket": seen} | {c: [v[order[a:b]].tobytes() for a, b in cuts] for c, v in columns.items()})


def _values(blobs: pd.DataFrame, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs[column]), dtype=kind)


def _part(pair: np.ndarray) -> np.ndarray:
    return (pair >> np.uint64(61)).astype(np.int64)  # 0 to PARTS - 1


def _in_parts(pair: np.ndarray, low: int, high: int) -> np.ndarray:
    part = _part(pair)
    return np.flatnonzero((part >= low) & (part < high))


def _share(pair: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for every pair, whatever its part."""
    return ((pair >> np.uint64(20) & np.uint64(0xFFFFFF)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def count_pairs(texts: DataFrame, low: int = 0, high: int = PARTS) -> DataFrame:
    """(text) to (left, word, n, part): pairs of words of all texts, by their hashes, whose hash is in the parts low to high - 1.

    Tasks sum up some ``TASK_PAIRS`` pairs and send them as arrays sorted by
    the left word, by buckets of the pair's hash.
    """
    buckets = -(-4 * shuffle_parts(texts.sparkSession) // PARTS)  # in each part

    def summed(held):
        pair, left, word = (np.concatenate(x) for x in zip(*held))
        pair, first, n = np.unique(pair, return_index=True, return_counts=True)
        left, bucket = left[first], _part(pair) * buckets + _share(pair, buckets)
        order = np.lexsort((left, bucket))
        return _blobs(bucket[order], left=left[order], word=word[first][order], n=n[order].astype(np.uint32))

    def run(batches):
        held, pairs = [], 0
        for frame in batches:
            values = frame["text"].tolist()
            for a, b in sliced(values, 1_000_000):
                batch = Batch(values[a:b])
                left, pair = _pairs(batch)
                here = _in_parts(pair, low, high)
                held.append((pair[here], left[here], batch.word_hash[here]))
                pairs += len(here)
                if pairs >= TASK_PAIRS:
                    yield summed(held)
                    held, pairs = [], 0
        if pairs:
            yield summed(held)
        released()

    def total(blobs):
        left, word = _values(blobs, "left", np.int64), _values(blobs, "word", np.int64)
        order = np.lexsort((word, left))
        left, word = left[order], word[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (left[1:] != left[:-1]) | (word[1:] != word[:-1])
        first = np.flatnonzero(new)
        n = np.add.reduceat(_values(blobs, "n", np.uint32)[order].astype(np.int64), first)
        return pd.DataFrame({"left": left[first], "word": word[first], "n": n, "part": blobs["bucket"].iloc[0] // buckets})

    sent = texts.mapInPandas(run, "bucket int, left binary, word binary, n binary")
    return sent.groupBy("bucket").applyInPandas(total, "left long, word long, n long, part int")


def _discounts(have: list[int]) -> list[float]:
    """Of counts 1, 2 and more, from the numbers of counts 1 to 4."""
    if not (have[0] and have[1]):
        return [0.5, 0.5, 0.5]
    y = have[0] / (have[0] + 2 * have[1])
    found = [k - (k + 1) * y * have[k] / have[k - 1] if have[k - 1] else 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found)]


def _by_key(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of a stored table with one that has a row per key; the keys with the most rows are broadcast."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * SMALL_ROWS > total  # at most SMALL_ROWS keys, as their weights sum up to the total
    often, rest = F.broadcast(table.where(hot).drop(weight)), table.where(~hot).drop(weight)
    return rows.join(often, key).unionByName(rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(rest, key))


def word_model(texts: DataFrame, folder: str | None = None) -> DataFrame:
    """(text) to (left, word, n, part, pair_cost, word_cost): interpolated modified Kneser-Ney costs of all pairs.

    The counts are stored (in ``folder``, if given) by parts of the pairs; the
    costs are joined to them where a part of the model is read.  As in ``kneser_ney``: a word alone counts its different left neighbours,
    over a uniform base; a pair has its discounted count, and the discounts of
    its left word's pairs are shared out by the words alone.
    """
    spans = [(low, min(low + PARTS_COUNTED, PARTS)) for low in range(0, PARTS, PARTS_COUNTED)]
    counts = reduce(DataFrame.unionByName, [stored(count_pairs(texts, *s), f"pairs-{s[0]}", folder, ("part",)) for s in spans])
    counted = lambda k: F.sum((F.col("n") == k).cast("long"))
    words = stored(counts.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words", folder)
    lefts = stored(counts.groupBy("left").agg(F.sum("n").alias("total"), *[counted(k).alias(f"n{k}") for k in (1, 2)],
                                              F.count(F.lit(1)).alias("pairs")), "lefts", folder)
    of_pairs, of_words = ([x or 0 for x in t.agg(*[counted(k) for k in (1, 2, 3, 4)], F.count(F.lit(1)), F.sum("n")).first()]
                          for t in (counts, words))
    d_pair, d_word = _discounts(of_pairs), _discounts(of_words)
    taken = lambda d: F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])
    different, tokens = max(of_words[4], 1), max(of_words[5], 1)
    spare = sum(d * n for d, n in zip(d_word, (of_words[0], of_words[1], of_words[4] - of_words[0] - of_words[1])))
    words = words.select("word", ((F.col("n") - taken(d_word) + spare / different) / tokens).alias("p_word"), F.col("n").alias("pairs"))
    shared = d_pair[0] * F.col("n1") + d_pair[1] * F.col("n2") + d_pair[2] * (F.col("pairs") - F.col("n1") - F.col("n2"))
    lefts = lefts.select("left", "total", shared.alias("shared"), "pairs")
    both = _by_key(_by_key(counts, words, "word", "pairs"), lefts, "left", "pairs")
    p_pair = (F.col("n") - taken(d_pair) + F.col("shared") * F.col("p_word")) / F.col("total")
    return both.select("left", "word", "n", "part", (-F.log(p_pair)).cast("float").alias("pair_cost"), (-F.log("p_word")).cast("float").alias("word_cost"))


def word_scores(texts: DataFrame, model: DataFrame, folder: str | None = None, words: int | None = None) -> DataFrame:
    """(text_key, text) to (text_key, word_surprise, pair_surprise): mean costs of each text's words; equal texts share a row.

    One range of the pairs' hashes after the other, so that what is sent at a
    time stays a fraction of the pairs: the texts are read again for each, ask
    for their pairs in that range, and their sums are stored (in ``folder``, if
    given).  ``words`` is the number of all words that the model counted.
    """
    session = texts.sparkSession
    total = words if words is not None else model.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * SMALL_ROWS > total  # at most SMALL_ROWS pairs, as their counts sum up to the total
    often = model.where(hot).toPandas()
    often["pair"] = _pair_hash(often)
    often = often.sort_values("pair")
    table = session.sparkContext.broadcast([often[c].to_numpy() for c in ("pair", "pair_cost", "word_cost")])
    ranges = min(PARTS, max(1, total // PART_WORDS))
    buckets = max(-(-4 * shuffle_parts(session) // ranges), 8)
    blob = "bucket int, pair binary, text_key binary, n binary, pair_cost binary, word_cost binary"

    def told(batches):  # the model's pairs and their costs
        held, rows = [], 0
        for frame in batches:
            held.append(frame)
            rows += len(frame)
            if rows >= 200_000:
                yield packed(pd.concat(held))
                held, rows = [], 0
        if rows:
            yield packed(pd.concat(held))
        released()

    def packed(rows):
        pair = _pair_hash(rows)
        return _blobs(_share(pair, buckets), pair=pair, **{c: rows[c].to_numpy(dtype=np.float32) for c in ("pair_cost", "word_cost")}).assign(
            text_key=None, n=None)[["bucket", "pair", "text_key", "n", "pair_cost", "word_cost"]]

    def asked(low, high):
        def run(batches):
            known, *costs = table.value
            for frame in batches:
                values = frame["text"].tolist()
                for a, b in sliced(values, 1_000_000):
                    batch = Batch(values[a:b])
                    key, pair = frame["text_key"].to_numpy()[a:b], _pairs(batch)[1]
                    here = _in_parts(pair, low, high)
                    pair, doc = pair[here], batch.word_doc[here]
                    at, found = _looked_up(known, pair)
                    # per text the sums of what is known here, and its other pairs
                    n, *sums = (np.bincount(doc[found], weights=w, minlength=batch.docs) for w in (None, *(c[at[found]] for c in costs)))
                    yield _blobs(key.view(np.uint64) % np.uint64(buckets), text_key=key, n=n.astype(np.uint32), pair_cost=sums[0], word_cost=sums[1]).assign(
                        pair=None)[["bucket", "pair", "text_key", "n", "pair_cost", "word_cost"]]
                    pair, doc = pair[~found], doc[~found]
                    order = np.lexsort((pair, doc))
                    pair, doc = pair[order], doc[order]
                    new = np.ones(len(pair), dtype=bool)
                    new[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
                    first = np.flatnonzero(new)
                    pair, n = pair[first], np.diff(np.append(first, len(new))).astype(np.uint32)
                    yield _blobs(_share(pair, buckets), pair=pair, text_key=key[doc[first]], n=n).assign(pair_cost=None, word_cost=None)
            released()
        return run

    def answered(blobs):
        model, sums = blobs[blobs["text_key"].isna()], blobs[blobs["pair"].isna()]
        asks = blobs[blobs["pair"].notna() & blobs["text_key"].notna()]
        pair = _values(model, "pair", np.uint64)
        order = np.argsort(pair)
        at, found = _looked_up(pair[order], _values(asks, "pair", np.uint64))
        n = _values(asks, "n", np.uint32)
        keys, which = np.unique(np.concatenate([_values(t, "text_key", np.int64) for t in (asks, sums)]), return_inverse=True)
        out = {"text_key": keys, "n": np.bincount(which, weights=np.concatenate([n, _values(sums, "n", np.uint32)]), minlength=len(keys)).astype(np.int64)}
        for c in ("pair_cost", "word_cost"):
            cost = np.zeros(len(n))
            cost[found] = n[found] * _values(model, c, np.float32)[order[at[found]]].astype(np.float64)
            out[c] = np.bincount(which, weights=np.concatenate([cost, _values(sums, c, np.float64)]), minlength=len(keys))
        released()
        return pd.DataFrame(out)

    summed = lambda t: t.groupBy("text_key").agg(*[F.sum(c).alias(c) for c in ("n", "pair_cost", "word_cost")])
    found = []
    for k in range(ranges):
        low, high = PARTS * k // ranges, PARTS * (k + 1) // ranges
        rest = model.where(~hot & F.col("part").between(low, high - 1)).select("left", "word", "pair_cost", "word_cost")
        sent = rest.mapInPandas(told, blob).unionByName(texts.select("text_key", "text").mapInPandas(asked(low, high), blob))
        rows = sent.groupBy("bucket").applyInPandas(answered, "text_key long, n long, pair_cost double, word_cost double")
        found.append(stored(summed(rows), f"sums-{k}", folder))
    return summed(reduce(DataFrame.unionByName, found)).select("text_key", *[F.try_divide(F.col(f"{c}_cost"), F.col("n")).alias(f"{c}_surprise") for c in ("word", "pair")])


def _word_statistics(texts: list[str], batch: Batch) -> dict[str, np.ndarray]:
    lines = [[x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] for t in texts]
    hashes, at = batch.windows(WINDOW)
    # windows are compared inside their text only
    key = hashes ^ mixed(batch.word_doc[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(key), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    cover = np.zeros(len(batch.word_hash) + 1, dtype=np.int64)
    starts = at[repeated]
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    in_repeat = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": batch.words(),
        "word_chars": batch.per_doc(~batch.space & ((batch.data & 0xC0) != 0x80)),
        "n_symbols": batch.per_doc(SYMBOLS[batch.data]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": np.bincount(batch.word_doc[in_repeat], minlength=batch.docs),
    }


def score(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """Per document: doc_id, lang, text_key, the statistics, base_failed, n_chars, surprise (mean -log P of a character; NULL without any)."""
    model = docs.sparkSession.sparkContext.broadcast(cost)  # 32 ** 4 numbers

    def run(batches):
        table = model.value
        for frame in batches:
            values = frame["text"].tolist()
            for a, b in sliced(values, 2_000_000):
                batch = Batch(values[a:b])
                out = _word_statistics(values[a:b], batch)
                code, starts, ends = _gram_codes(batch)
                running = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
                n = ends - starts
                out["n_chars"] = n
                out["total_cost"] = running[ends] - running[starts]
                out |= {c: frame[c].iloc[a:b].to_numpy() for c in ("doc_id", "lang", "text_key")}
                yield pd.DataFrame(out)
        released()

    schema = ("doc_id string, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "n_chars long, total_cost double, text_key long")
    scored = docs.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "surprise", F.when(F.col("n_chars") > 0, F.col("total_cost") / F.col("n_chars"))).drop("total_cost")


def each_width(width: float, bounds: int) -> float:
    """Deviations for each of several bounds that together cut off what one band of +-width cuts off a normal score."""
    return -NormalDist().inv_cdf(2 * NormalDist().cdf(-width) / bounds)


def _fitted(c: str) -> list:
    """own and chance of variance = own + chance / size, by least squares over the lengths' relative errors.

    A row is a language's texts of like length: their number, ``size`` and
    variance times size, which is chance + own * size.
    """
    x, z = F.col(f"{c}_size"), F.col(f"{c}_variance") * F.col(f"{c}_size")
    w = F.when(F.col(f"{c}_n") >= MIN_SPREAD, 1.0).otherwise(1e-6) * F.col(f"{c}_n") / (z * z)
    sw, sx, sz, sxx, sxz = (F.sum(v) for v in (w, w * x, w * z, w * x * x, w * x * z))
    spread = sw * sxx - sx * sx
    slope = F.when(spread > 1e-9 * sw * sxx, F.try_divide(sw * sxz - sx * sz, spread)).otherwise(0.0)
    chance = (sz - slope * sx) / sw
    # neither part is below 0: without it, the other is fitted alone
    own = F.when(slope <= 0, 0.0).when(chance < 0, sxz / sxx).otherwise(slope)
    return [own.alias(f"{c}_own"), F.when(slope <= 0, sz / sw).otherwise(F.greatest(chance, F.lit(0.0))).alias(f"{c}_chance")]


def _bands(good: DataFrame) -> DataFrame:
    """Per language ("of"), for each score: centre, own and chance variance, from the texts that pass the base rules."""
    centre = stored(good.groupBy(F.col("lang").alias("of")).agg(
        *[F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_centre") for c in SCORES]), "quality-centre")
    small = (lambda t: F.broadcast(t)) if centre.count() <= SMALL_ROWS else (lambda t: t)
    own = good.join(small(centre), F.col("lang").eqNullSafe(F.col("of")))
    bands = centre
    for c, size in SCORES.items():
        mad = F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_centre")), 0.5, 10_000)
        lengths = own.groupBy("of", F.floor(F.log2(size)).alias("length")).agg(
            F.count(F.lit(1)).alias(f"{c}_n"), (1 / F.avg(1 / F.col(size))).alias(f"{c}_size"),
            F.pow(F.greatest(1.4826 * mad, F.lit(LEAST_DEVIATION)), 2).alias(f"{c}_variance"))
        fit = lengths.withColumnRenamed("of", "fit_of").groupBy("fit_of").agg(*_fitted(c))
        bands = bands.join(small(stored(fit, "quality-fit")), F.col("of").eqNullSafe(F.col("fit_of"))).drop("fit_of")
    return bands


def quality(docs: DataFrame, width: float = WIDTH) -> DataFrame:
    """One row per document: doc_id, lang, text_key (a hash of the text), statistics, base_failed, scores, lower and upper (of surprise), kept.

    NULL and empty texts have no words and fail the base rules.  NULL languages
    form one of their own; a language all of whose texts fail the base rules
    has no band and keeps none.  Repeated rows are judged alike, an empty table
    gives no rows; columns other than doc_id, text and lang are ignored.
    """
    rows = with_columns(docs, doc_id="string", text="string", lang="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    spark, texts = docs.sparkSession, rows.select("text_key", "text")
    folder = scratch_path(spark, "quality-words")
    with shuffles_dropped(spark):
        statistics = stored(score(rows, train(rows.select("text"))), "statistics", folder)
        words = statistics.agg(F.sum("n_words")).first()[0] or 0
        scores = word_scores(texts, word_model(rows.select("text"), folder), folder, words)
        scored = stored(statistics.join(scores, "text_key", "left"), "quality")
    deleted(spark, folder)
    good = scored.where(~F.col("base_failed"))
    bands = stored(_bands(good), "quality-bands")
    small = F.broadcast(bands) if bands.count() <= SMALL_ROWS else bands
    judged = scored.join(small, F.col("lang").eqNullSafe(F.col("of")), "left")
    inside, width = F.lit(True), each_width(width, 2 * len(SCORES) - 1)
    for name, size in SCORES.items():
        margin = width * F.sqrt(F.col(f"{name}_own") + F.col(f"{name}_chance") / F.greatest(size, F.lit(1)))
        if name == "surprise":
            judged = judged.withColumn("lower", F.col("surprise_centre") - margin).withColumn("upper", F.col("surprise_centre") + margin)
        inside &= F.col(name) <= F.col(f"{name}_centre") + margin
        if name != "pair_surprise":
            inside &= F.col(name) >= F.col(f"{name}_centre") - margin
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).select(
        "doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        *SCORES, "lower", "upper", "kept")


def own_column(docs: DataFrame, name: str):
    """The column as ``quality`` reads it; NULL if there is none."""
    column = F.col(f"`{name}`") if name in docs.columns else F.lit(None)
    return column.cast("long" if name == "doc_id" else "string")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents kept, with all their columns.

    A verdict depends on the row's text and language alone; rows share one only
    if doc_id, text and language are the same, so rows without an id or with a
    repeated one are judged each by its own text.  NULL and empty texts go; the
    columns may have any names; an empty table gives no rows.
    """
    judged = quality(docs).where("kept")
    key = lambda doc_id, lang, text_key: [
        F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), text_key.alias("text_key"),
        F.coalesce(lang, F.lit("")).alias("of"), lang.isNull().alias("nowhere")]
    kept = judged.select(*key(F.col("doc_id"), F.col("lang"), F.col("text_key"))).distinct()
    rows = docs.select(F.struct("*").alias("row"), *key(own_column(docs, "doc_id"), own_column(docs, "lang"),
                                                         F.xxhash64(F.coalesce(own_column(docs, "text"), F.lit("")))))
    return rows.join(kept, kept.columns, "left_semi").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
