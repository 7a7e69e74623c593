"""Quality classifier by importance resampling.

Two generative models, hashed word uni- and bigrams of target texts and of all raw
texts, give each document a log importance weight: the log of how much likelier the
target model makes it. A document is rejected if its weight is clearly negative, in all
and per n-gram, or if it holds n-grams that mark toxic labelled texts. For a sample like the target, Gumbel noise is added to the weights and the top k are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .frames import col, fresh

BITS = 16
#: Features: hashed words, then hashed word pairs, then one for a word that repeats the one before.
FEATURES = (1 << BITS) * 2 + 1
#: Fixed value: bytes that separate words.
SEPARATORS = [9, 10, 11, 12, 13, 32]
IN_WORD = np.ones(256, bool)
IN_WORD[SEPARATORS] = False
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=24)
def powers(size: int) -> np.ndarray:
    """Powers of BASE modulo 2 to the 64."""
    return np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]).cumprod(dtype=np.uint64)


def word_buckets(text: str) -> np.ndarray:
    """Bucket of each word of a text: a polynomial of its bytes, for all words at once."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = IN_WORD[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    sizes = stops - starts
    first = sizes.cumsum() - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    # Table sizes are powers of two, so that few are made.
    table = powers(max(64, 1 << int(sizes.max() - 1).bit_length()))
    sums = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * table[place], first)
    return (((sums ^ (sums >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Feature numbers of a whole text, one per word and one per pair of neighbouring words."""
    single = word_buckets(text) if isinstance(text, str) else np.zeros(0, np.int64)
    if not len(single):
        return single
    pair = ((single[:-1] * 0x9E3779B1 + single[1:] * 0x85EBCA77) >> 13) & ((1 << BITS) - 1)
    pair += 1 << BITS
    pair[single[:-1] == single[1:]] = FEATURES - 1
    return np.concatenate([single, pair])


@dataclass
class ImportanceModel:
    log_ratio: np.ndarray  # log(target / raw) per feature
    min_mean: float = -np.inf
    min_total: float = -3.0
    toxic_ratio: np.ndarray | None = None  # lower bound of log(toxic / not toxic) per feature, 0 where not above 0
    max_toxic: float = np.inf

    def toxicity(self, found: np.ndarray) -> float:
        """Sum over a text's distinct features; nearly all add 0, so ordinary prose around a few doesn't dilute them."""
        if self.toxic_ratio is None:
            return 0.0
        telling = found[self.toxic_ratio[found] > 0]
        return float(self.toxic_ratio[np.unique(telling)].sum()) if len(telling) else 0.0


def count_features(docs: DataFrame, text: str, group: str, once: bool = False) -> DataFrame:
    """(group, feature, n) over whole texts: each task counts into one array per group, Spark sums them.

    With ``once`` a text counts a feature once.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, t in zip(batch["g"], batch["t"]):
                found = np.unique(features(t)) if once else features(t)
                if len(found):
                    total = totals.setdefault(g, np.zeros(FEATURES, np.int64))
                    np.add.at(total, found, 1)
        for g, total in totals.items():
            cells = np.flatnonzero(total)
            yield pd.DataFrame({"g": g, "feature": cells, "n": total[cells]})

    rows = docs.select(col(group).cast("int").alias("g"), col(text).cast("string").alias("t"))
    return rows.mapInPandas(count, "g int, feature int, n long").groupBy("g", "feature").agg(F.sum("n").alias("n"))


def fit_importance(docs: DataFrame, group: str, text: str = "text", smoothing: float = 1.0) -> ImportanceModel:
    """Fit both models. Rows whose ``group`` is 1 are target; all rows are raw.

    The driver receives at most two rows per feature, a fixed bound. Without target rows all ratios are 0.
    """
    counts = count_features(docs, text, group).toPandas()
    raw, target = np.zeros(FEATURES), np.zeros(FEATURES)
    np.add.at(raw, counts["feature"].to_numpy(int), counts["n"].to_numpy(float))
    aim = counts[counts["g"] == 1]
    target[aim["feature"].to_numpy(int)] = aim["n"].to_numpy()
    ratio = np.zeros(FEATURES)
    if target.sum() > 0:
        for part in (slice(0, 1 << BITS), slice(1 << BITS, FEATURES)):
            t, r = target[part], raw[part]
            # Both are smoothed toward the raw model, so a feature seen in neither has ratio 1.
            prior = (r + 1e-3) / (r.sum() + 1e-3 * len(r))
            t = (t + smoothing * len(r) * prior * 0.01) / (t.sum() + smoothing * len(r) * 0.01)
            ratio[part] = np.log(t / prior)
    return ImportanceModel(ratio)


def weigh(docs: DataFrame, model: ImportanceModel, text: str = "text", into: str = "importance") -> DataFrame:
    """Add a struct column: n_features, log_weight, mean_log_weight, accepted.

    A text without words (null, empty) has weight 0 and is accepted: nothing speaks against it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_features long, log_weight double, mean_log_weight double, accepted boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            n, total, toxic = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for i, t in enumerate(texts):
                found = features(t)
                n[i], total[i] = len(found), known.log_ratio[found].sum()
                toxic[i] = known.toxicity(found)
            mean = total / np.maximum(n, 1)
            good = (mean >= known.min_mean) | (total >= known.min_total)
            good &= toxic <= known.max_toxic
            yield pd.DataFrame({"n_features": n, "log_weight": total, "mean_log_weight": mean, "accepted": good})

    return docs.withColumn(fresh(docs, into), of(col(text).cast("string")))


def choose_cut(scored: DataFrame, lost: float = 0.001, at_least: int = 1) -> float:
    """The mean weight below which documents are rejected, from (mean, good) of labelled rows.

    It is the largest cut, in steps of 0.002, that rejects at most about the share ``lost`` of
    good rows, or ``at_least`` so many of them. The driver receives a histogram of fixed size. Without good rows nothing is rejected.
    """
    bins = scored.selectExpr("CAST(floor(greatest(-8D, least(8D, mean)) * 500) AS INT) AS bin", "good").groupBy("bin", "good").count().toPandas()
    good = bins[bins["good"]].sort_values("bin")
    if good.empty:
        return -np.inf
    below = good["count"].cumsum().to_numpy()
    first = int(np.searchsorted(below, max(at_least, lost * below[-1]), side="right"))
    return float(good["bin"].to_numpy()[min(first, len(good) - 1)]) / 500


def fit_toxic(marked: DataFrame, smoothing: float = 0.5, errors: float = 4.0) -> np.ndarray | None:
    """Log ratio of the shares of toxic and other texts with each feature, less ``errors`` standard errors, from (text, toxic).

    The driver receives at most two rows per feature. None if either group has no words.
    """
    counts = count_features(marked, "text", "toxic", once=True).toPandas()
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if set(counts["g"]) != {0, 1}:
        return None
    seen = np.zeros((2, FEATURES))
    np.add.at(seen, (counts["g"].to_numpy(int), counts["feature"].to_numpy(int)), counts["n"].to_numpy(float))
    seen += smoothing
    bound = np.log(seen[1] / (sizes[1] + 1)) - np.log(seen[0] / (sizes[0] + 1)) - errors * np.sqrt(1 / seen[0] + 1 / seen[1])
    return np.maximum(bound, 0)


def label_marks(labels: DataFrame, key: str, label_rows: int) -> DataFrame:
    """(_id, _good, _toxic, _held) of about ``label_rows`` labelled ids at most, chosen by a hash of the id."""
    marks = labels.groupBy(col(key).alias("_id")).agg(F.min(F.expr("quality = 1 AND coalesce(toxic, 0) = 0")).alias("_good"), F.max(F.expr("CAST(toxic = 1 AS INT)")).alias("_toxic"))
    marks = stored(marks.filter("_id IS NOT NULL AND _good IS NOT NULL"), "label-marks")
    part = min(1.0, label_rows / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30))))
    return chosen.withColumn("_held", F.crc32(F.col("_id").cast("string").cast("binary")) % 4 == 2)


def fit_classifier(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_rows: int = 100_000) -> ImportanceModel:
    """Fit on good labelled texts (quality 1, not toxic) against all texts; a quarter of the labels only sets the cut.

    A second decision, fitted on toxic against other labelled texts, rejects texts by their toxic n-grams. Its cut
    loses about one in 1,000 of all good labelled rows, and none while they are fewer: a quarter of few rows can't show so small a share.

    ``labels`` has (key, quality, toxic); of several labels of one id the worst counts. The fit
    uses at most about ``label_rows`` labels, so their ids are small enough to broadcast
    and the texts stay where they are. The raw model counts every text.
    """
    marks = F.broadcast(label_marks(labels, key, label_rows))
    rows = docs.select(col(key).alias("_key"), col(text).cast("string").alias("text"))
    marked = rows.join(marks, F.col("_key") == F.col("_id"), "left")
    model = fit_importance(marked.select("text", F.expr("CAST(coalesce(_good AND NOT _held, false) AS INT)").alias("aim")), "aim")
    judged = rows.join(marks.filter("_held"), F.col("_key") == F.col("_id"))
    model.min_mean = choose_cut(weigh(judged, model, into="w").select(F.col("w.mean_log_weight").alias("mean"), F.col("_good").alias("good")))
    told = rows.join(marks.filter("NOT _held AND _toxic IS NOT NULL"), F.col("_key") == F.col("_id"))
    model.toxic_ratio = fit_toxic(told.select("text", F.col("_toxic").alias("toxic")))
    if model.toxic_ratio is not None:
        labelled = rows.join(marks, F.col("_key") == F.col("_id"))
        model.max_toxic = choose_toxic_cut(labelled, model)
    return model


def choose_toxic_cut(labelled: DataFrame, model: ImportanceModel) -> float:
    """The toxicity above which documents are rejected; no text without toxic n-grams is."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.toxicity(features(t)) for t in texts], dtype=float)

    # A tenth of it, so that the histogram's range reaches to 80.
    return max(0.0, -10 * choose_cut(labelled.select((toxicity("text") / -10).alias("mean"), F.col("_good").alias("good")), at_least=0))


def resample(weighed: DataFrame, share: float, weight: str, key: str, seed: int = 17) -> DataFrame:
    """Gumbel top-k: add gumbel_key and selected for the round(share * rows) largest of log weight plus Gumbel noise.

    The noise comes from a hash of the key, so reruns agree. The k-th largest value is found by
    counting ever finer ranges, without sorting the table. Ties go to the smaller key;
    rows alike in value and key are selected together.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(key)), 11) + 0.5) / float(1 << 53)
    noisy = stored(weighed.withColumn("gumbel_key", col(weight) - F.log(-F.log(uniform))), "gumbel")
    total, low, high = noisy.agg(F.count("*"), F.min("gumbel_key"), F.max("gumbel_key")).first()
    k = int(round(share * total))
    if k <= 0 or total == 0:
        return noisy.withColumn("selected", F.lit(False))
    wanted = k
    value = F.col("gumbel_key")
    for _ in range(12):
        inside = noisy.filter(value.between(low, high))
        if high <= low or wanted <= 0 or inside.limit(20001).count() <= 20000:
            break
        width = (high - low) / 1024
        bins = inside.groupBy(F.least(F.floor((value - low) / width), F.lit(1023)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(value).alias("from"), F.max(value).alias("to")
        )
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if row["n"] >= wanted:
                low, high = row["from"], row["to"]
                break
            wanted -= row["n"]
    last = noisy.filter(value.between(low, high)).orderBy(value.desc(), col(key).asc_nulls_last()).offset(wanted - 1).limit(1).first()
    cut, tie = last["gumbel_key"], last[key]
    before = F.lit(True) if tie is None else col(key) <= F.lit(tie)
    return noisy.withColumn("selected", (value > cut) | ((value == cut) & F.coalesce(before, F.lit(False))))
