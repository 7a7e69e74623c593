"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import BLOCK_CHARS, col, fresh, text_blocks

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    """Languages in code point order, log P(bucket | language) and log P(language)."""

    languages: list[str]
    log_prob: np.ndarray  # (buckets + 1, languages); the last row is 0 and takes what is no n-gram
    log_prior: np.ndarray
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 16
    trained_on: dict = field(default_factory=dict)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point to lower-case letter; everything that is no letter becomes a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    table[0] = 0
    return table


def hashed_ngrams(points: np.ndarray, orders: tuple[int, ...], bits: int, carried: int = 0) -> np.ndarray:
    """(n-grams, one row per order) buckets at each position; bucket 2**bits for none.

    An n-gram never reaches over the end of a text (code point 0), and blanks alone are none. The first ``carried`` points
    stood at the end of the block before; n-grams that lie within them are none here.
    """
    none = np.uint32(1 << bits)
    out = np.full((len(orders), len(points)), none, np.uint32)
    ends = points == 0
    rolled = np.zeros(len(points), np.uint32)
    closed = np.zeros(len(points), bool)
    blank = np.ones(len(points), bool)
    n = len(points)
    for order in range(1, max(orders) + 1):
        if order > n:
            break
        m = n - order + 1
        rolled = rolled[:m] * np.uint32(0x01000193) + points[order - 1 :] + np.uint32(order)
        closed = closed[:m] | ends[order - 1 :]
        blank = blank[:m] & (points[order - 1 :] == 32)
        if order in orders:
            mixed = rolled ^ (rolled >> np.uint32(15))
            mixed = (mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
            mixed[closed | blank] = none
            mixed[: max(0, carried - order + 1)] = none
            out[orders.index(order), :m] = mixed
    return out


def letters_of(points: np.ndarray, before: int = 0) -> np.ndarray:
    """Letters in lower case, and each run of other characters as one blank; ``before`` is the folded point before."""
    folded = fold_table()[points]
    after = np.concatenate([np.array([before], np.uint32), folded[:-1]])
    return folded[(folded != 32) | (after != 32)]


def letter_blocks(texts, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Folded texts in blocks: (rows, points, carried).

    A text longer than a block comes in several blocks of its own, each with the last ``reach`` points of the one before in
    front, so that no n-gram is lost or counted twice.
    """
    long = [isinstance(t, str) and len(t) > BLOCK_CHARS for t in texts]
    for rows, points in text_blocks([None if is_long else t for t, is_long in zip(texts, long)]):
        yield rows, letters_of(points), 0
    for row, text in enumerate(texts):
        if not long[row]:
            continue
        carry = np.zeros(0, np.uint32)
        for start in range(0, len(text), BLOCK_CHARS):
            piece = text[start : start + BLOCK_CHARS].replace("\0", " ")
            folded = letters_of(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32), int(carry[-1]) if len(carry) else 0)
            whole = np.concatenate([carry, folded])
            yield np.array([row]), np.append(whole, np.uint32(0)), len(carry)
            carry = whole[len(whole) - min(reach, len(whole)) :] if reach else whole[-1:]


def train_language_model(
    docs: DataFrame, text: str = "text", label: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, alpha: float = 0.5
) -> LanguageModel:
    """Count hashed n-grams per language over all labelled rows.

    Each task counts into one array per language and hands on its non-zero cells, so
    the shuffle holds at most languages x buckets rows per task, summed map-side.
    The driver receives one row per language and bucket. Rows without label or text
    don't count; without any labelled row the model knows no language.
    """
    buckets = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for lang, part in batch.groupby("label", sort=False):
                total = totals.setdefault(lang, np.zeros(buckets + 1, np.int64))
                seen[lang] = seen.get(lang, 0) + len(part)
                for _, points, carried in letter_blocks(list(part["text"]), max(orders) - 1):
                    for row in hashed_ngrams(points, orders, bits, carried):
                        total += np.bincount(row, minlength=buckets + 1)
        for lang, total in totals.items():
            cells = np.flatnonzero(total[:buckets])
            yield pd.DataFrame({"label": lang, "bucket": np.append(cells, -1), "n": np.append(total[cells], seen[lang])})

    rows = docs.select(col(text).cast("string").alias("text"), col(label).cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    counts = rows.mapInPandas(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique())
    table = np.zeros((buckets + 1, len(languages)))
    seen = np.zeros(len(languages))
    place = counts["label"].map({lang: i for i, lang in enumerate(languages)}).to_numpy(int)
    grams = counts["bucket"].to_numpy() >= 0
    table[counts["bucket"].to_numpy()[grams], place[grams]] = counts["n"].to_numpy()[grams]
    seen[place[~grams]] = counts["n"].to_numpy()[~grams]
    log_prob = np.log(table + alpha) - np.log(table[:buckets].sum(axis=0) + alpha * buckets) if languages else table
    log_prob[buckets] = 0
    return LanguageModel(languages, log_prob, np.log(seen / max(seen.sum(), 1)) if languages else seen, tuple(orders), bits, dict(zip(languages, seen)))


def score_texts(texts, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text under each language, and its number of letters' n-grams.

    The batch is a sparse matrix in row form (bucket indices, row starts, all values 1);
    its product with the log-probability matrix is a gather and a segmented sum.
    """
    total = np.zeros((len(texts), len(model.languages)))
    letters = np.zeros(len(texts), np.int64)
    none = 1 << model.bits
    for rows, points, carried in letter_blocks(texts, max(model.orders) - 1):
        starts = np.append(0, np.flatnonzero(points == 0)[:-1] + 1)
        for buckets in hashed_ngrams(points, model.orders, model.bits, carried):
            for i in range(len(model.languages)):
                np.add.at(total[:, i], rows, np.add.reduceat(model.log_prob[:, i][buckets], starts))
            np.add.at(letters, rows, np.add.reduceat((buckets != none).astype(np.int64), starts))
    return total, letters


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """Add a struct column ``into`` of (lang_pred, score) for every row.

    ``score`` is the posterior of the predicted language. A null text, a text without
    letters (empty ones too), or a model without languages gives ``und`` with score 0.
    Equal posteriors go to the smaller language name. All other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array(known.languages + [UNDETERMINED], object)
        for texts in batches:
            total, letters = score_texts(list(texts), known)
            if not known.languages:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0})
                continue
            total += known.log_prior
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            best[letters == 0] = len(known.languages)
            yield pd.DataFrame({"lang_pred": names[best], "score": np.where(letters == 0, 0.0, share)})

    name = fresh(docs, into)
    return docs.withColumn(name, predict(col(text).cast("string")))
