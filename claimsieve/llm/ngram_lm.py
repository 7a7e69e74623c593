"""Scores of an interpolated bigram language model, its weights learnt on held-out counts.

    P(w | h) = a2 * c(h w) / c(h) + a1 * c(w) / N + a0 / (V + 1)

The weights depend on the bucket of c(h), by powers of two. They are learnt by
expectation-maximisation on a fold of the training texts, with counts from which that fold is deleted.

Counts are looked up in bulk. Texts are read once into chunks of about CHUNK_TOKENS tokens,
each with its own short word list. A chunk asks for the counts of its distinct words
and word pairs, one row per range of their hashes; the ranges sum what training chunks report and
answer every chunk in the order it asked. So a frequent word is one number per chunk, never a
hot key, and both shuffles grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .frames import col

CHUNK_TOKENS = 1 << 19
#: Word pairs per hash range, about.
RANGE_TOKENS = 1 << 20
#: Bytes of a text split into words at a time.
SLICE_BYTES = 1 << 22
BLANKS = b" \t\n\v\f\r"
#: Roles of a text: only scored, counted, counted and held out for the weights.
SCORED, COUNTED, FOLD = 0, 1, 2
WORDS, PAIRS, SIZES = 0, 1, 2
#: Weights (bigram, unigram, uniform) where no held-out text tells better.
DEFAULT_WEIGHTS = np.array([0.3, 0.6, 0.1])
CONTEXT_BUCKETS = 48


class WordList(dict):
    """Words in order of first sight. Number 0 is the end of a text, which also stands before its first word."""

    def __init__(self) -> None:
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def numbered(text: str | None, words: WordList) -> np.ndarray:
    """Numbers of a text's lower-cased (A-Z) words, then 0."""
    data = text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""
    parts, start = [], 0
    while start < len(data):
        stop = start + SLICE_BYTES
        while stop < len(data) and data[stop] not in BLANKS:
            stop += 1
        found = data[start:stop].split()
        parts.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
        start = stop
    return np.concatenate([*parts, np.zeros(1, np.int32)])


def pack(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def pairs_of(tokens: np.ndarray, words: int) -> np.ndarray:
    """One code per token: the token before it times the number of words, plus itself."""
    before = np.concatenate([np.zeros(1, np.int64), tokens[:-1].astype(np.int64)])
    return before * words + tokens


def read_chunks(docs: DataFrame, key: Column, text: Column, role: Column) -> DataFrame:
    """Texts as chunks of one role: ids, token counts, token numbers and word hashes."""

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made = TaskContext.get().partitionId(), 0
        filling: dict[int, tuple[WordList, list, list]] = {}
        filled: dict[int, int] = {}

        def flush(role: int) -> pd.DataFrame:
            nonlocal made
            words, ids, texts = filling.pop(role)
            filled[role] = 0
            made += 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            return pd.DataFrame({
                "chunk": [f"{task}-{made}"], "role": [role], "ids": [ids], "sizes": [pack(np.array([len(t) for t in texts], np.int64))],
                "tokens": [pack(np.concatenate(texts))], "hashes": [pack(hashes)], "n": [sum(map(len, texts))],
            })

        for batch in batches:
            for i, t, r in zip(batch["id"], batch["text"], batch["role"]):
                words, ids, texts = filling.setdefault(r, (WordList(), [], []))
                ids.append(i if isinstance(i, str) else None)
                texts.append(numbered(t, words))
                filled[r] = filled.get(r, 0) + len(texts[-1])
                if filled[r] >= CHUNK_TOKENS:
                    yield flush(r)
        for r in list(filling):
            yield flush(r)

    rows = docs.select(key.cast("string").alias("id"), text.cast("string").alias("text"), role.cast("int").alias("role"))
    return rows.mapInPandas(chunks, "chunk string, role int, ids array<string>, sizes binary, tokens binary, hashes binary, n long")


def ask(chunks: DataFrame, ranges: int) -> DataFrame:
    """Rows (kind, range, chunk, role, keys, counts) with the distinct words and pairs of each chunk, sorted by hash."""

    def split(kind: int, row, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(part)) + 1
        starts, stops = np.append(0, cuts), np.append(cuts, len(keys))
        # Within a range six bytes tell pairs apart; words keep all eight.
        raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if kind == WORDS else 6]
        return pd.DataFrame({
            "kind": kind, "range": part[starts].astype(np.int64), "chunk": row.chunk, "role": row.role,
            "keys": [raw[a:b].tobytes() for a, b in zip(starts, stops)],
            "counts": [pack(counts[a:b].astype(np.int64)) if row.role != SCORED else b"" for a, b in zip(starts, stops)],
        })

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                tokens, hashes = unpack(row.tokens, np.int32), unpack(row.hashes, np.uint64)
                yield split(WORDS, row, hashes, np.bincount(tokens, minlength=len(hashes)))
                codes, counts = np.unique(pairs_of(tokens, len(hashes)), return_counts=True)
                yield split(PAIRS, row, pair_hashes(hashes[codes // len(hashes)], hashes[codes % len(hashes)]), counts)

    return chunks.select("chunk", "role", "tokens", "hashes").mapInPandas(asked, "kind int, range long, chunk string, role int, keys binary, counts binary")


def answer(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    """Total counts for each chunk's keys of one range; for chunks of the fold also those without the fold."""
    kind = int(key[0])
    width = 8 if kind == WORDS else 6
    keys, starts = [], [0]
    for raw in asked["keys"]:
        wide = np.zeros((len(raw) // width, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
        keys.append(wide.view("<u8").ravel())
        starts.append(starts[-1] + len(keys[-1]))
    found, place = np.unique(np.concatenate(keys), return_inverse=True)
    total, rest = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    for role, counts, a, b in zip(asked["role"], asked["counts"], starts, starts[1:]):
        if role != SCORED:
            np.add.at(total, place[a:b], unpack(counts, np.int64))
        if role == COUNTED:
            np.add.at(rest, place[a:b], unpack(counts, np.int64))
    out = pd.DataFrame({
        "chunk": asked["chunk"], "kind": kind, "range": int(key[1]),
        "total": [pack(total[place[a:b]]) for a, b in zip(starts, starts[1:])],
        "rest": [pack(rest[place[a:b]]) if role == FOLD else b"" for role, a, b in zip(asked["role"], starts, starts[1:])],
        "known": 0, "known_rest": 0,
    })
    if kind == WORDS:
        sizes = pd.DataFrame({"chunk": [None], "kind": [SIZES], "range": [int(key[1])], "total": [b""], "rest": [b""], "known": [int((total > 0).sum())], "known_rest": [int((rest > 0).sum())]})
        out = pd.concat([out, sizes])
    return out


def bring(chunk: pd.DataFrame, which: str) -> tuple:
    """A chunk's row, and its tokens' own counts, counts of the token before, and pair counts."""
    row = chunk[chunk["kind"] < 0].iloc[0]
    tokens, hashes = unpack(row["tokens"], np.int32), unpack(row["hashes"], np.uint64)

    def counts(kind: int, keys: np.ndarray) -> np.ndarray:
        parts = chunk[chunk["kind"] == kind].sort_values("range")[which]
        out = np.empty(len(keys), np.int64)
        out[np.argsort(keys)] = np.concatenate([unpack(p, np.int64) for p in parts])
        return out

    single = counts(WORDS, hashes)
    codes, place = np.unique(pairs_of(tokens, len(hashes)), return_inverse=True)
    pairs = counts(PAIRS, pair_hashes(hashes[codes // len(hashes)], hashes[codes % len(hashes)]))[place]
    before = np.concatenate([np.zeros(1, np.int32), tokens[:-1]])
    return row, single[tokens], single[before], pairs


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never counted, then 1 + the power of two."""
    return np.minimum(np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0), CONTEXT_BUCKETS - 1)


def held_out_cells(chunk: pd.DataFrame, tokens: int) -> pd.DataFrame:
    """Tokens of a chunk of the fold, by context bucket and by both estimates in eighths of a bit; -1 for an estimate of 0."""
    _, single, before, pairs = bring(chunk, "rest")
    with np.errstate(divide="ignore", invalid="ignore"):
        second = np.where(pairs > 0, np.rint(-8 * np.log2(pairs / before)), -1).astype(np.int64)
        first = np.where(single > 0, np.rint(-8 * np.log2(single / max(tokens, 1))), -1).astype(np.int64)
    cells = pd.DataFrame({"bucket": context_bucket(before), "second": second, "first": first})
    return cells.groupby(["bucket", "second", "first"], as_index=False).size().rename(columns={"size": "n"})


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights per context bucket by expectation-maximisation; all stay positive, but the bigram's for unseen contexts."""

    def fit(part: pd.DataFrame, bigram: bool) -> np.ndarray:
        n = part["n"].to_numpy(float)
        chances = np.column_stack([
            np.where(part["second"] >= 0, 2.0 ** (-part["second"] / 8), 0) * bigram,
            np.where(part["first"] >= 0, 2.0 ** (-part["first"] / 8), 0), np.full(len(part), uniform),
        ])
        weights = DEFAULT_WEIGHTS * [bigram, 1, 1]
        weights = weights / weights.sum()
        for _ in range(rounds):
            share = chances * weights
            weights = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) + [1e-3 * bigram, 1e-3, 1e-3]
            weights = weights / weights.sum()
        return weights

    seen = cells[cells["bucket"] > 0]
    usual = fit(seen, True) if len(seen) else DEFAULT_WEIGHTS
    table = np.tile(usual, (CONTEXT_BUCKETS, 1))
    table[0] = [0, *(usual[1:] / usual[1:].sum())]
    for bucket, part in cells.groupby("bucket"):
        table[int(bucket)] = fit(part, bucket > 0)
    return table


@dataclass
class Model:
    weights: np.ndarray
    tokens: int
    words: int


def score_chunk(chunk: pd.DataFrame, model: Model) -> pd.DataFrame:
    row, single, before, pairs = bring(chunk, "total")
    sizes = unpack(row["sizes"], np.int64)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    weights = model.weights[context_bucket(before)]
    chance = weights[:, 0] * pairs / np.maximum(before, 1) + weights[:, 1] * single / max(model.tokens, 1) + weights[:, 2] / (model.words + 1)
    base = np.log10((single + 1) / (model.tokens + model.words + 1))
    return pd.DataFrame({
        "id": list(row["ids"]), "role": int(row["role"]), "n_tokens": sizes, "n_known": np.add.reduceat((single > 0).astype(np.int64), starts),
        "train_tokens": model.tokens, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(chance), starts),
    })


def score_documents(docs: DataFrame, held_out: Column, fold: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Texts where ``held_out`` is true are only scored; a null counts as false. Those in
    ``fold`` also set the weights. A text's tokens are its words, then one end; a null text is an
    empty one. ``base_score`` is the add-one unigram score, ``score`` the model's, both log10
    of the whole text. Without training texts every token has probability 1. Repeated
    rows stay, and other columns are not read.
    """
    role = F.when(F.coalesce(held_out, F.lit(False)), SCORED).when(F.coalesce(fold, F.lit(False)), FOLD).otherwise(COUNTED)
    chunks = stored(read_chunks(docs, col(key), col(text), role), "lm-chunks")
    sums = chunks.groupBy("role").agg(F.sum("n").alias("n")).collect()
    tokens = {r["role"]: r["n"] for r in sums}
    ranges = max(32, math.ceil(sum(tokens.values()) / RANGE_TOKENS))
    answers = ask(chunks, ranges).groupBy("kind", "range").applyInPandas(
        answer, "chunk string, kind int, range long, total binary, rest binary, known long, known_rest long"
    )
    answers = stored(answers, "lm-counts")
    known, known_rest = answers.filter(f"kind = {SIZES}").agg(F.sum("known"), F.sum("known_rest")).first()
    told = answers.filter("chunk IS NOT NULL").select("chunk", "kind", "range", "total", "rest")

    def gathered(rows: DataFrame, which: DataFrame) -> DataFrame:
        plain = rows.select("chunk", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("range"), "role", "ids", "sizes", "tokens", "hashes")
        return plain.unionByName(which, allowMissingColumns=True)

    in_fold = told.filter("length(rest) > 0").drop("total")
    rest_tokens = tokens.get(COUNTED, 0)
    cells = gathered(chunks.filter(f"role = {FOLD}"), in_fold).groupBy("chunk").applyInPandas(
        lambda chunk: held_out_cells(chunk, rest_tokens), "bucket long, second long, first long, n long"
    )
    cells = cells.groupBy("bucket", "second", "first").agg(F.sum("n").alias("n")).toPandas()
    model = Model(learn_weights(cells, 1 / ((known_rest or 0) + 1)), rest_tokens + tokens.get(FOLD, 0), known or 0)

    scores = gathered(chunks, told.drop("rest")).groupBy("chunk").applyInPandas(
        lambda chunk: score_chunk(chunk, model),
        "id string, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    kind = docs.select(col(key)).schema[0].dataType
    return scores.select(
        F.col("id").cast(kind).alias(key), (F.col("role") == SCORED).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
