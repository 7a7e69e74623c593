"""Byte-pair encoding of whole texts, with long texts encoded as a tree of halves, and decoding.

A text longer than ``leaf_chars`` is cut into leaves of equal length at any
character. The leaves are rows of their own, so many tasks encode one text. Two
neighbours are then joined by re-encoding a window around the join, which grows
until it agrees with both sides:

* it may start and end where the pre-tokenizer always cuts, whatever stands
  around (a letter before a blank, say), since tokens never reach over such a
  place and the rest of either side is not affected; or
* inside one run of letters, digits, signs or blanks, where it must begin with
  the token that the left side has there, and end with the token that the right
  side has there. All neighbouring tokens are then neighbours in the encoding of
  one and the same pre-token, and a sequence whose neighbouring pairs all are
  valid is the only encoding of that pre-token.

A window that reaches both ends of the two sides is the plain encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import col, fresh

#: The pre-tokenizer pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of character kinds between which the pre-tokenizer always cuts: letter, number, sign, blank.
ALWAYS_CUT = {"LN", "LP", "LS", "NL", "NP", "NS", "PN", "PS"}


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tokens of a byte-level BPE tokenizer file in JSON; enough to decode."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        self.read(path, model, special, ranks)
        self.token_bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        for token, i in special.items():
            self.token_bytes[i] = token.encode()

    def read(self, path: str, model: dict, special: dict[str, int], ranks: dict[bytes, int]) -> None:
        """What a subclass needs besides."""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


class Codec(Vocabulary):
    """A vocabulary that encodes, too."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.byte_length = np.array([len(b) for b in self.token_bytes], np.int64)
        self._kinds: dict[str, str] = {}

    def read(self, path: str, model: dict, special: dict[str, int], ranks: dict[bytes, int]) -> None:
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path} ranks its merges in another order than its ids")
        self.special = special
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def kind(self, c: str) -> str:
        """L, N, P or S: letter, number, sign, blank."""
        found = self._kinds.get(c)
        if found is None:
            found = "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) else "P"
            self._kinds[c] = found
        return found

    def in_special(self, text: str, at: int) -> bool:
        """Whether a special token's string covers both sides of a place."""
        for token in self.special:
            n = len(token)
            if text.find(token, max(0, at - n + 1), at + n - 1) >= 0:
                return True
        return False

    def always_cut(self, text: str, at: int) -> bool:
        return 0 < at < len(text) and self.kind(text[at - 1]) + self.kind(text[at]) in ALWAYS_CUT and not self.in_special(text, at)

    def same_run(self, text: str) -> bool:
        return len({self.kind(c) for c in text}) == 1


@lru_cache(maxsize=4)
def load_codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def char_distances(text: str, tokens: np.ndarray) -> np.ndarray:
    """For byte distances of token borders from the start of ``text``: distances in characters, -1 inside a character."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    at = np.searchsorted(ends, tokens)
    return np.where(ends[np.minimum(at, len(ends) - 1)] == tokens, at + 1, -1)


def join_encodings(codec: Codec, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray], window: int = 16) -> tuple[str, np.ndarray]:
    """The encoding of two neighbouring texts together, from their encodings. ``window`` is in tokens a side."""
    (left_text, left_ids), (right_text, right_ids) = left, right
    if not left_text or not right_text:
        return left_text + right_text, np.concatenate([left_ids, right_ids])
    while True:
        n, m = min(window, len(left_ids)), min(window, len(right_ids))
        back = np.cumsum(codec.byte_length[left_ids[::-1][:n]])
        ahead = np.cumsum(codec.byte_length[right_ids[:m]])
        before, after = left_text[-(int(back[-1]) + 16) :], right_text[: int(ahead[-1]) + 16]
        near, middle = before + after, len(before)
        starts = [(t + 1, middle - int(d)) for t, d in enumerate(char_distances(before[::-1], back)) if d > 0]
        stops = [(t + 1, middle + int(d)) for t, d in enumerate(char_distances(after, ahead)) if d > 0]

        start = next(((t, p, False) for t, p in starts if codec.always_cut(near, p)), None)
        if start is None and n == len(left_ids):
            start = (n, middle - len(left_text), False)
        if start is None:
            start = next(((t, p, True) for t, p in reversed(starts) if p >= 3 and codec.same_run(near[p - 3 : p + 2]) and not codec.in_special(near, p)), None)
        stop = next(((t, p, False) for t, p in stops if codec.always_cut(near, p)), None)
        if stop is None and m == len(right_ids):
            stop = (m, middle + len(right_text), False)
        if stop is None:
            # The run must reach from before the join to behind the window's end.
            inside = ((t, p, True) for t, p in reversed(stops) if p > middle and p + 1 < len(near) and not codec.in_special(near, p))
            stop = next((x for x in inside if codec.same_run(near[min(middle - 1, x[1] - 3) : x[1] + 2])), None)
        if start and stop:
            ids = codec.encode(near[start[1] : stop[1]])
            agrees = (not start[2] or ids[0] == left_ids[-start[0]]) and (not stop[2] or ids[-1] == right_ids[stop[0] - 1])
            if agrees:
                return left_text + right_text, np.concatenate([left_ids[: len(left_ids) - start[0]], ids, right_ids[stop[0] :]])
        window *= 2


def join_tree(codec: Codec, leaves: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join neighbours in rounds until one encoding is left."""
    while len(leaves) > 1:
        pairs = [join_encodings(codec, *leaves[i : i + 2]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0][1]


def encode_texts(docs: DataFrame, tokenizer: str, keys: list[str], text: str = "text", into: str = "ids", leaf_chars: int = 1 << 16) -> DataFrame:
    """``keys`` and the token ids (array<int>) of each whole text, one row per row of ``docs``.

    Equal to the tokenizer's own ids without special tokens added; a special token's
    string in a text becomes that token. A null or empty text has no ids. Rows may
    repeat and keys may be null; other columns are left out, and where a key has the name ``into`` an underscore goes before it.
    ``tokenizer`` is a JSON file of a byte-level BPE vocabulary that every executor can read.
    """
    into = fresh(docs.select(*[col(k) for k in keys]), into)
    rows = docs.select(*[col(k) for k in keys], F.coalesce(col(text).cast("string"), F.lit("")).alias(name := fresh(docs.select(*[col(k) for k in keys]), "text")))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = load_codec(tokenizer)
        for texts in batches:
            yield pd.Series([codec.encode(t) for t in texts])

    short = rows.filter(F.length(name) <= leaf_chars).select(*[col(k) for k in keys], encode(name).alias(into))

    # Long texts: each distinct one is cut into leaf rows once; its ids are joined back to all rows that have it.
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, t in zip(batch["hash"], batch["text"]):
                for start in range(0, len(t), leaf_chars):
                    yield pd.DataFrame({"hash": [key], "leaf": [start // leaf_chars], "text": [t[start : start + leaf_chars]]})

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load_codec(tokenizer)
        for batch in batches:
            yield batch.assign(ids=[codec.encode(t).astype("<i4").tobytes() for t in batch["text"]])

    def grow(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("leaf")
        ids = join_tree(load_codec(tokenizer), [(t, np.frombuffer(b, "<i4")) for t, b in zip(leaves["text"], leaves["ids"])])
        return pd.DataFrame({"hash": [key[0]], "ids": [ids.astype(np.int32)]})

    long = rows.filter(F.length(name) > leaf_chars)
    texts = long.select(F.sha2(name, 256).alias("hash"), F.col(name).alias("text")).dropDuplicates(["hash"])
    leaves = texts.mapInPandas(cut, "hash string, leaf long, text string").repartition("hash", "leaf")
    leaves = leaves.mapInPandas(encode_leaves, "hash string, leaf long, text string, ids binary")
    grown = leaves.groupBy("hash").applyInPandas(grow, "hash string, ids array<int>")
    link = fresh(rows, "hash")
    grown = grown.select(F.col("hash").alias(link), F.col("ids").alias(into))
    joined = long.select(*[col(k) for k in keys], F.sha2(name, 256).alias(link)).join(grown, link)
    return short.unionByName(joined.select(*[col(k) for k in keys], col(into)))


def decode_ids(ids, tokenizer: str):
    """Column expression: the text of an array of ids, special tokens' strings included; null ids give an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load_vocabulary(tokenizer)
        for rows in batches:
            yield pd.Series([vocabulary.decode(np.asarray(r, np.int64)) if r is not None else "" for r in rows], dtype=object)

    return decode(ids)
