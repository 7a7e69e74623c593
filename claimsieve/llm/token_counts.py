"""Tokens attributed to the sections of a document.

A document is encoded once, as a whole, so its count doesn't depend on where sections begin. Token
character spans are then joined with the section spans by interval. A token that crosses a
boundary goes by an explicit rule:

* ``majority``: to the section that holds most of its characters, the earlier of equals;
* ``start``: to the section of its first character;
* ``end``: to the section of its last character.

A token that has only part of a character's bytes counts as covering that character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, join_tree, load_codec
from .frames import col, fresh

RULES = ("majority", "start", "end")
#: Texts longer than this are encoded in leaves.
LEAF_CHARS = 1 << 16


def encode_whole(codec: Codec, text: str) -> np.ndarray:
    if len(text) <= LEAF_CHARS:
        return codec.encode(text)
    return join_tree(codec, [(text[a : a + LEAF_CHARS], codec.encode(text[a : a + LEAF_CHARS])) for a in range(0, len(text), LEAF_CHARS)])


def token_spans(codec: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token."""
    stops = np.cumsum(codec.byte_length[encode_whole(codec, text)])
    starts = np.append(0, stops[:-1])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[stops - 1] + 1


def line_starts(text: str) -> np.ndarray:
    """Where lines begin; a line holds its own line feed."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.append(0, np.flatnonzero(points == 10) + 1)
    return starts[starts < max(len(points), 1)]


def attribute(starts: np.ndarray, stops: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section; ``sections`` are the starts of consecutive sections from 0 on."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, stops - 1, side="right") - 1
    chosen = last if rule == "end" else first
    if rule == "majority":
        chosen = first.copy()
        for i in np.flatnonzero(first != last):
            borders = np.clip(sections[first[i] + 1 : last[i] + 1], starts[i], stops[i])
            held = np.diff(np.concatenate([[starts[i]], borders, [stops[i]]]))
            chosen[i] = first[i] + int(np.argmax(held))
    return np.bincount(chosen, minlength=len(sections))


def section_token_counts(docs: DataFrame, tokenizer: str, keys: list[str], text: str = "text", starts: str | None = None, rule: str = "majority") -> DataFrame:
    """(keys, section, start, stop, n_tokens): a row per section of every row of ``docs``, sections counted from 0.

    ``starts`` names a column of ascending section starts in characters (array<int>, 0 is added if missing); without it
    sections are lines, each with its line feed. Sections cover the text, so their counts add up
    to the whole text's. A null or empty text has one empty section. Rows may repeat; other columns are left out.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    chosen = docs.select(*[col(k) for k in keys])
    value = F.struct(F.coalesce(col(text).cast("string"), F.lit("")).alias("t"), (col(starts) if starts else F.lit(None)).cast("array<long>").alias("s"))

    @F.pandas_udf("array<struct<start long, stop long, n_tokens long>>")
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        codec = load_codec(tokenizer)
        for batch in batches:
            rows = []
            for t, s in zip(batch["t"], batch["s"]):
                if s is None:
                    sections = line_starts(t)
                else:
                    sections = np.unique(np.append(0, np.asarray(s, np.int64)))
                    sections = sections[(sections >= 0) & (sections < max(len(t), 1))]
                found = attribute(*token_spans(codec, t), sections, rule) if t else np.zeros(len(sections), np.int64)
                stops = np.append(sections[1:], len(t))
                rows.append([{"start": a, "stop": b, "n_tokens": n} for a, b, n in zip(sections.tolist(), stops.tolist(), found.tolist())])
            yield pd.Series(rows, dtype=object)

    number, one = fresh(chosen, "section"), fresh(chosen, "one")
    spread = docs.select(*[col(k) for k in keys], F.posexplode(counts(value)).alias(number, one))
    return spread.select(*[col(k) for k in keys], F.col(number).alias("section"), f"{one}.start", f"{one}.stop", f"{one}.n_tokens")
