"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Candidates come from a pigeonring filter. The 64 bits form a ring of three
segments. If two fingerprints differ in at most two bits, some segment starts a
chain whose cumulative differences stay within proportional budgets (l * 2 / 3,
rounded down, for l segments): none in the first segment, at most one in the first
two, at most two in all three. "At most one in the second segment" means that one of
its halves is equal, so each chain start gives two join keys of 31 to 33 equal bits,
six keys per fingerprint at any table size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import connected_components
from .frames import col

SEED = 42
#: (first bit, width) of the ring's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 2
#: Members of a join key from which its links are made through shared neighbours instead of pairs.
PAIR_LIMIT = 64
#: Shingles hashed per numpy step.
STEP = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    set_bits = np.zeros(64, np.int64)
    for start in range(0, n, STEP):
        size = min(STEP, n - start)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, size), repeat(SEED)), np.uint64, size)
        by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            set_bits[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _BITS
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype=np.uint64).astype(np.int64)

    return of(text.cast("string"))


def _part(first: int, width: int) -> str:
    return f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"


def chain_keys() -> str:
    """SQL for the array of (start segment, key): a whole segment, and either half of the next one on the ring."""
    keys = []
    for i, (first, width) in enumerate(SEGMENTS):
        next_first, next_width = SEGMENTS[(i + 1) % len(SEGMENTS)]
        half = next_width // 2
        for j, (at, size) in enumerate(((next_first, half), (next_first + half, next_width - half))):
            code = f"shiftleft({_part(first, width)}, {size}) | {_part(at, size)}"
            keys.append(f"named_struct('start', {i}, 'key', shiftleft({2 * i + j}L, 40) | {code})")
    return f"array({', '.join(keys)})"


def chain_holds(a: str, b: str, start: str) -> str:
    """SQL: the chain's first two segments differ in no more than one bit, then all three in no more than two."""
    first_two = " ".join(
        f"WHEN {i} THEN bit_count(({a} ^ {b}) & {_mask(i) | _mask((i + 1) % len(SEGMENTS))}L) <= 1" for i in range(len(SEGMENTS))
    )
    return f"CASE {start} {first_two} END AND bit_count({a} ^ {b}) <= {MAX_BITS}"


def _mask(segment: int) -> int:
    first, width = SEGMENTS[segment]
    value = ((1 << width) - 1) << first
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints within two bits of each other.

    ``prints`` has one distinct long column ``fp``. Keys with at most PAIR_LIMIT
    members give their pairs within two bits. Members of other keys meet at the
    numbers one flipped bit away from them: two of them share such a number, or are one
    for each other, exactly if they differ in at most two bits; each is linked to the smallest
    one there. That takes 65 rows a member, however many of them are alike.
    """
    keyed = stored(prints.selectExpr("fp", f"inline({chain_keys()})"), "chain-keys")
    crowded = stored(keyed.groupBy("key").count().filter(F.col("count") > PAIR_LIMIT).select("key"), "crowded-keys")
    few = keyed.join(crowded, "key", "left_anti")
    pairs = few.alias("x").join(
        few.alias("y"), F.expr("x.key = y.key AND x.fp < y.fp AND " + chain_holds("x.fp", "y.fp", "x.start"))
    )
    pairs = pairs.selectExpr("x.fp AS a", "y.fp AS b")
    flips = ", ".join(["0L", *(f"shiftleft(1L, {k})" for k in range(64))])
    near = keyed.join(crowded, "key", "left_semi").select("fp").distinct().selectExpr("fp", f"explode(transform(array({flips}), f -> fp ^ f)) AS via")
    shared = near.groupBy("via").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1").select("via", "least")
    meeting = near.join(shared, "via").filter("fp > least").selectExpr("least AS a", "fp AS b")
    return pairs.union(meeting).distinct()


def simhash_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: (id, text_hash, fp, root, component_id).

    ``component_id`` is the smallest id reachable over links of at most two bits; null
    only if all ids there are null. ``root`` is the smallest fingerprint of the component
    and tells components apart. Null, empty and wordless texts have fingerprint 0 and
    link like any other. Repeated rows stay. Only id and text are read.
    """
    rows = docs.select(col(key).alias("id"), F.xxhash64(col(text).cast("string")).alias("text_hash"), fingerprint_column(col(text), width).alias("fp"))
    rows = stored(rows, "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = connected_components(fingerprint_links(prints.select("fp"))).selectExpr("node AS fp", "component")
    rooted = prints.join(roots, "fp", "left").selectExpr("fp", "least", "coalesce(component, fp) AS root")
    rooted = stored(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Keep one row of each component: that with the smallest id (nulls last), then the smallest hash of its text.

    Of rows alike in id and text one stays. Columns and their order stay as they are.
    """
    return keep_smallest(docs, simhash_classes(docs, key, text, width), key, text)


def keep_smallest(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The row of each ``root`` with the smallest id (nulls last), then the smallest hash of its text; of equal ones, one."""
    best = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("best"))
    chosen = best.select(F.col("best.id").alias("id"), F.col("best.text_hash").alias("text_hash"))
    copies = classes.groupBy("id", "text_hash").agg(F.count("*").alias("n"))
    chosen = stored(
        chosen.alias("c").join(copies.alias("n"), F.expr("c.id <=> n.id AND c.text_hash = n.text_hash")).selectExpr("c.id", "c.text_hash", "n"), "chosen"
    )
    same = col(key).eqNullSafe(F.col("_kept.id")) & (F.xxhash64(col(text).cast("string")) == F.col("_kept.text_hash"))
    single = docs.join(chosen.filter("n = 1").alias("_kept"), same, "left_semi")
    repeated = docs.join(chosen.filter("n > 1").alias("_kept"), same, "left_semi")
    return single.union(repeated.dropDuplicates([key, text]))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
