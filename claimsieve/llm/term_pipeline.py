"""Ranked lexical search by a pipeline of term owners.

The terms of all items are dealt to owners by weight, the rarest terms to the first. Items form groups, documents
form blocks, and a bundle is a group of items on its way through a block: it carries the documents' lengths and,
for each item, a sparse accumulator of the documents that have scored so far. At each stage the
bundles meet the owner's postings by cogroup, its integer contributions are added, and the
bundle goes on. After the last stage each bundle gives its best documents per item.

A bundle also knows what an item can still gain at most in the stages to come. Where the k-th best sum of a
block can't be reached any more, a document leaves the accumulator, and new ones don't enter: contributions are never
negative, so what is left out can't be among the block's k best.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from .frames import col


@dataclass(frozen=True)
class Sizes:
    """Bounds of what one task holds; results don't depend on them.

    A bundle has at most ``block_docs`` times ``group_items`` cells, or a few more, since items are dealt to groups by hash. A block ends early at
    ``block_postings`` postings. ``slots`` is the size of the map that tells which words can be terms of an
    item; a word that only shares a slot with a term is left out by the exact join later.
    """

    block_docs: int = 4096
    block_postings: int = 1 << 21
    group_items: int = 256
    stages: int = 4
    slots: int = 1 << 22


#: Fixed values of the score: saturation scale, and the parts of a document's length measure.
SCALE, FLOOR, SHARE, LENGTH_WEIGHT = 10**9, 100 - 90, 90, 8

#: Fixed value: term characters are ASCII digits and letters and all characters beyond ASCII; A-Z become a-z.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order and with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if isinstance(text, str) else []


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) once each; rows with one id, null included, are one item."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, t) for k, x in zip(batch["item"], batch["text"]) for t in set(terms_of(x))]
            yield pd.DataFrame(found, columns=["item", "term"])

    rows = items.select(col(key).cast("string").alias("item"), col(text).cast("string").alias("text"))
    pairs = rows.mapInPandas(split, "item string, term binary").distinct()
    return pairs.select(F.col("item").cast("long").alias("item"), "term")


def slot_map(terms: DataFrame, slots: int) -> bytes:
    """A byte per slot, 1 if a term falls there; of fixed size whatever the number of terms."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.zeros(slots, np.uint8)
        for batch in batches:
            marks[[crc32(t) % slots for t in batch["term"]]] = 1
        yield pd.DataFrame({"marks": [np.packbits(marks).tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots // 8, np.uint8)
        for batch in batches:
            for marks in batch["marks"]:
                total |= np.frombuffer(marks, np.uint8)
        yield pd.DataFrame({"marks": [total.tobytes()]})

    # A few maps merge into one per round, so no task takes many.
    maps = terms.coalesce(64).mapInPandas(mark, "marks binary").coalesce(8).mapInPandas(merge, "marks binary")
    total = np.zeros(slots // 8, np.uint8)
    for row in maps.toLocalIterator():
        total |= np.frombuffer(row["marks"], np.uint8)
    return np.unpackbits(total).tobytes()


def block_postings(docs: DataFrame, terms: DataFrame, key: str, text: str, sizes: Sizes) -> DataFrame:
    """Blocks of documents and their postings, written as a table.

    A row (block, term, df, most, places, counts) has the places of a term's documents in the block, two bytes
    each, and its occurrences there, four bytes each. The row without term has the ids of the block's documents
    and their lengths in terms. Blocks are made where the documents are read; nothing is shuffled.
    """
    slots = docs.sparkSession.sparkContext.broadcast(slot_map(terms, sizes.slots))
    most_docs, most_postings, slot_count = sizes.block_docs, sizes.block_postings, sizes.slots

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marked, part, number = slots.value, TaskContext.get().partitionId(), 0
        places: dict[bytes, array] = {}
        counts: dict[bytes, array] = {}
        ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def block() -> pd.DataFrame:
            names = list(places)
            rows = [(t, len(places[t]), max(counts[t]), places[t].tobytes(), counts[t].tobytes()) for t in names]
            size = np.array(lengths, np.int64)
            rows.append((None, int((size > 0).sum()), int(size.sum()), pack_ids(ids), size.tobytes()))
            frame = pd.DataFrame(rows, columns=["term", "df", "most", "places", "counts"])
            frame.insert(0, "block", (part << 32) + number)
            return frame

        for batch in batches:
            for name, body in zip(batch["id"], batch["text"]):
                words = terms_of(body)
                place = len(ids)
                ids.append(int(name) if isinstance(name, str) else None)
                lengths.append(len(words))
                for term, n in Counter(words).items():
                    if marked[crc32(term) % slot_count]:
                        if term not in places:
                            places[term], counts[term] = array("H"), array("I")
                        places[term].append(place)
                        counts[term].append(n)
                        held += 1
                if len(ids) == most_docs or held >= most_postings:
                    yield block()
                    places, counts, ids, lengths, held, number = {}, {}, [], [], 0, number + 1
        if ids:
            yield block()

    rows = docs.select(col(key).cast("long").cast("string").alias("id"), col(text).cast("string").alias("text"))
    return stored(rows.mapInPandas(index, "block long, term binary, df long, most long, places binary, counts binary"), "postings")


def weighted_terms(pairs: DataFrame, postings: DataFrame, documents: int, sizes: Sizes) -> DataFrame:
    """(grp, place, item, term, w, owner, gain): each term of each item with its weight, owner and largest contribution."""
    names = pairs.select(F.col("item").alias("name")).distinct()
    groups = max(1, -(-names.count() // sizes.group_items))
    names = names.withColumn("grp", F.pmod(F.xxhash64("name"), F.lit(groups)).cast("int"))
    names = names.withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy("name")) - 1)
    placed = pairs.join(names, F.col("item").eqNullSafe(F.col("name"))).drop("name")
    totals = postings.filter("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    n = float(2 * documents + 2)
    w = F.floor(F.lit(1000.0) * F.log(F.lit(n) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    found = placed.join(totals, "term").withColumn("w", w)
    top = 1000.0 * math.log(n)
    owner = F.greatest(F.lit(0), F.least(F.lit(sizes.stages - 1), F.floor((1 - F.col("w") / top) * sizes.stages))).cast("int")
    gain = F.expr(f"w * (({SCALE} * most) DIV (1000 * most + {LENGTH_WEIGHT * FLOOR}))")
    return found.select("grp", "place", "item", "term", "w", owner.alias("owner"), gain.alias("gain"))


def length_measures(sizes: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """m of each document; Python's integers, since the product may pass 64 bits."""
    return np.array([FLOOR + SHARE * n * documents // max(occurrences, 1) for n in sizes.tolist()], np.int64)


#: Ids (eight bytes each, then a byte each that tells whether there is one) and sizes of the documents, the same ids of
#: the items, what each item can gain from each stage on, and the accumulators: cells, item by item, with their sums.
BUNDLE = "block long, grp int, ids binary, sizes binary, items binary, potential binary, cells binary, sums binary"


def pack_ids(ids: list[int | None]) -> bytes:
    known = np.array([i is not None for i in ids], np.uint8)
    return np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes()


def unpack_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and whether each is one."""
    n = len(data) // 9
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)


def kth_best(sums: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest sum of each item; 0 with fewer documents."""
    if sums.shape[1] < k:
        return np.zeros(len(sums), np.int64)
    return np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k]


def run_stage(bundle, postings: pd.DataFrame, stage: int, k: int, corpus: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators (cells, sums) of a bundle after one owner's contributions; ``corpus`` is (documents, occurrences)."""
    measures = length_measures(np.frombuffer(bundle.sizes, np.int64), *corpus)
    width = len(bundle.items) // 9
    potential = np.frombuffer(bundle.potential, np.int64).reshape(-1, width)
    sums = np.zeros((potential.shape[1], len(measures)), np.int64)
    sums.ravel()[np.frombuffer(bundle.cells, np.uint32)] = np.frombuffer(bundle.sums, np.int64)
    # An item is closed if what is left can't lift a new document to its k-th best.
    closed = potential[stage] < kth_best(sums, k)
    barred = (sums == 0) & closed[:, None]
    for p in postings.itertuples(index=False):
        places, tf = np.frombuffer(p.places, np.uint16), np.frombuffer(p.counts, np.uint32).astype(np.int64)
        added = p.w * ((SCALE * tf) // (1000 * tf + LENGTH_WEIGHT * measures[places]))
        for item in p.items:
            # A document stands once in a posting list.
            sums[item, places] += added
    sums[barred] = 0
    kept = (sums > 0) & (sums + potential[stage + 1][:, None] >= kth_best(sums, k)[:, None])
    cells = np.flatnonzero(kept)
    return cells, sums.ravel()[cells]


def best_cells(bundle, cells: np.ndarray, sums: np.ndarray, k: int) -> pd.DataFrame:
    """(item_id, doc_id, score): the k best documents of each item in the bundle's block."""
    names, known = unpack_ids(bundle.ids)
    items, given = unpack_ids(bundle.items)
    item, place = np.divmod(cells, max(1, len(names)))
    order = np.lexsort((names[place], ~known[place], -sums, item))
    item, place, sums = item[order], place[order], sums[order]
    first = np.arange(len(item)) - np.searchsorted(item, item) < k
    item, place, sums = item[first], place[first], sums[first]
    nullable = pd.arrays.IntegerArray
    return pd.DataFrame({"item_id": nullable(items[item], ~given[item]), "doc_id": nullable(names[place], ~known[place]), "score": sums})


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each item, ties to the smaller id.

    Keys are integers. Rows of ``items`` with one id, null included, are one item with the terms of all of them; each row
    of ``docs`` is a document of its own, one without id comes after equal scores with id. Null texts have no
    terms. Other columns are not read. An item without a document is not in the result.
    """
    pairs = stored(item_terms(items, item_key, item_text), "item-terms")
    postings = block_postings(docs, pairs.select("term"), key, text, sizes)
    blocks = postings.filter("term IS NULL")
    corpus = tuple(int(x or 0) for x in blocks.agg(F.sum("df"), F.sum("most")).first())
    weighted = stored(weighted_terms(pairs, postings, corpus[0], sizes), "weighted-terms")

    stages = sizes.stages

    def potential_of(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        width = int(part["place"].max()) + 1
        gains, names = np.zeros((stages + 1, width), np.int64), [None] * width
        for place, item, owner, gain in zip(part["place"], part["item"], part["owner"], part["gain"]):
            gains[owner, place] += int(gain)
            names[place] = int(item) if isinstance(item, str) else None
        potential = np.ascontiguousarray(gains[::-1].cumsum(axis=0)[::-1])
        return pd.DataFrame({"grp": [int(key[0])], "items": [pack_ids(names)], "potential": [potential.tobytes()]})

    summed = weighted.groupBy("grp", "place", "owner").agg(F.first(F.col("item").cast("string")).alias("item"), F.sum("gain").alias("gain"))
    groups = summed.groupBy("grp").applyInPandas(potential_of, "grp int, items binary, potential binary")

    # A posting list goes to each group that has its term, with the places of the items in the group.
    wanted = weighted.groupBy("owner", "grp", "term").agg(F.first("w").alias("w"), F.collect_list("place").alias("items"))
    owned = postings.filter("term IS NOT NULL").select("block", "term", "places", "counts").join(wanted, "term").drop("term")
    owned = stored(owned, "owned-postings")

    # A bundle for each block and group that has a term in it.
    nothing = F.lit(b"").cast("binary")
    bundles = owned.select("block", "grp").distinct().join(blocks.select("block", F.col("places").alias("ids"), F.col("counts").alias("sizes")), "block")
    bundles = bundles.join(groups, "grp").select("block", "grp", "ids", "sizes", "items", "potential", nothing.alias("cells"), nothing.alias("sums"))

    def advance(stage: int):
        def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            bundle = next(left.itertuples(index=False))
            cells, sums = run_stage(bundle, right, stage, k, corpus)
            return left.assign(cells=[cells.astype(np.uint32).tobytes()], sums=[sums.tobytes()])

        def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            bundle = next(left.itertuples(index=False))
            return best_cells(bundle, *run_stage(bundle, right, stage, k, corpus), k)

        return finish if stage == stages - 1 else add

    for stage in range(stages):
        # Aliases, since the bundles come from the same table.
        postings_here = owned.filter(F.col("owner") == stage).select(F.col("block").alias("block"), F.col("grp").alias("grp"), "w", "items", "places", "counts")
        after = "item_id long, doc_id long, score long" if stage == stages - 1 else BUNDLE
        bundles = bundles.groupBy("block", "grp").cogroup(postings_here.groupBy("block", "grp")).applyInPandas(advance(stage), after)

    by_score = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return bundles.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
