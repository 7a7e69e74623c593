"""Token ids of a corpus in binary files, with Elias-Fano coded document boundaries.

A file holds documents in ascending order of their key:

* the ids of all its documents one after another, two bytes each if the vocabulary allows, else four;
* the document ends, an Elias-Fano sequence of id counts from the file's start;
* the keys of the documents, an Elias-Fano sequence of differences from the first key;
* a trailer of fixed size with the counts, the place of each part and checksums.

The ends are found by select, so neither writer nor reader keeps a table of 64-bit offsets. A manifest
lists the files in key order with the number of ids before each. Only files in it count:
a lost or repeated task leaves files behind that nothing refers to.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources.shared_files import open_folder, qualified
from . import elias_fano
from .bpe import Codec, join_tree, load_codec
from .frames import col, fresh

MAGIC = b"TOKNFILE"
#: Magic, version, bytes of an id, documents, documents without key, ids, first key, bytes of ends, bytes of keys, crc32 of ids, of ends and keys.
TRAILER = struct.Struct("<8sHHQQQqQQII")
#: A task begins another file at so many ids or documents.
FILE_IDS = 1 << 28
FILE_DOCS = 1 << 22
#: Ids that a reader takes at a time, about; characters of a text that are encoded at once.
READ_IDS = 1 << 20
LEAF_CHARS = 1 << 16

MANIFEST = "part long, number long, path string, documents long, ids long, bytes long"


class TokenFileError(ValueError):
    """A file that is no sound token file."""


def encode_whole(codec: Codec, text: str) -> np.ndarray:
    """Ids of a whole text; a long one is encoded in leaves that are joined exactly."""
    if len(text) <= LEAF_CHARS:
        return codec.encode(text)
    return join_tree(codec, [(t, codec.encode(t)) for t in (text[i : i + LEAF_CHARS] for i in range(0, len(text), LEAF_CHARS))])


@dataclass
class Writer:
    """One file being written: ids go out at once, ends and keys at the end."""

    sink: object
    width: int
    total: int = 0
    crc: int = 0
    nulls: int = 0
    ends: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        """The next document; documents without key come first, then ascending keys."""
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        data = ids.astype(f"<u{self.width}").tobytes()
        self.sink.write(data)
        self.crc = zlib.crc32(data, self.crc)
        self.total += len(ids)
        self.ends.append(self.total)

    def close(self) -> int:
        """Write the rest; returns the file's size."""
        keys = np.array(self.keys, np.int64)
        base = int(keys[0]) if len(keys) else 0
        # Differences of signed numbers, however far apart, are right modulo 2 to the 64.
        spans = keys.view(np.uint64) - np.array([base], np.int64).view(np.uint64)
        ends, spans = elias_fano.encode(np.array(self.ends, np.uint64)), elias_fano.encode(spans)
        trailer = TRAILER.pack(MAGIC, 1, self.width, len(self.ends), self.nulls, self.total, base, len(ends), len(spans), self.crc, zlib.crc32(ends + spans))
        self.sink.write(ends + spans + trailer)
        self.sink.close()
        return self.total * self.width + len(ends) + len(spans) + len(trailer)


class TokenFile:
    """Random access to the documents of an open file."""

    def __init__(self, source) -> None:
        size = source.size()
        if size < TRAILER.size:
            raise TokenFileError("too short for a token file")
        source.seek(size - TRAILER.size)
        magic, version, self.width, self.documents, self.nulls, self.ids, self.base, ends, keys, self.crc, check = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or version != 1 or size != self.ids * self.width + ends + keys + TRAILER.size:
            raise TokenFileError("no token file, or not all of one")
        source.seek(self.ids * self.width)
        index = source.read(ends + keys)
        if zlib.crc32(index) != check:
            raise TokenFileError("wrong checksum of boundaries and keys")
        self.source, self.ends, self.spans = source, elias_fano.Sequence(index[:ends]), elias_fano.Sequence(index[ends:])

    def bounds(self, first: int, count: int) -> np.ndarray:
        """``count + 1`` places: where documents ``first`` and following begin, and where the last ends."""
        if not first:
            return np.concatenate([[0], self.ends.take(0, count).astype(np.int64)])
        return self.ends.take(first - 1, count + 1).astype(np.int64)

    def keys_of(self, first: int, count: int) -> list[int | None]:
        empty = max(0, min(count, self.nulls - first))
        spans = self.spans.take(first + empty - self.nulls, count - empty) if count > empty else np.zeros(0, np.uint64)
        return [None] * empty + (spans + np.array([self.base], np.int64).view(np.uint64)).view(np.int64).tolist()

    def read_ids(self, begin: int, end: int) -> np.ndarray:
        self.source.seek(begin * self.width)
        data = self.source.read((end - begin) * self.width)
        if len(data) != (end - begin) * self.width:
            raise TokenFileError("ids are missing")
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """Key and ids of the i-th document."""
        begin, end = self.bounds(i, 1)
        return self.keys_of(i, 1)[0], self.read_ids(int(begin), int(end))

    def sweep(self, ids_at_once: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """All documents in order, some at a time: keys, bounds from the file's start, ids; checks the ids' checksum."""
        first, crc = 0, 0
        while first < self.documents:
            bounds = self.bounds(first, min(4096, self.documents - first))
            count = max(1, int(np.searchsorted(bounds, bounds[0] + ids_at_once, "right")) - 1)
            bounds = bounds[: count + 1]
            ids = self.read_ids(int(bounds[0]), int(bounds[-1]))
            crc = zlib.crc32(ids.tobytes(), crc)
            yield self.keys_of(first, count), bounds, ids
            first += count
        if crc != self.crc:
            raise TokenFileError("wrong checksum of ids")


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = None,
    files: int | None = None, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode the whole texts of ``docs`` into files below ``folder`` and return their manifest.

    Documents stand in ascending order of the integer ``key``, first those without a key; rows with equal keys in
    any order among themselves. ``end_id`` is appended to each document. A null text has no other ids.
    Other columns are not read. Documents are dealt by key range to ``files`` tasks (as many as
    there are shuffle partitions, unless given), with rows of one key spread over several if there
    are many; a task goes on to another file at ``file_ids`` ids. The manifest (part, number, path, documents,
    ids, bytes) has one row per file.
    """
    spark = docs.sparkSession
    root = qualified(spark, folder)
    rows = docs.select(col(key).cast("long").alias("key"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("spread", F.rand(17))
    dealt = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "spread")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, part, made = load_codec(tokenizer), TaskContext.get().partitionId(), []
        largest = max(len(codec.token_bytes) - 1, end_id or 0)
        width, end = 2 if largest < 1 << 16 else 4, np.array([] if end_id is None else [end_id], np.uint32)
        system, base = open_folder(root)
        system.create_dir(base, recursive=True)
        writer, name = None, ""

        def finish() -> None:
            documents, ids = len(writer.ends), writer.total
            made.append((part, len(made), f"{root}/{name}", documents, ids, writer.close()))

        for batch in batches:
            # An integer column with nulls arrives as doubles, so the key comes as text.
            for k, t in zip(batch["key"], batch["text"]):
                if writer is None:
                    name = f"tokens-{part:06d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(system.open_output_stream(f"{base}/{name}", compression=None), width)
                writer.add(int(k) if isinstance(k, str) else None, np.concatenate([encode_whole(codec, t), end]))
                if writer.total >= file_ids or len(writer.ends) >= FILE_DOCS:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        yield pd.DataFrame(made, columns=["part", "number", "path", "documents", "ids", "bytes"])

    ordered = dealt.sortWithinPartitions("key").select(F.col("key").cast("string").alias("key"), "text")
    return stored(ordered.mapInPandas(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents in the files of a manifest: (key, start, n_tokens, ids), one row each.

    ``start`` counts the ids of all documents before, over all files. ``ids`` are unsigned little-endian 32-bit
    integers in a binary. Each file is read by one task from start to end, a
    megabyte at a time; a broken one fails the job. The manifest, a row per file, passes through the driver.
    """
    spark: SparkSession = manifest.sparkSession
    placed, before = [], 0
    for f in sorted(manifest.collect(), key=lambda f: (f["part"], f["number"])):
        placed.append((f["path"], before))
        before += f["ids"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                system, name = open_folder(path)
                with system.open_input_file(name) as source:
                    for keys, bounds, ids in TokenFile(source).sweep(READ_IDS):
                        wide, places = ids.astype("<u4"), bounds - bounds[0]
                        yield pd.DataFrame({
                            "key": pd.array(keys, "Int64"), "start": bounds[:-1] + start, "n_tokens": np.diff(bounds),
                            "ids": [wide[a:b].tobytes() for a, b in zip(places[:-1], places[1:])],
                        })

    files = spark.createDataFrame(placed, "path string, start long").repartition(max(1, min(len(placed), 10_000)))
    found = files.mapInPandas(read, "key long, start long, n_tokens long, ids binary")
    return found.withColumnRenamed("key", fresh(found.drop("key"), key))
