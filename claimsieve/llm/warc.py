"""WARC archives: one gzip member per record, written in parallel and read sequentially with verification.

The reader decompresses a file step by step, never the whole of it: a gzip member at a
time, the record's header lines, then exactly Content-Length bytes of block, then
the two line ends that close a record. Block and payload digests are computed while reading.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from ..sources.shared_files import open_folder, qualified
from .frames import col

READ_BYTES = 1 << 18
#: Fixed values of the WARC format, version 1.1.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "<urn:claimsieve:page:{}>"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A file that is no sound WARC archive."""


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes
    payload_digest: str


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(value: str) -> str:
    """A header value on one line; other control characters go too."""
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_id(page: str | None) -> str:
    """Made of the page's id; a page without one gets an id of its own."""
    return f"<{uuid.uuid4().urn}>" if page is None else RECORD_ID.format(page)


def record_bytes(page: str | None, url: str, payload: bytes, payload_digest: str, refers_to: str | None) -> Iterator[bytes]:
    """One record as a gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if refers_to is None else b""
    block = hashlib.sha1(http)
    block.update(body)
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(block.digest()).decode()), ("Content-Length", str(len(http) + len(body))),
    ]
    if refers_to is not None:
        lines[5:5] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", RECORD_ID.format(refers_to))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield packer.compress(head + http)
    for start in range(0, len(body), READ_BYTES):
        yield packer.compress(body[start : start + READ_BYTES])
    yield packer.compress(b"\r\n\r\n") + packer.flush()


class Members:
    """The bytes of one gzip member after another, decompressed as they are asked for."""

    def __init__(self, source) -> None:
        self.source, self.raw, self.plain, self.packer = source, b"", bytearray(), None

    def next_member(self) -> bool:
        """Go to the next member; False at the end of the file."""
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
        self.packer, self.plain = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def fill(self) -> bool:
        """Decompress some more; False if the member has ended."""
        if self.packer.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(READ_BYTES)
            if not self.raw:
                raise WarcError("the file ends inside a gzip member")
        try:
            self.plain += self.packer.decompress(self.raw, READ_BYTES)
        except zlib.error as error:
            raise WarcError(f"no gzip member: {error}") from error
        self.raw = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self.fill():
                raise WarcError("a record ends inside its header")
        found = bytes(self.plain[:end])
        del self.plain[: end + 2]
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.plain and not self.fill():
                raise WarcError("a record is shorter than its Content-Length")
            piece = bytes(self.plain[:size])
            del self.plain[: len(piece)]
            size -= len(piece)
            yield piece


def headers_of(members: Members) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := members.line():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise WarcError(f"no header line: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def read_records(source) -> Iterator[Record]:
    """Records of an open archive in order; raises WarcError where format, length or a digest is wrong."""
    members = Members(source)
    while members.next_member():
        version = members.line()
        if not version.startswith(b"WARC/"):
            raise WarcError(f"no WARC record: {version[:80]!r}")
        headers = headers_of(members)
        if not headers.get("content-length", "").isdigit():
            raise WarcError("a record without Content-Length")
        block, payload, whole = hashlib.sha1(), hashlib.sha1(), bytearray()
        for piece in members.take(int(headers["content-length"])):
            block.update(piece)
            whole += piece
        cut = whole.find(b"\r\n\r\n") + 4 if headers.get("content-type", "").startswith("application/http") else 0
        http, body = bytes(whole[:cut]), bytes(memoryview(whole)[cut:])
        payload.update(body)
        ending = b"".join(members.take(4))
        while members.fill():
            pass
        if ending != b"\r\n\r\n" or members.plain:
            raise WarcError("a record doesn't end where its Content-Length says")
        expected = headers.get("warc-block-digest", "")
        if expected.startswith("sha1:") and expected[5:] != base64.b32encode(block.digest()).decode():
            raise WarcError(f"wrong block digest in {headers.get('warc-record-id')}")
        computed = base64.b32encode(payload.digest()).decode()
        expected = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") == "response" and expected.startswith("sha1:") and expected[5:] != computed:
            raise WarcError(f"wrong payload digest in {headers.get('warc-record-id')}")
        yield Record(headers, http, body, expected[5:] or computed)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row below ``folder`` (one all executors share) and return the manifest (path, records, bytes).

    Of rows with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id
    is a response and the others are revisits of it; without any id, or if several rows
    have that id, all of these are responses. A null html is an empty payload, a null url an empty one; a row
    without id reads back without one. ``folder`` is a path as Spark understands it: a plain one belongs to
    the cluster's default file system.
    Each task attempt writes a file of its own; only what the manifest lists counts, so a lost
    executor leaves no half archive behind. Other columns are not read.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.select(
        col(key).cast("string").alias("page"), col(key).alias("id"), F.coalesce(col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(col(html).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    repeated = groups.filter("n > 1 AND first IS NOT NULL").select("sha1", F.col("first").alias("first_id"))
    linked = rows.join(stored(repeated, "repeated-payloads"), "sha1", "left")
    linked = linked.withColumn("refers_to", F.expr("IF(first_id IS NULL OR id <=> first_id, NULL, CAST(first_id AS STRING))"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        sink, records, size = None, 0, 0
        for batch in batches:
            for page, link, payload, sha1, refers_to in zip(batch["page"], batch["url"], batch["payload"], batch["sha1"], batch["refers_to"]):
                sink = sink or system.open_output_stream(f"{root}/{name}", compression=None)
                encoded = base64.b32encode(bytes.fromhex(sha1)).decode()
                page, refers_to = page if isinstance(page, str) else None, refers_to if isinstance(refers_to, str) else None
                for piece in record_bytes(page, link, payload, encoded, refers_to):
                    sink.write(piece)
                    size += len(piece)
                records += 1
        if sink:
            sink.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [records], "bytes": [size]})

    manifest = linked.select("page", "url", "payload", "sha1", "refers_to").mapInPandas(write, "path string, records long, bytes long")
    return stored(manifest, "warc-manifest")


def read_archives(manifest: DataFrame, batch_bytes: int = 1 << 24) -> DataFrame:
    """Records of the listed archives: (page, url, record_type, refers_to, http, payload, payload_digest).

    Each file is read from start to end by one task. A broken archive fails the job.
    """

    def page_of(record_id: str | None) -> str | None:
        before, after = RECORD_ID.split("{}")
        return record_id[len(before) : -len(after)] if record_id and record_id.startswith(before) else None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page", "url", "record_type", "refers_to", "http", "payload", "payload_digest"]
        for batch in batches:
            for path in batch["path"]:
                system, name = open_folder(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for record in read_records(source):
                        h = record.headers
                        rows.append((page_of(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), page_of(h.get("warc-refers-to")), record.http, record.payload, record.payload_digest))
                        held += len(record.payload) + 500
                        if held >= batch_bytes:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    # A number of its own keeps the few small rows from being read by one task.
    files = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInPandas(read, "page string, url string, record_type string, refers_to string, http binary, payload binary, payload_digest string")


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")


def payload_size(http: Column) -> Column:
    """Length of the full payload, as the record's HTTP header gives it; a revisit has it there too."""
    return F.regexp_extract(F.decode(http, "ISO-8859-1"), r"(?i)content-length: (\d+)", 1).cast("long")
