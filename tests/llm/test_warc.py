import base64
import gzip
import hashlib
import io
import re
import zlib

import pytest

from claimsieve.llm import QUERIES, warc

ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>é🙂</p>\r\n\r\nWARC/1.1\r\n"), (3, None, "<p>one</p>"), (4, "http://a/4\r\nX: y", None), (5, "u", ""),
    (6, "u", "<p>one</p>"), (6, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "alone"), (9, "u", "x" * 700_000), (8, "u", "x" * 700_000), (10, "u", "\0\x01"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_rows(rows, min_bytes=0):
    first = {}
    for i, _, t in rows:
        t = t or ""
        if i is not None:
            first[t] = min(i, first.get(t, i))
    out = []
    for i, _, t in rows:
        t = t or ""
        alone = len(t.encode()) < min_bytes or first.get(t) is None or first[t] == i
        out.append((i, t.encode() if alone else b"", digest(t), "response" if alone else "revisit", None if alone else first[t], len(t.encode())))
    return out


@pytest.mark.parametrize("min_bytes", [0, 1000])
def test_round_trip(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame([r + ("x", 1) for r in ROWS], "page_id long, url string, html string, page string, sha1 int").repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", min_bytes=min_bytes)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)
    found = warc.read_archives(manifest, batch_bytes=1000).withColumn("size", warc.payload_size(warc.F.col("http"))).collect()
    actual = [(int(r.page) if r.page else None, bytes(r.payload), r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None, r["size"]) for r in found]
    assert sorted(actual, key=repr) == sorted(expected_rows(ROWS, min_bytes), key=repr)
    # One gzip member per record, and other tools can read the file.
    for row in manifest.collect():
        raw = open("/" + row.path.removeprefix("file:").lstrip("/"), "rb").read()
        members, plain = 0, b""
        while raw:
            unpack = zlib.decompressobj(31)
            plain += unpack.decompress(raw)
            raw, members = unpack.unused_data, members + 1
        assert members == row.records and plain.count(b"WARC-Record-ID: ") == row.records


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, str(tmp_path / "w"))).count() == 0


def archive(*payloads):
    return b"".join(b"".join(warc.record_bytes(str(i), "u", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None)) for i, p in enumerate(payloads))


class Slow(io.BytesIO):
    def read(self, size=-1):
        return super().read(min(size, 7))


def test_reads_in_small_steps():
    found = list(warc.read_records(Slow(archive(b"one", b"", b"two" * 100))))
    assert [r.payload for r in found] == [b"one", b"", b"two" * 100]


def damaged(change):
    plain = gzip.decompress(archive(b"payload"))
    return gzip.compress(change(plain))


@pytest.mark.parametrize("data", [
    archive(b"payload")[:-4], b"no gzip at all", archive(b"a") + b"junk", damaged(lambda p: p.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")),
    damaged(lambda p: re.sub(rb"Content-Length: (\d+)", lambda m: b"Content-Length: %d" % (int(m[1]) - 1), p, count=1)), damaged(lambda p: p[:-2]), damaged(lambda p: p + b"more"),
    damaged(lambda p: p.replace(b"WARC/1.1", b"XXXX/1.1", 1)), damaged(lambda p: p[:40]), damaged(lambda p: re.sub(rb"Content-Length: \d+", b"Content-Nothing: 9", p, count=1)),
])
def test_broken_archives_are_refused(data):
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    found = QUERIES["op8_warc"](spark, sf_dir).collect()
    expected = [(i, n, d, kind, refers) for i, _, d, kind, refers, n in expected_rows(rows)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_query_with_null_and_repeated_ids_in_a_plain_folder(spark, tmp_path):
    folder = tmp_path / "tables"
    spark.createDataFrame(ROWS, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    found = QUERIES["op8_warc"](spark, str(folder)).collect()
    assert "://" not in spark.conf.get("spark.checkpoint.dir")
    expected = [(i, size, sha, kind, refers) for i, _, sha, kind, refers, size in expected_rows(ROWS)]
    actual = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(actual, key=repr) == sorted(expected, key=repr)


def test_records_without_a_page_have_ids_of_their_own():
    first, second = warc.record_id(None), warc.record_id(None)
    assert first != second and first.startswith("<urn:uuid:")
