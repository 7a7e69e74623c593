import io
import zlib

import numpy as np
import pytest
from helpers import doc_table
from tokenizers import Tokenizer

from claimsieve.llm import QUERIES, elias_fano, token_files
from claimsieve.llm.bpe import load_codec
from claimsieve.llm.queries import byte_bpe


def sorted_values(rng, n, largest):
    return np.sort(rng.integers(0, largest, n, dtype=np.uint64, endpoint=True))


@pytest.mark.parametrize("n, largest", [(0, 1), (1, 0), (1, 2**64 - 1), (1000, 5), (1000, 10**6), (70_000, 2**63), (5000, 2), (3, 10**12), (66_000, 66_000)])
def test_sequences_give_back_every_value(n, largest):
    rng = np.random.default_rng(n)
    values = sorted_values(rng, n, largest)
    data = elias_fano.encode(values)
    found = elias_fano.Sequence(data)
    assert len(found) == n and (found.take(0, n) == values).all()
    for i in rng.integers(0, n, 50 if n else 0):
        assert found[int(i)] == int(values[i])
        count = int(rng.integers(0, n - i + 1))
        assert (found.take(int(i), count) == values[i : i + count]).all()
    with pytest.raises(IndexError):
        found.take(0, n + 1)


def test_sequences_are_near_the_least_space():
    n = 100_000
    values = sorted_values(np.random.default_rng(1), n, n * 1000)
    bits = 8 * len(elias_fano.encode(values)) / n
    # 2 + log2(u / n), and an eighth of a bit for the remembered places.
    assert bits < 2 + np.log2(1000) + 0.25


def test_a_long_gap_between_values():
    values = np.array([0] * 300 + [2**20] * 300, np.uint64)
    found = elias_fano.Sequence(elias_fano.encode(values))
    assert [found[i] for i in (0, 299, 300, 599)] == [0, 0, 2**20, 2**20]


def plain(rows, end):
    """Tokens by the library itself, in ascending order of the key, rows without key first."""
    library = Tokenizer.from_file(byte_bpe())
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end])) for i, t in rows]
    return sorted(coded, key=lambda r: (r[0] is not None, r[0] or 0))


def check_starts(found):
    before = 0
    for r in sorted(found, key=lambda r: (r.start, r.start + r.n_tokens)):
        assert r.start == before
        before += r.n_tokens


@pytest.mark.parametrize("end, files, file_ids", [(2, 3, 1 << 28), (None, 1, 1 << 28), (70_000, 8, 100)])
def test_awkward_rows(spark, tmp_path, end, files, file_ids):
    docs = doc_table(spark).withColumnRenamed("score", "start")
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), byte_bpe(), end_id=end, files=files, file_ids=file_ids)
    found = token_files.read_token_files(manifest).collect()
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], end)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted([(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found], key=key) == sorted(expected, key=key)
    check_starts(found)
    # Ascending keys from file to file.
    keys = [r.doc_id if r.doc_id is not None else -1 for r in sorted(found, key=lambda r: (r.start, r.n_tokens))]
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    if end is not None:
        assert keys == sorted(keys)
    assert manifest.count() >= (2 if file_ids == 100 else 1)


def test_keys_far_apart_and_a_name_that_clashes(spark, tmp_path):
    rows = [(-(2**63), "a"), (2**63 - 1, "b"), (0, "c"), (None, "d")]
    docs = spark.createDataFrame(rows, "start long, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), byte_bpe(), key="start", files=1)
    found = token_files.read_token_files(manifest, key="start")
    assert found.columns == ["_start", "start", "n_tokens", "ids"]
    assert [r[0] for r in found.orderBy("start").collect()] == [None, -(2**63), 0, 2**63 - 1]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), byte_bpe(), end_id=2)
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_one_key_in_most_rows_is_spread(spark, tmp_path):
    docs = spark.range(4000).selectExpr("IF(id < 3000, 7, id) AS doc_id", "'some words' AS text").repartition(6)
    manifest = token_files.write_token_files(docs, str(tmp_path / "t"), byte_bpe(), files=8).collect()
    assert max(f.documents for f in manifest) < 1500
    assert sum(f.documents for f in manifest) == 4000


class Sink(io.BytesIO):
    def close(self):
        self.whole = self.getvalue()
        super().close()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def written(documents, width=2):
    sink = Sink()
    writer = token_files.Writer(sink, width)
    for key, ids in documents:
        writer.add(key, np.array(ids, np.uint32))
    assert writer.close() == len(sink.whole)
    return sink.whole


def test_random_access_and_broken_files():
    rng = np.random.default_rng(3)
    documents = [(None, [5]), *[(k * k, rng.integers(0, 50_000, int(rng.integers(0, 40))).tolist()) for k in range(-20, 300)]]
    documents[1:] = sorted(documents[1:], key=lambda d: d[0])
    data = written(documents)
    file = token_files.TokenFile(Source(data))
    for i in rng.permutation(len(documents)):
        key, ids = file.document(int(i))
        assert (key, ids.tolist()) == documents[i]
    assert sum(len(k) for k, _, _ in file.sweep(100)) == len(documents)
    for place in (3, len(data) // 2, len(data) - 10):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(token_files.TokenFileError):
            list(token_files.TokenFile(Source(bytes(broken))).sweep(100))
    for cut in (0, 10, len(data) - 1):
        with pytest.raises(token_files.TokenFileError):
            token_files.TokenFile(Source(data[:cut]))


def test_long_texts_are_joined_exactly(monkeypatch):
    monkeypatch.setattr(token_files, "LEAF_CHARS", 50)
    codec, library = load_codec(byte_bpe()), Tokenizer.from_file(byte_bpe())
    for text in ("the quick brown fox " * 40, "é" * 500, "aaaaab" * 90, "a <|endoftext|> b " * 20):
        assert token_files.encode_whole(codec, text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    start, expected = 0, []
    for key, ids in plain(docs, 2):
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op11_token_files"](spark, folder).collect()) == expected
