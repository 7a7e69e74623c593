import hashlib
import random

import pytest
from helpers import doc_table
from tokenizers import Tokenizer

from claimsieve.llm import QUERIES, bpe
from claimsieve.llm.queries import byte_bpe

ALPHABET = ["a", "b", " ", "  ", "\n", "'", "s", "re", "ll", "1", "22", "!", "é", "ç", "漢字", "🙂", "<|endoftext|>", "<|", "|>", "the", "\t", "''", "'s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_bpe())


def random_text(rng):
    some = rng.sample(ALPHABET, rng.choice([1, 2, 3, 5, len(ALPHABET)]))
    return "".join(rng.choice(some) for _ in range(rng.choice([1, 5, 40, 300])))


def test_tree_of_any_leaves_gives_the_library_ids(library):
    codec, rng = bpe.load_codec(byte_bpe()), random.Random(4)
    for _ in range(600):
        text = random_text(rng)
        expected = library.encode(text, add_special_tokens=False).ids
        size = rng.choice([1, 2, 3, 7, 20, 50])
        leaves = [(text[i : i + size], codec.encode(text[i : i + size])) for i in range(0, len(text), size)]
        assert bpe.join_tree(codec, leaves).tolist() == expected, (size, text)
        for ids in (expected, expected[1:], expected[:-1]):
            assert codec.decode(bpe.np.array(ids, dtype=int)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 5000, "!" * 5000, "ab1" * 2000, "漢字" * 2000, "'s" * 2000, "x " * 30 + "y" * 4000 + " z"])
def test_long_unsplit_texts(library, text):
    codec = bpe.load_codec(byte_bpe())
    leaves = [(text[i : i + 700], codec.encode(text[i : i + 700])) for i in range(0, len(text), 700)]
    assert bpe.join_tree(codec, leaves).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [37, 1 << 16])
def test_encode_and_decode_rows(spark, library, leaf):
    docs = doc_table(spark)
    rows = [r.text for r in docs.collect()]
    encoded = bpe.encode_texts(docs, byte_bpe(), ["doc_id", "_text"], leaf_chars=leaf)
    assert encoded.columns == ["doc_id", "_text", "ids"]
    found = encoded.select("doc_id", "ids", bpe.decode_ids(bpe.F.col("ids"), byte_bpe()).alias("back")).collect()
    expected = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids, r.back) for r in found], key=key) == sorted(expected, key=key)
    assert len(found) == len(rows)
    assert bpe.encode_texts(docs.limit(0), byte_bpe(), ["doc_id"]).count() == 0


def test_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op10_bpe"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_a_key_with_the_name_of_the_result(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "x" * 70_000)], "ids long, text string")
    found = bpe.encode_texts(docs, byte_bpe(), ["ids"])
    assert found.columns == ["ids", "_ids"] and {r.ids for r in found.collect()} == {1, 2}
