from collections import Counter, defaultdict

import pytest
from helpers import doc_table
from tokenizers import Tokenizer

from claimsieve.llm import QUERIES, token_counts
from claimsieve.llm.queries import byte_bpe


def plain(library, text, starts, rule):
    owner = []
    for i in range(len(text)):
        owner.append(max(k for k, s in enumerate(starts) if s <= i))
    counts = Counter()
    raw = text.encode()
    position = 0
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    for i in library.encode(text, add_special_tokens=False).ids:
        piece = len(bpe_bytes(i))
        chars = sorted(set(of_byte[position : position + piece]))
        position += piece
        held = Counter(owner[c] for c in chars)
        chosen = {"start": owner[chars[0]], "end": owner[chars[-1]], "majority": min(held, key=lambda k: (-held[k], k))}[rule]
        counts[chosen] += 1
    assert position == len(raw)
    return [counts[k] for k in range(len(starts))]


def bpe_bytes(i):
    from claimsieve.llm.bpe import load_codec

    return load_codec(byte_bpe()).token_bytes[i]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_a_plain_version(spark, rule):
    library = Tokenizer.from_file(byte_bpe())
    texts = ["one line\n\n\nthree  \n", "a\r\nb🙂c\nç", "", None, "\n", "no break", "x\n" * 30]
    docs = spark.createDataFrame([(i, t, [0, 2, 5, 3, 99]) for i, t in enumerate(texts)], "doc_id long, text string, cuts array<int>")
    for starts in (None, "cuts"):
        found = defaultdict(list)
        for r in token_counts.section_token_counts(docs, byte_bpe(), ["doc_id"], starts=starts, rule=rule).orderBy("doc_id", "section").collect():
            found[r.doc_id].append((r.start, r.stop, r.n_tokens))
        for i, text in enumerate(texts):
            text = text or ""
            if starts:
                begins = [s for s in (0, 2, 3, 5, 99) if s < max(len(text), 1)]
            else:
                begins = [0] + [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]
            assert [x[0] for x in found[i]] == begins
            assert [x[1] for x in found[i]] == begins[1:] + [len(text)]
            assert [x[2] for x in found[i]] == (plain(library, text, begins, rule) if text else [0])


def test_awkward_rows_add_up(spark):
    library = Tokenizer.from_file(byte_bpe())
    docs = doc_table(spark)
    found = token_counts.section_token_counts(docs, byte_bpe(), ["doc_id", "_text"])
    total = sum(r.n_tokens for r in found.collect())
    assert total == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    assert found.columns == ["doc_id", "_text", "section", "start", "stop", "n_tokens"]
    assert token_counts.section_token_counts(docs.limit(0), byte_bpe(), ["doc_id"]).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        token_counts.section_token_counts(doc_table(spark), byte_bpe(), ["doc_id"], rule="none")


def test_query_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(byte_bpe())
    found = defaultdict(list)
    for r in QUERIES["op2_token_counts"](spark, folder).orderBy("doc_id", "section").collect():
        found[r.doc_id].append((r.start, r.stop, r.n_tokens))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert set(found) == {d.doc_id for d in docs}
    for d in docs:
        text = d.text or ""
        begins = [0] + [k + 1 for k, c in enumerate(text) if c == "\n" and k + 1 < len(text)]
        assert [x[:2] for x in found[d.doc_id]] == list(zip(begins, begins[1:] + [len(text)]))
        if len(text) < 3000:
            assert [x[2] for x in found[d.doc_id]] == (plain(library, text, begins, "majority") if text else [0])
        assert sum(x[2] for x in found[d.doc_id]) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_empty_and_null_starts(spark, rule):
    docs = spark.createDataFrame([(1, "a b c", []), (2, "a b c", [None, 2]), (3, "a b c", None)], "doc_id long, text string, cuts array<int>")
    rows = token_counts.section_token_counts(docs, byte_bpe(), ["doc_id"], starts="cuts", rule=rule).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.start, r.stop) for r in rows] == [(1, 0, 5), (2, 0, 2), (2, 2, 5), (3, 0, 5)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 2) == 3
