import random
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import components, doc_table, words

from claimsieve.llm import QUERIES, simhash
from claimsieve.llm.components import connected_components


def plain_fingerprint(text, width=3):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 5)
    for text in (None, "", " \n", "One", "one two", "ÀB a\x1cb c D", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12", "same same same same"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("limit", [64, 1])
def test_links_equal_all_pairs(spark, monkeypatch, limit):
    """With limit 1 every shared key goes through shared neighbours instead of pairs."""
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = random.Random(limit)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            near = base
            for k in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                near ^= 1 << k
            prints.add(near)
    expected = {(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 2}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.fingerprint_links(frame).collect()}
    assert found <= expected
    assert components(prints, found) == components(prints, expected)
    if limit == 64:
        assert found == expected


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (2000, 0)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = components({n for link in links for n in link}, links)
    assert all(expected[n] == c for n, c in found.items())
    assert set(found) >= {n for a, b in links if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_classes(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    distinct = sorted(set(prints))
    root = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bin(a ^ b).count("1") <= 2])
    ids = defaultdict(list)
    for (i, _), p in zip(rows, prints):
        if i is not None:
            ids[root[p]].append(i)
    return [(i, p, min(ids[root[p]], default=None)) for (i, _), p in zip(rows, prints)]


def test_awkward_rows(spark):
    docs = doc_table(spark)
    found = simhash.simhash_classes(docs)
    expected = plain_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter((r.id, r.fp % (1 << 64), r.component_id) for r in found.collect()) == Counter(expected)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    groups = Counter(c for _, _, c in expected)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op5_simhash"](spark, sf_dir).collect()
    expected = [(i, f"{p:016x}", c) for i, p, c in plain_classes([(r.doc_id, r.text) for r in docs])]
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == Counter(expected)
