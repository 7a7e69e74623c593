"""Each operator over its whole table, as a query."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, language_id, mixing, multi_index, ngram_lm, onebit, quality, simhash, term_pipeline, token_counts, token_files, vertical_scan, warc
from .frames import id_remainder, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Folder of the public tokenizers' files; every executor needs it.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")


def byte_bpe() -> str:
    return f"{TOKENIZERS}/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train_language_model(docs.filter(~held_out))
    predicted = language_id.predict_language(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to a mix of the sources."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, the classifier's decision, and a Gumbel top-k sample of half the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_classifier(docs, table(spark, sf_dir, "labels"))
    weighed = quality.weigh(docs, model).select("doc_id", "importance.*")
    return quality.resample(weighed, 0.5, "log_weight", "doc_id")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    classes = simhash.simhash_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3)
    return classes.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, digested, and the digest of the text they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, byte_bpe(), ["doc_id"])
    decoded = bpe.decode_ids(F.col("ids"), byte_bpe())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest("ids").alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def id_digest(ids: str):
    """SHA-256 of decimal ids joined by commas."""
    return F.expr(f"sha2(replace(trim(BOTH '[]' FROM CAST({ids} AS STRING)), ', ', ','), 256)")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.section_token_counts(docs, byte_bpe(), ["doc_id"])


@query
def op6_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return onebit.nearest(vectors, F.col("vec_id") % 20 == 0)


@query
def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = id_remainder(F.col("doc_id"), 7)
    return ngram_lm.score_documents(docs, part == 2, part == 3)


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark)))
    return records.select(
        F.col("page").cast("long").alias("page_id"), warc.payload_size(F.col("http")).alias("payload_bytes"),
        "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


#: Base32 of a SHA-1: each five hex digits are four of its characters.
BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, {5 * group + 1}, 5) AS BIGINT) >> {shift}) & 31), 1)"
    for group in range(8)
    for shift in (15, 10, 5, 0)
)
ORACLES["op8_warc"] = f"""WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS digest, min(page_id) OVER (PARTITION BY payload) AS first_id FROM payloads)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM digests"""


@query
def op9_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return multi_index.similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into token files, and read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_files.write_token_files(docs, scratch_path(spark, "tokens"), byte_bpe(), end_id=2)
    return token_files.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return term_pipeline.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: Terms of a text, and the score's integer arithmetic.
ORACLES["op12_term_pipeline"] = r"""WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT doc, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM sizes),
counts AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) GROUP BY ALL),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * max(t.documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals t GROUP BY term),
scored AS (SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * t.documents) // t.occurrences)))) AS score
  FROM wanted JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc), totals t GROUP BY item_id, doc_id, doc),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query
def op13_vertical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")
    return vertical_scan.hard_negatives(vectors, F.col("vec_id") % 50 == 0, label)


ORACLES["op13_vertical_scan"] = """WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
    s.vec_id AS negative_id, positive_score, s.score AS negative_score
  FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3"""
