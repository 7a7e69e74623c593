"""A corpus pipeline: each stage applies one operator to all that the stage before has kept.

Stages in order: language identification drops texts of no recognisable language;
the quality classifier drops texts it rejects; SimHash keeps one of each group of texts
with nearly equal fingerprints; mixing repeats or leaves out documents by their source's target; the last
encodes every document. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.llm import bpe, language_id, mixing, quality, simhash
from claimsieve.llm.frames import fresh, small_batches
from claimsieve.llm.queries import byte_bpe, id_digest, table
from claimsieve.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text is recognised as a language at all, with a posterior of at least a half.

    The model is learnt from the labelled documents of the input. Null texts and texts without letters go.
    """
    small_batches(spark)
    model = language_id.train_language_model(docs)
    name = fresh(docs, "language")
    found = language_id.predict_language(docs, model, into=name)
    return found.filter((F.col(f"{name}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{name}.score") >= 0.5)).select(docs.columns)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; it is fitted on the labelled ones among them."""
    small_batches(spark)
    model = quality.fit_classifier(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "importance")
    return quality.weigh(docs, model, into=name).filter(f"{name}.accepted").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash component."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, width=3).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    small_batches(spark)
    return mixing.take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: its ids and digests of ids and of the text decoded from them."""
    small_batches(spark)
    encoded = bpe.encode_texts(docs, byte_bpe(), ["doc_id", "lang", "source"])
    decoded = bpe.decode_ids(F.col("ids"), byte_bpe())
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), id_digest("ids").alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL has no byte-pair encoding, so the stages are tested against plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number + 1}")
    return docs
