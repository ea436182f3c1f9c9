"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the driver of
the pipeline writes what it returns as Parquet and reads it again for the next one.  All but the
last return the columns of ``documents``; the text may have changed, and ``n_chars`` with it.

Nulls, empty texts, repeated rows and empty tables have the results that the operators state: a
null text is scored as empty and passes; rows without an id are never removed as copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from accordant.llm import line_dedup, near_dedup, packing, secrets, toxicity
from accordant.llm.common import table
from accordant.sources.workspace import ensure_named, stored


def _measured_again(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents that are not held out; what it rejects goes."""
    ensure_named(spark)
    known = table(spark, sf_dir, "labels").filter(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id"))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays; every document does."""
    ensure_named(spark)
    return _measured_again(line_dedup.dedup(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    ensure_named(spark)
    return near_dedup.keep_one(docs, width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    ensure_named(spark)
    return _measured_again(secrets.mask(docs, secrets.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens with its place in a sequence."""
    ensure_named(spark)
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]

#: Tokens, trained scores and iterative components have no SQL; tests hold a small run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_named(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
