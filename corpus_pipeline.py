"""A corpus from raw documents to packed sequences: toxicity, exact and near deduplication, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from tapeloom.llm.common import DOCUMENT_COLUMNS, documents, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of `docs`."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    carry = tuple(c for c in DOCUMENT_COLUMNS if c != "doc_id")
    return toxicity.toxicity(docs, model, carry=carry).where("predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest original stays."""
    return exact_dedup.first_copies(docs.select(*DOCUMENT_COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays, that with the smallest id."""
    losers = near_dedup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(losers, "doc_id", "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays, n_chars follows the new text."""
    return secrets.redact(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.word_bpe())


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack_sequences)]

#: SQL has neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
