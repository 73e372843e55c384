"""The corpus pipeline: toxic texts go, near duplicates go, test passages go, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.llm import decontamination, jaccard_join, packing, pii, toxicity
from defectspark.llm.common import fold, store
from defectspark.llm.queries import toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under one half, all of them where labels allow no fit; null and empty texts have no toxic feature."""
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs), out="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates: the one with the smallest id."""
    return jaccard_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of a benchmark item."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the new text."""
    found = store(pii.with_spans(docs.select("doc_id", "text")).select("doc_id", "__pii"), "pipeline-pii")
    masked = pii.redact(docs, pii.fit(found, fold(F.col("doc_id"), 4) == 0))
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return masked.withColumn("n_chars", n_chars).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of at most 2048 tokens."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# Learned scores and redactions have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
