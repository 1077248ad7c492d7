"""Operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontamination, line_dedup, minhash_dedup, quality, queries

LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality.score(docs, queries.quality_labels(spark, sf_dir))
    return scored.where(F.col("score") >= LEAST_QUALITY).select("doc.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go. A column n_chars follows the text."""
    cleaned = line_dedup.remove_repeated_lines(docs)
    left = cleaned.where("n_removed = 0 or trim(replace(text, '\\n', ' ')) != ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("doc.n_chars"))
        new["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return left.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    gone = minhash_dedup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == F.col("gone_id"), "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and round trip."""
    return bpe.digests(docs, queries.vocabulary())
