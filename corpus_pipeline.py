"""The corpus pipeline: documents in, token digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import stages
from tidewire.session import staged

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_classifier", stages.good_quality),
    ("line_dedup", stages.without_repeated_lines),
    ("minhash_dedup", stages.without_near_copies),
    ("decontamination", stages.without_benchmark),
    ("bpe", stages.token_digests),
]
#: SQL cannot express the fitted classifier, the tokenizer and the near copies; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
