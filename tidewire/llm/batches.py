"""Rows on their way to Python tasks and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at once.
ROWS_PER_BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batch size to ROWS_PER_BATCH, if it is larger; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_PER_BATCH:
        spark.conf.set(name, ROWS_PER_BATCH)


def packed(docs: DataFrame) -> DataFrame:
    """All columns of docs as one struct `doc`, so that no name can clash; its field `text` is a string."""
    small_batches(docs.sparkSession)
    columns = [docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in docs.columns]
    return docs.select(F.struct(*columns).alias("doc"))
