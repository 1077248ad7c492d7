"""Folds and bounded samples for the fitted operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.batches import packed, small_batches


def remainder(parts: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def thinned(rows: DataFrame, key: str, size: int, count: int) -> DataFrame:
    """About `size` of `count` rows, chosen by a hash of the key and so the same on every run."""
    if count <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(0x5EED), key), F.lit(1 << 40)) < int(size / count * (1 << 40)))


def frequencies(docs: DataFrame, counter, dims: int) -> np.ndarray:
    """Sum over all documents of the vectors that `counter(column)` yields per group of documents.

    Every task adds up its documents; one row per task and dimension is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, dtype=np.int64)
        for batch in batches:
            for part in counter(batch.column(0)):
                total += part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["k", "n"])

    small_batches(docs.sparkSession)
    summed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(dims, dtype=np.int64)
    for row in summed.collect():  # dims rows, a fixed number
        out[row["k"]] = row["n"]
    return out


def attached(docs: DataFrame, work, added: T.StructType) -> DataFrame:
    """All columns of docs as struct `doc`, and the columns that `work(text column)` yields per group as (low, high, arrays)."""

    names = added.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = work()
        for batch in batches:
            for low, high, arrays in scorer(batch.column(0).field("text")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *arrays], names=["doc", *names])

    rows = packed(docs)
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *added.fields]))
