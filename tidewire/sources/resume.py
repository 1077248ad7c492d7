"""Restartable output: skip finished rows, append only new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.ordering import same_keys

KEY = ("news_date", "url_norm")


def remaining(todo: DataFrame, done: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of ``todo`` whose key is not in ``done``; null keys are equal."""
    finished = done.select(*key).alias("done")
    return todo.alias("todo").join(finished, same_keys("todo", "done", key), "left_anti")


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def finished(todo: DataFrame, path: str, day: str) -> DataFrame | None:
    """The rows at ``path`` of the days that occur in ``todo``; None if there is no table yet."""
    done = read_if_exists(todo.sparkSession, path)
    if done is None:
        return None
    days = [r[0] for r in todo.select(F.col(day).cast("string")).distinct().collect()]
    here = F.col(day).cast("string").isin([d for d in days if d is not None])
    return done.filter(here | F.col(day).isNull() if None in days else here).withColumn(day, F.col(day).cast(todo.schema[day].dataType))


def append_remaining(todo: DataFrame, path: str, key: Sequence[str] = KEY, day: str = "news_date") -> None:
    """Append the unfinished rows to the table at ``path``, which has one folder per ``day``.

    Only the folders of the days in ``todo`` are read, so a run costs what its own days
    hold, however long the table has grown; the days of a batch are few and come to the
    driver. ``day`` must be part of the key. Repeating a call after a failure is harmless:
    whatever rows an earlier one did write are skipped by the anti join.
    """
    done = finished(todo, path, day)
    rows = todo if done is None else remaining(todo, done, key)
    rows.write.mode("append").partitionBy(day).parquet(path)
