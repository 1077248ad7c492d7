"""Names to queries and to their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.sources.tables import spread

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with checking SQL if there is any."""

    def register(fn: Query) -> Query:
        _queries[fn.__name__] = fn
        if sql:
            _sql[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of texts. The setting ``tidewire.text.tasks`` says that its files have too few row groups."""
    tasks = spark.conf.get("tidewire.text.tasks", None)
    return spread(table(spark, sf_dir, name), key, int(tasks) if tasks else None)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6(expression: str, name: str) -> str:
    """The same rounding in SQL."""
    return f"round({expression}, 6) + 0.0::double as {name}"
