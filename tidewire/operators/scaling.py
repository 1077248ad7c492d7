"""Scaling, filling and class weights from one-row statistics.

The statistics are one row, read as a scalar subquery: no join, no second pass
over the data on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, fit_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation of ``fit_on``.

    A constant column is only centred.
    """
    parts = []
    for c in columns:
        parts += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_dev")]
    stats = fit_on.agg(F.struct(*parts).alias("s"))

    def scaled(c: str) -> Column:
        dev = F.col(f"_stats.{c}_dev")
        return (F.col(c) - F.col(f"_stats.{c}_mean")) / F.when(dev == 0, 1.0).otherwise(dev)

    fitted = df.withColumn("_stats", stats.scalar())
    return fitted.withColumns({c: scaled(c) for c in columns}).drop("_stats")


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column, kept apart from the rows they were taken from."""

    statistics: Mapping[str, tuple[float | None, float | None]]

    def apply(self, df: DataFrame) -> DataFrame:
        """As `standardize`; a column that had no value becomes null."""
        return df.withColumns(
            {c: (F.col(c) - F.lit(mean).cast("double")) / F.lit(dev if dev != 0 else 1.0).cast("double") for c, (mean, dev) in self.statistics.items()}
        )


def fit_scaler(fit_on: DataFrame, columns: Sequence[str]) -> Scaler:
    """The statistics of `standardize` as values, for models that outlive the session: one row comes to the driver."""
    found = fit_on.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
    return Scaler({c: tuple(found[c]) for c in columns})


def fill_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Replace missing values by the exact median of ``fit_on`` (default: all rows).

    For daily tables: the median keeps one entry per distinct value, at most one
    per row and day.
    """
    source = df if fit_on is None else fit_on
    medians = source.agg(F.struct(*[F.percentile(c, 0.5).alias(c) for c in columns]).alias("m"))
    filled = df.withColumn("_medians", medians.scalar())
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_medians.{c}")) for c in columns}).drop("_medians")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: class sizes, the balanced weight n / (2 n_class) of each, n0 / max(n1, 1)."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")
    return counts.select(
        "n0",
        "n1",
        F.try_divide(n, 2 * F.col("n0")).alias("weight0"),
        F.try_divide(n, 2 * F.col("n1")).alias("weight1"),
        (F.col("n0") / F.greatest(F.col("n1"), F.lit(1))).alias("positive_weight"),
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Row weights that give both classes the same total; they add up to n."""
    weights = class_weights(df, label).select(F.struct("weight0", "weight1").alias("w"))
    with_both = df.withColumn("_weights", weights.scalar())
    chosen = F.when(F.col(label) == 1, F.col("_weights.weight1")).otherwise(F.col("_weights.weight0"))
    return with_both.withColumn(name, chosen).drop("_weights")
