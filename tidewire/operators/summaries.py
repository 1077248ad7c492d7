"""Counts, shares and summary rows. All of them aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ordering import exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows and share of rows per value; with ``limit`` only the most frequent ones."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n"))
    shares = counted.withColumn("share", F.try_divide(F.col("n"), total.scalar()))
    if limit is None:
        return shares
    return shares.orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(limit)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum, one row."""
    value = F.col(column)
    base = df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    middle = exact_quantiles(df, column, QUARTILES).select(F.struct(*QUARTILES).alias("q"))
    return base.withColumn("q", middle.scalar()).select(
        "n", "mean", "std", "min", *[f"q.{name}" for name in QUARTILES], "max"
    )


def describe_counts(df: DataFrame, key: str) -> DataFrame:
    """Summary of the number of rows per key."""
    return describe(df.groupBy(key).agg(F.count("*").alias("rows")), "rows")


def score_report(df: DataFrame, score: str, flags: Sequence[str]) -> DataFrame:
    """``part, name, value``: the distribution of a score, and the rows per value of each flag."""
    spread = describe(df, score)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in spread.columns])
    report = spread.select(F.lit(score).alias("part"), F.explode(cells).alias("c")).select("part", "c.*")
    for flag in flags:
        counted = df.groupBy(F.col(flag).cast("string").alias("name")).agg(F.count("*").cast("double").alias("value"))
        report = report.unionByName(counted.withColumn("part", F.lit(flag)))
    return report


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def rate(flag: Column) -> Column:
    """Share of true values among the ones present, as an aggregate."""
    return F.avg(flag.cast("double"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence = (0, 1)) -> DataFrame:
    """Row counts of two small-valued columns; missing pairs count 0."""
    cells = [F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]
    return df.groupBy(row).agg(*cells)


def agreement(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows where both flags are set, where either is, and their ratio."""
    return df.agg(
        F.count_if((left == 1) & (right == 1)).alias("n_both"),
        F.count_if((left == 1) | (right == 1)).alias("n_either"),
    ).withColumn("agreement", F.try_divide("n_both", "n_either"))


def classification_report(df: DataFrame, truth: str, predicted: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, and accuracy; 0 where undefined."""
    t, p = F.col(truth), F.col(predicted)
    cells = df.filter(t.isNotNull() & p.isNotNull()).groupBy(t.alias("t"), p.alias("p")).agg(F.count("*").alias("n"))
    per_class = F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    n = F.col("n")
    report = (
        cells.select("*", per_class)
        .groupBy("class")
        .agg(
            F.sum(F.when((F.col("t") == F.col("class")) & (F.col("p") == F.col("class")), n).otherwise(0)).alias("hits"),
            F.sum(F.when(F.col("p") == F.col("class"), n).otherwise(0)).alias("chosen"),
            F.sum(F.when(F.col("t") == F.col("class"), n).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("t") == F.col("p"), n).otherwise(0)).alias("right"),
            F.sum(n).alias("total"),
        )
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return report.select(
        "class",
        ratio(F.col("hits"), F.col("chosen")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("chosen") + F.col("support")).alias("f1"),
        "support",
        ratio(F.col("right"), F.col("total")).alias("accuracy"),
    )


def group_means(columns: Mapping[str, str]) -> list[Column]:
    return [F.avg(F.col(source).cast("double")).alias(name) for name, source in columns.items()]
