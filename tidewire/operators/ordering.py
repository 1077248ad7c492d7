"""Running totals, quantiles and ranking metrics over a total order, in many tasks.

A window without a partition key sorts everything in one task. Here the order is
cut at split points (one per shuffle partition, found by one sketch aggregate, and
held as literals so that every branch of the plan sees the same cut). Each slice
is summed on its own and the totals of earlier slices are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import row_slices


def split_points(df: DataFrame, column: str, slices: int | None = None) -> list[float]:
    """At most ``slices - 1`` values that cut the column into similar shares."""
    slices = slices or row_slices(df.sparkSession)
    if slices < 2:
        return []
    shares = [i / slices for i in range(1, slices)]
    value = F.nanvl(F.col(column).cast("double"), F.lit(None))  # NaN has no place in the order
    row = df.agg(F.percentile_approx(value, shares, 10000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def with_slice(df: DataFrame, column: str, cuts: Sequence[float], name: str = "_slice") -> DataFrame:
    """Slice number of each row: how many cuts lie at or below its value."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=edges, inputCol=column, outputCol=name).transform(df)
    return sliced.withColumn(name, F.col(name).cast("int"))


def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality on all keys where null equals null."""
    return reduce(
        lambda a, b: a & b,
        [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
    )


def group_key(by: Sequence[str]) -> Column:
    """All group columns as one struct, which is never null and equal where all parts are.

    A plain equality on it treats null groups as groups and, unlike a null-safe
    equality, lets a join reuse the partitioning of the window before it.
    """
    return F.struct(*by) if by else F.lit(0)


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``cum_<c>``, the sum of ``c`` up to and including each row.

    The input has one row per value of ``order`` and group; ``order`` is a double.
    Slices are summed apart; the offsets table has one row per group and slice.
    """
    way = F.desc if descending else F.asc
    sliced = with_slice(df.withColumn("_by", group_key(by)), order, cuts)
    inside = Window.partitionBy("_by", "_slice").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_by").orderBy(way("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_by", "_slice")
        .agg(*[F.sum(c).alias(f"_total_{c}") for c in sums])
        .select("_by", "_slice", *[F.coalesce(F.sum(f"_total_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    )
    rows = sliced.select("*", *[F.sum(c).over(inside).alias(f"_inside_{c}") for c in sums])
    return rows.join(offsets, ["_by", "_slice"]).select(
        *df.columns,
        *[(F.col(f"_inside_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
    )


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; ties are gone afterwards. Missing and NaN scores are left out."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(F.col(label).cast("bigint")).alias("pos"),
            F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
        )
    )


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision per group.

    With running totals from the highest score down, tp and fp, both areas are sums
    over distinct scores: the pairs lost are pos * (fp - neg / 2), and average
    precision adds pos * tp / (tp + fp). A metric that is not defined is null.
    """
    cuts = split_points(df, score)
    counts = score_counts(df, label, score, by)
    running = running_totals(counts, "score", ["pos", "neg"], by, cuts, descending=True)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    areas = running.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("_n_neg"),
        F.sum(pos * (fp - neg / 2)).alias("_lost"),
        F.sum(pos * F.try_divide(tp, tp + fp)).alias("_hits"),
    )
    n_pos, n_neg = F.col("n_pos").cast("double"), F.col("_n_neg").cast("double")
    return areas.select(
        *by,
        (F.col("n_pos") + F.col("_n_neg")).alias("n"),
        "n_pos",
        F.try_divide(n_pos * n_neg - F.col("_lost"), n_pos * n_neg).alias("roc_auc"),
        F.try_divide(F.col("_hits"), n_pos).alias("average_precision"),
    )


def exact_quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles per group, one named column per share.

    ``percentile`` keeps all distinct values of a group in one task; this counts
    per value, runs the totals in slices and picks the two neighbours by rank.
    """
    by = list(by)
    present = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_value"))
    counts = present.groupBy(*by, "_value").agg(F.count("*").alias("_n"))
    running = running_totals(counts, "_value", ["_n"], by, split_points(present, "_value"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    if by:
        keyed = totals.select(group_key(by).alias("_by"), "_all")
        ranked = running.withColumn("_by", group_key(by)).join(keyed, "_by").drop("_by")
    else:
        ranked = running.withColumn("_all", totals.scalar())
    aggregates, results = [], []
    for name, share in shares.items():
        rank = (F.col("_all") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("cum__n") > F.floor(rank), F.col("_value")))
        high = F.min(F.when(F.col("cum__n") > F.ceil(rank), F.col("_value")))
        aggregates += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}")]
        aggregates.append(F.max(rank - F.floor(rank)).alias(f"_part_{name}"))
        low, high, part = (F.col(f"_{side}_{name}") for side in ("low", "high", "part"))
        results.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*aggregates).select(*by, *results)
