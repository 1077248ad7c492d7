"""Row-based windows over ordered series, for short and for very long series.

``SeriesOrder`` describes whole series as plain windows: one task handles one
series. That is right when a series is bounded, as with one row per day. A series
without such a bound goes through ``in_chunks``, which cuts it into chunks of a
fixed number of rows; each chunk borrows the rows its frames reach into, so the
same expressions give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewire.session import row_slices, staged

CHUNK_ROWS = 1_000_000


@dataclass(frozen=True)
class SeriesOrder:
    """Which rows form a series and in which order they stand."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def lag(self, value: Column, n: int = 1) -> Column:
        return F.lag(value, n).over(self.window())

    def lead(self, value: Column, n: int = 1) -> Column:
        return F.lead(value, n).over(self.window())

    def rolling(self, fn: Callable[[Column], Column], value: Column, k: int, include_current: bool) -> Column:
        """``fn`` over k rows, null unless all k values are present."""
        last = 0 if include_current else -1
        frame = self.window().rowsBetween(last - k + 1, last)
        return F.when(F.count(value).over(frame) == k, fn(value).over(frame))

    def rolling_std(self, value: Column, k: int, include_current: bool) -> Column:
        return self.rolling(F.stddev_samp, value, k, include_current)

    def rolling_mean(self, value: Column, k: int, include_current: bool) -> Column:
        return self.rolling(F.avg, value, k, include_current)


def range_slices(df: DataFrame, series: SeriesOrder, name: str) -> DataFrame:
    """Number the table's own slices: neighbours in series and order, about as many rows each.

    The rows are dealt by ranges of all keys and order columns, so one long series, or
    one crowded day of it, lies in several slices. The dealt rows are written once:
    the numbers must be the same for every later reader.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(row_slices(spark), *series.keys, *series.order)
    return staged(dealt.withColumn(name, F.spark_partition_id()), "slices")


def with_positions(df: DataFrame, series: SeriesOrder, name: str, length: str | None = None) -> DataFrame:
    """Number the rows of each series from 0 without sorting a series in one task.

    Rows are numbered inside slices of the order; the counts of earlier slices, one
    row per series and slice, give the offset. ``length`` names a column for the
    number of rows of the series, which the same counts give.
    """
    keys = list(series.keys)
    tagged = range_slices(df, series, "_bucket")
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_rows"))
        .select(
            *keys,
            "_bucket",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
            *([F.sum("_rows").over(Window.partitionBy(*keys)).alias(length)] if length else []),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*series.order)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def in_chunks(
    df: DataFrame,
    series: SeriesOrder,
    before: int,
    after: int,
    compute: Callable[[DataFrame, SeriesOrder], DataFrame],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run ``compute`` over chunks of a series instead of whole series.

    ``before`` and ``after`` say how many rows the expressions reach to either
    side, stacked expressions added up. Every row is returned once, from the chunk
    that owns it. Series keys and order columns must not be null.
    """
    if max(before, after) > chunk_rows:
        raise ValueError("chunk_rows must be at least as large as the frame")
    place = F.col("_position") % chunk_rows
    own = F.floor(F.col("_position") / chunk_rows)
    copies = F.filter(
        F.array(
            own,
            F.when(place >= chunk_rows - before, own + 1),
            F.when((place < after) & (own > 0), own - 1),
        ),
        lambda c: c.isNotNull(),
    )
    spread = (
        with_positions(df, series, "_position")
        .withColumn("_own", own)
        .withColumn("_chunk", F.explode(copies))
    )
    inner = SeriesOrder((*series.keys, "_chunk"), ("_position",))
    return compute(spread, inner).filter("_chunk = _own").drop("_position", "_own", "_chunk")


def row_sequences(
    df: DataFrame,
    series: SeriesOrder,
    features: Sequence[str],
    k: int,
    include_current: bool = False,
    name: str = "sequence",
    chunk_rows: int | None = None,
) -> DataFrame:
    """The k rows before each row as one array of feature arrays.

    Rows with fewer than k predecessors give no sample. ``chunk_rows`` cuts a series
    without a bound into chunks of that many rows; each borrows the k rows before it,
    so the arrays are the same and no task holds the series.
    """
    if chunk_rows:
        return in_chunks(
            df, series, k, 0, lambda rows, inner: row_sequences(rows, inner, features, k, include_current, name), chunk_rows
        )
    last = 0 if include_current else -1
    frame = series.window().rowsBetween(last - k + 1, last)
    row = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn(name, F.collect_list(row).over(frame)).filter(F.size(name) == k)
