"""Daily prices of one or many series to lagged features and a tail target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import dates, numeric
from tidewire.operators.ordering import exact_quantiles
from tidewire.operators.windows import CHUNK_ROWS, SeriesOrder, in_chunks

@dataclass(frozen=True)
class Chunks:
    """Cut series that one task cannot hold; see ``windows.in_chunks``."""

    rows: int = CHUNK_ROWS


def load_prices(
    raw: DataFrame,
    date: str,
    price: str,
    start: str = fv.MARKET_START,
    end: str = fv.MARKET_END,
    series: str | None = None,
) -> DataFrame:
    """Typed ``series_id, date, wti_price``; rows without both values are dropped first."""
    return (
        raw.select(
            (F.col(series) if series else F.lit("")).alias("series_id"),
            dates.plain_date(F.col(date)).alias("date"),
            numeric.number(F.col(price)).alias("wti_price"),
        )
        .na.drop(subset=["date", "wti_price"])
        .filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )


def _run(df: DataFrame, order: SeriesOrder, before: int, after: int, compute, chunks: Chunks | None) -> DataFrame:
    if chunks is None:
        return compute(df, order)
    return in_chunks(df, order, before, after, compute, chunks.rows)


def return_features(
    prices: DataFrame, include_current: bool = False, chunks: Chunks | None = None, order: tuple[str, ...] = ("date",)
) -> DataFrame:
    """Log price and return, lags, rolling volatility and mean, next return.

    All windows share one partitioning and order, so one shuffle and one sort serve
    both levels. A series of one row per day is bounded by the calendar; pass
    ``chunks`` for finer or unbounded series.
    """

    def compute(df: DataFrame, s: SeriesOrder) -> DataFrame:
        positive = F.col("wti_price") > 0
        logged = df.withColumns(
            {"price_valid_for_log": positive, "log_price": numeric.safe_ln(F.col("wti_price"))}
        )
        returns = logged.withColumn("log_return", F.col("log_price") - s.lag(F.col("log_price")))
        ret = F.col("log_return")
        made = {"ret_lag1": s.lag(ret), "abs_ret_lag1": s.lag(F.abs(ret))}
        made |= {f"rv_{k}": s.rolling_std(ret, k, include_current) for k in fv.VOLATILITY_WINDOWS}
        made |= {f"ret_mean_{k}": s.rolling_mean(ret, k, include_current) for k in fv.MEAN_WINDOWS}
        made["ret_t_plus_1"] = s.lead(ret)
        return returns.withColumns(made)

    reach = max(fv.VOLATILITY_WINDOWS) + 1
    return _run(prices, SeriesOrder(("series_id",), order), reach, 1, compute, chunks)


def _training_value(basis: str, train_end: str, end_included: bool) -> Column:
    limit = F.lit(train_end).cast("date")
    return F.when(F.col("date") <= limit if end_included else F.col("date") < limit, F.col(basis))


def tail_threshold(
    features: DataFrame,
    train_end: str,
    quantile: float,
    basis: str = "ret_t_plus_1",
    end_included: bool = True,
    bounded: bool = True,
) -> DataFrame:
    """The training quantile per series: ``series_id, tail_threshold_train``.

    ``bounded`` series (one row per day) use one ``percentile`` aggregate; others
    the exact distributed quantile.
    """
    train = features.withColumn("_basis", _training_value(basis, train_end, end_included))
    if bounded:
        return train.groupBy("series_id").agg(F.percentile("_basis", quantile).alias("tail_threshold_train"))
    return exact_quantiles(train, "_basis", {"tail_threshold_train": quantile}, ["series_id"])


def _with_threshold(
    features: DataFrame, train_end: str, quantile: float, basis: str, end_included: bool, bounded: bool
) -> DataFrame:
    """Put the training quantile on every row of its series.

    A bounded series already lies in one task, so the quantile is one more window
    there and nothing is joined.
    """
    if bounded:
        value = F.percentile(_training_value(basis, train_end, end_included), quantile)
        return features.withColumn("tail_threshold_train", value.over(Window.partitionBy("series_id")))
    threshold = tail_threshold(features, train_end, quantile, basis, end_included, bounded=False)
    return features.join(threshold, "series_id", "left")


def market_panel(
    prices: DataFrame,
    train_end: str = fv.MARKET_TRAIN_END,
    quantile: float = fv.TAIL_QUANTILE,
    include_current: bool = False,
    chunks: Chunks | None = None,
    order: tuple[str, ...] = ("date",),
) -> DataFrame:
    """The full panel, ``series_id`` first and then the contract columns.

    A missing return is never below the threshold, so its target is 0;
    ``usable_for_model`` tells such rows apart.
    """
    features = return_features(prices, include_current, chunks, order)
    limited = _with_threshold(features, train_end, quantile, "ret_t_plus_1", True, bounded=chunks is None)
    return limited.withColumns(
        {
            "day": dates.day_key(F.col("date")),
            "target_tail_t_plus_1": numeric.below(F.col("ret_t_plus_1"), F.col("tail_threshold_train")),
            "usable_for_model": numeric.all_present([F.col(c) for c in fv.PREDICTORS]),
        }
    ).select("series_id", *fv.MARKET_PANEL_COLUMNS)


def model_features(
    prices: DataFrame, split: str = fv.MODEL_SPLIT, quantile: float = fv.TAIL_QUANTILE
) -> DataFrame:
    """The variant the tabular models use.

    Returns are logs of price ratios (two negative prices give a value), rolling
    statistics include the current row, and the threshold is the quantile of the
    same-day return before the split day. One row per series and day.
    """
    s = SeriesOrder(("series_id",), ("date",))
    price = F.col("wti_price")
    ratio = numeric.safe_ln(F.try_divide(price, s.lag(price)))
    ret = F.col("log_return")
    made = {"lag1_return": s.lag(ret), "lag1_abs_return": s.lag(F.abs(ret))}
    made |= {f"rvol_{k}d": s.rolling_std(ret, k, True) for k in fv.VOLATILITY_WINDOWS}
    made |= {f"ret_mean_{k}d": s.rolling_mean(ret, k, True) for k in fv.MEAN_WINDOWS}
    made["_next"] = s.lead(ret)
    features = prices.withColumn("log_return", ratio).withColumns(made)
    limited = _with_threshold(features, split, quantile, "log_return", False, bounded=True)
    return limited.withColumn("target_tail", numeric.below(F.col("_next"), F.col("tail_threshold_train"))).drop("_next")


def panel_profile(panel: DataFrame) -> DataFrame:
    """Row counts, usable rows, price and date range and threshold per series."""
    return panel.groupBy("series_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if("usable_for_model").alias("n_usable"),
        F.count_if(F.col("wti_price") <= 0).alias("n_non_positive"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("wti_price").alias("min_price"),
        F.max("wti_price").alias("max_price"),
        F.min("tail_threshold_train").alias("tail_threshold"),
        F.avg(F.col("target_tail_t_plus_1").cast("double")).alias("tail_rate"),
    )
