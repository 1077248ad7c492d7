"""Market features, daily news and the text signal in one modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import dates, numeric
from tidewire.operators.scaling import fill_median
from tidewire.session import staged


def news_features(news: DataFrame) -> DataFrame:
    """Day-first dates, shares within the day's articles, entropy over six topics."""
    shares = {name: F.try_divide(raw, "n_articles_climate") for name, raw in fv.WITHIN_SHARES.items()}
    mix = numeric.entropy([F.col(c) for c in fv.TOPIC_COUNTS])
    return news.withColumns(
        {"date": dates.day_first_date(F.col("news_date")), **shares, "narrative_entropy": mix}
    ).select("date", *fv.NEWS_WITHIN_FEATURES, *fv.NEWS_GLOBAL_FEATURES)


def join_news(market: DataFrame, news: DataFrame) -> DataFrame:
    """Trading days that have news and a full volatility window.

    The news side has one row per day; adaptive execution broadcasts it once its
    size is known, so no hint is given here.
    """
    return market.join(news, "date", "inner").na.drop(subset=["rvol_22d", "target_tail"])


def join_text_signal(table: DataFrame, signal: DataFrame, columns: Sequence[str] = fv.TEXT_SIGNAL) -> DataFrame:
    """Add the text signal; ``has_text_signal`` tells the days that have one."""
    dated = signal.select(dates.plain_date(F.col("news_date")).alias("date"), *columns)
    return table.join(dated, "date", "left").withColumn("has_text_signal", F.col(columns[0]).isNotNull())


def model_table(
    market: DataFrame,
    news: DataFrame,
    signal: DataFrame,
    columns: Sequence[str] = fv.TEXT_SIGNAL,
    fit_on: str | None = None,
) -> DataFrame:
    """Market, news and text signal per day, gaps filled with the median.

    ``fit_on`` is a filter for the rows the median comes from (such as the training
    period); all rows by default. The joined rows are written once, because the
    medians and everything after them read the table again.
    """
    joined = staged(join_text_signal(join_news(market, news), signal, columns), "model-table")
    return fill_median(joined, columns, joined.filter(fit_on) if fit_on else None)


def dropped_days(market: DataFrame, news: DataFrame) -> DataFrame:
    """How many trading days with a full window have no news."""
    missing = market.na.drop(subset=["rvol_22d"]).join(news.select("date"), "date", "left_anti")
    return missing.agg(F.count("*").alias("n_dropped"), F.min("date").alias("first"), F.max("date").alias("last"))
