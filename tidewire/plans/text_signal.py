"""Scored articles to daily text signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import dates, numeric, text
from tidewire.operators.summaries import group_means
from tidewire.sources.tables import present


def prepare_labels(df: DataFrame, label_col: str = "suggested_label") -> DataFrame:
    """Rows with one of the two labels and a text that is not blank."""
    return drop_blank(
        df.filter(F.col(label_col).isin(fv.LABEL_YES, fv.LABEL_NO)).withColumn(
            "label", numeric.label_value(F.col(label_col))
        )
    )


def drop_blank(df: DataFrame, text_col: str = "text_clean") -> DataFrame:
    """Strip texts and drop the ones without any visible character."""
    return df.filter(text.has_visible(F.col(text_col))).withColumn(text_col, text.strip(F.col(text_col)))


def with_predictions(df: DataFrame, prob: str = "pred_prob_climate") -> DataFrame:
    """Label at 0.5, its name, and whether the probability is near either end."""
    p = F.col(prob)
    labelled = df.withColumns({"pred_label": numeric.binary_label(p), "high_conf": numeric.is_sure(p)})
    return labelled.withColumn("pred_label_name", numeric.label_name(F.col("pred_label")))


def _daily(scored: DataFrame, extra: Sequence) -> DataFrame:
    dated = scored.withColumn("news_date", dates.plain_date(F.col("news_date"))).na.drop(subset=["news_date"])
    label, prob = F.col("pred_label").cast("double"), F.col("pred_prob_climate")
    daily = dated.groupBy("news_date").agg(
        F.count("text_clean").alias("n_articles"),
        F.sum("pred_label").alias("n_pred_climate"),
        F.avg(label).alias("climate_share"),
        F.avg(prob).alias("climate_intensity_mean"),
        F.sum(prob).alias("climate_intensity_sum"),
        *extra,
    )
    logged = ["n_articles", "n_pred_climate", "climate_intensity_sum"]
    return daily.withColumns({f"log_{c}": F.log1p(F.col(c)) for c in logged})


def daily_signal_a(scored: DataFrame) -> DataFrame:
    """Counts, shares and intensities per day, mean tone, means of the topic flags.

    One aggregate: tone and flags share the key, so nothing is joined. Columns the
    input lacks are left out.
    """
    extra = []
    if "tone_score" in scored.columns:
        extra.append(F.avg("tone_score").alias("avg_tone_score"))
    return _daily(scored, extra + group_means({c: c for c in present(scored, fv.TOPIC_FLAGS)}))


def daily_signal_b(scored: DataFrame) -> DataFrame:
    """As signal A, with tone among the means and under its own name."""
    means = present(scored, [*fv.TOPIC_FLAGS, "tone_score"])
    return _daily(scored, group_means({c: c for c in means}))


def usable_for_scoring(df: DataFrame) -> DataFrame:
    return df.filter(F.length("text_clean") >= fv.MIN_SCORED_CHARS)


def daily_signal_c(scored: DataFrame, prob: str = "climatebert_prob", label: str = "climatebert_label") -> DataFrame:
    """Level, peak and spread of the probability per day; spread 0 for one article."""
    daily = scored.groupBy("news_date").agg(
        F.count("*").alias("n_articles"),
        F.sum(label).alias("n_climate_bert"),
        F.avg(prob).alias("climate_prob_mean"),
        F.max(prob).alias("climate_prob_max"),
        F.coalesce(F.stddev_samp(prob), F.lit(0.0)).alias("climate_prob_std"),
        *group_means(fv.FLAG_MEANS),
    )
    return daily.withColumns(
        {
            "climate_share_bert": F.try_divide("n_climate_bert", "n_articles"),
            "log_n_articles": F.log1p("n_articles"),
        }
    )


def top_articles(scored: DataFrame, prob: str, id_col: str, n: int = 5, shown_chars: int = 120) -> DataFrame:
    """The n most probable rows with the head of their text, for reading."""
    return (
        scored.orderBy(F.desc(prob), id_col)
        .limit(n)
        .select(id_col, "news_date", prob, text.prefix(F.col("text_clean"), shown_chars).alias("head"))
    )
