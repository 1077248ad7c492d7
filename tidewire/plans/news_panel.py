"""Article rows with themes and tone to one row of counts, shares and tone per day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import dates, numeric, themes

COUNTED = ["climate", "carbon", "cleantech", "energy", "policy", "transition"]


def scan_articles(articles: DataFrame, start: str, end: str, excluded: str = fv.EXCLUDED_THEME) -> DataFrame:
    """Rows of the ingest days in range, typed, without the excluded theme.

    The range filter is on the bare partition column so that it prunes folders.
    """
    in_range = F.col("ingest_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    lowered = themes.lower_themes(F.col("V2Themes"))
    event_time = dates.compact_timestamp(F.col("DATE"))
    return (
        articles.filter(in_range)
        .select(
            event_time.alias("event_timestamp"),
            F.to_date(event_time).alias("news_date"),
            F.col("DocumentIdentifier").alias("url"),
            F.col("SourceCommonName").alias("source"),
            lowered.alias("themes"),
            numeric.number(F.get(F.split("V2Tone", ","), F.lit(0))).alias("tone_score"),
        )
        .filter(~themes.matches_any(F.col("themes"), [excluded]))
    )


def tag_articles(articles: DataFrame, patterns: Mapping[str, Sequence[str]] = fv.THEME_PATTERNS) -> DataFrame:
    """Add the theme flags, the two combined flags and the two tone parts."""
    climate, carbon, cleantech, energy, policy = (
        F.col(f"is_{n}") == 1 for n in ("climate", "carbon", "cleantech", "energy", "policy")
    )
    relevant = climate | (carbon & energy) | (climate & cleantech) | (climate & policy)
    return articles.withColumns(themes.theme_flags(F.col("themes"), patterns)).withColumns(
        {
            "is_relevant": F.when(relevant, 1).otherwise(0),
            "is_transition": F.when(climate & energy, 1).otherwise(0),
            "positive_tone_component": numeric.positive_part(F.col("tone_score")),
            "negative_tone_component": numeric.negative_part(F.col("tone_score")),
        }
    )


def daily_aggregate(tagged: DataFrame) -> DataFrame:
    """One partial and one final hash aggregate; shares come after it."""
    daily = tagged.groupBy("news_date").agg(
        F.count("*").alias("n_articles"),
        F.avg("tone_score").alias("avg_tone"),
        F.avg("positive_tone_component").alias("avg_positivity"),
        F.avg("negative_tone_component").alias("avg_negativity"),
        *[F.sum(f"is_{n}").alias(f"n_{n}") for n in COUNTED],
    )
    return daily.select("*", *[F.try_divide(f"n_{n}", "n_articles").alias(f"share_{n}") for n in COUNTED])


def daily_news_panel(
    articles: DataFrame,
    start: str = fv.NEWS_START,
    end: str = fv.NEWS_END,
    patterns: Mapping[str, Sequence[str]] = fv.THEME_PATTERNS,
    excluded: str = fv.EXCLUDED_THEME,
) -> DataFrame:
    tagged = tag_articles(scan_articles(articles, start, end, excluded), patterns)
    return daily_aggregate(tagged.filter("is_relevant = 1")).orderBy("news_date")
