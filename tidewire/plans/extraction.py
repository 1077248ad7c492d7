"""Downloaded pages to article texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import html


def extract_text(pages: DataFrame, html_col: str = "html", min_chars: int = fv.MIN_EXTRACTED_CHARS) -> DataFrame:
    """Replace the page source by text, method, success flag and length.

    The second reading runs only where the first is too short, and wins only when
    it is long enough. A text that is too short is no success: null, length 0.
    Write the result before filtering on it: a filter pushed below would run the
    extraction again.
    """
    source = F.col(html_col)
    read = pages.withColumn("_primary", html.primary_text(source))
    short = F.coalesce(F.length("_primary"), F.lit(0)) < min_chars
    read = read.withColumn("_fallback", F.when(source.isNotNull() & short, html.fallback_text(source)))
    rescued = F.coalesce(F.length("_fallback") >= min_chars, F.lit(False))
    best = F.when(rescued, F.col("_fallback")).when(~short, F.col("_primary"))
    method = (
        F.when(source.isNull(), fv.DOWNLOAD_FAILED).when(rescued, "fallback_html").otherwise("primary_html")
    )
    return (
        read.withColumns({"extract_method": method, "text": best})
        .withColumns(
            {
                "extract_success": F.col("text").isNotNull(),
                "text_len": F.coalesce(F.length("text"), F.lit(0)),
            }
        )
        .drop("_primary", "_fallback", html_col)
    )
