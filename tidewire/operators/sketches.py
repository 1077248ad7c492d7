"""Approximate quantiles from mergeable sketches, where a bounded rank error will do.

``ordering.exact_quantiles`` reads all values again for every period. A sketch of a
few kilobytes per day is written once; a period merges the sketches of its days, so a
new day costs its own rows only. The exact form stays the default everywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sketch size; with it a rank is off by under 0.4 % of the rows with a confidence of 99 % (1.33 % at Spark's default of 200).
K = 800


def sketched(df: DataFrame, value: str, by: Sequence[str], k: int = K) -> DataFrame:
    """One sketch per group. Missing and NaN values are left out; a group without others has no row.

    Sketches are built before the shuffle, so a group that holds most rows is no burden.
    """
    number = F.col(value).cast("double")
    return df.filter(number.isNotNull() & ~F.isnan(number)).groupBy(*by).agg(F.kll_sketch_agg_double(number, k).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str | Column] = (), k: int = K) -> DataFrame:
    """Fewer groups from the sketches of more: days to months, or all into one."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """The sketch replaced by the number of values ``n`` and one named quantile per share."""
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(share))) for name, share in shares.items()}
    return sketches.withColumns({"n": F.kll_sketch_get_n_double("sketch"), **found}).drop("sketch")
