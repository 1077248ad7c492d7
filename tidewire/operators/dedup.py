"""Keep the first row per key, in an order the caller names.

A window over each key would sort all copies of one text in one task. Here only
the row id and the keys are reduced, with partial aggregates before the shuffle,
so a key that holds a third of the table shrinks to one row per input split. The
full rows are joined back once, on their unique id.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_ids(
    df: DataFrame, id_col: str, steps: Sequence[Mapping[str, Column]], where: Column | None = None
) -> DataFrame:
    """Ids that survive keep-first by each step's key columns in turn.

    ``steps`` is a list of {name: key expression}. The lowest id of a key wins;
    nulls are equal to each other. Later steps see only survivors of earlier ones.

    Only rows that meet ``where`` can win. The condition is tested inside the first
    aggregate: a filter on a computed column would be pushed below the projection
    and compute a costly text expression a second time.
    """
    keys = {f"_key{i}_{name}": expr for i, step in enumerate(steps) for name, expr in step.items()}
    names = [[f"_key{i}_{name}" for name in step] for i, step in enumerate(steps)]
    allowed = F.lit(True) if where is None else where
    slim = df.select(id_col, allowed.alias("_allowed"), *[expr.alias(name) for name, expr in keys.items()])
    for i, current in enumerate(names):
        later = [n for group in names[i + 1 :] for n in group]
        row = F.struct(id_col, *later) if later else F.col(id_col)
        first = F.min(F.when(F.col("_allowed"), row) if i == 0 else row).alias("_first")
        slim = slim.groupBy(*current).agg(first).filter("_first is not null")
        slim = slim.select("_first.*") if later else slim.select(F.col("_first").alias(id_col))
    return slim


def keep_first(
    df: DataFrame, id_col: str, steps: Sequence[Mapping[str, Column]], where: Column | None = None
) -> DataFrame:
    """The rows of ``df`` whose id survives; ``id_col`` must be unique."""
    return df.join(first_ids(df, id_col, steps, where), id_col, "left_semi")


def distinct_counts(df: DataFrame, key: Column, tag: Column, tag_name: str = "tag") -> DataFrame:
    """Rows and distinct keys per tag in two partial aggregates."""
    per_key = df.groupBy(tag.alias(tag_name), key.alias("_key")).agg(F.count("*").alias("_n"))
    return per_key.groupBy(tag_name).agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_distinct"),
    )
