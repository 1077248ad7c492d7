"""Train and test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_by_date(df: DataFrame, date: str, first_test: str, last_test: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the first test day, and rows between both days, ends included."""
    first = F.lit(first_test).cast("date")
    last = F.lit(last_test).cast("date")
    return df.filter(F.col(date) < first), df.filter(F.col(date).between(first, last))


def draw(id_col: str, seed: int) -> Column:
    """A repeatable, evenly spread text per row id."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_split(
    df: DataFrame, id_col: str, label: str, test_share: float, seed: int = 42, name: str = "is_test", digits: int = 3
) -> DataFrame:
    """Mark exactly ceil(share * n) rows of every label as test rows.

    The rows with the smallest draws are taken. Instead of ranking a label in one
    task, draws are counted by their leading digits, only the one bucket per label
    in which the limit falls is ranked, and the limit goes back as one row per
    label. The marked rows themselves are not moved.
    """
    slim = df.select(F.col(label).alias("_label"), draw(id_col, seed).alias("_draw"))
    slim = slim.filter(F.col("_label").isNotNull()).withColumn("_bucket", F.substring("_draw", 1, digits))
    per_label = Window.partitionBy("_label")
    upto = per_label.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.ceil(F.sum("_n").over(per_label) * F.lit(float(test_share)) - 1e-9)
    edge = (
        slim.groupBy("_label", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("_label", "_bucket", "_n", F.sum("_n").over(upto).alias("_upto"), wanted.alias("_wanted"))
        .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
        .select("_label", "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    inside = Window.partitionBy("_label", "_bucket").orderBy("_draw")
    limits = (
        slim.join(edge, ["_label", "_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter("_rank = _take")
        .select("_label", F.col("_draw").alias("_limit"))
    )
    return (
        df.join(limits, F.col(label) == F.col("_label"), "left")
        .withColumn(name, F.coalesce(draw(id_col, seed) <= F.col("_limit"), F.lit(False)))
        .drop("_label", "_limit")
    )


def contiguous_folds(
    df: DataFrame, label: str, order: Sequence[str], k: int, name: str = "fold", by_label: bool = True
) -> DataFrame:
    """k blocks per label along ``order``, sizes differing by at most one.

    ``order`` should leave no ties, or the blocks are not repeatable. Rows are ranked
    within one value of the first order column (a day); the days before it are added
    from a table with one row per label and day, so no task holds a label.
    """
    keys, first = ([label] if by_label else []), order[0]
    slim = df.withColumn("_by", F.struct(*keys) if keys else F.lit(0)).withColumn("_first", F.col(first))
    per_label = Window.partitionBy("_by")
    earlier = per_label.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        slim.groupBy("_by", "_first")
        .agg(F.count("*").alias("_n"))
        .select("_by", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(per_label).alias("_all"))
    )
    inside = Window.partitionBy("_by", "_first").orderBy(*order)
    ranked = slim.withColumn("_nth", F.row_number().over(inside)).join(days, ["_by", "_first"])
    place = F.col("_before") + F.col("_nth") - 1  # from 0
    # the first `_all % k` blocks hold one row more, as ntile has it
    size, more = F.floor(F.col("_all") / k), F.col("_all") % k
    long = more * (size + 1)
    block = F.when(place < long, F.floor(place / (size + 1))).otherwise(more + F.floor((place - long) / F.greatest(size, F.lit(1))))
    return ranked.withColumn(name, block.cast("int")).drop("_by", "_first", "_nth", "_before", "_all")


def three_way_split(
    df: DataFrame, id_col: str, label: str, test_share: float = 0.2, validation_share: float = 0.2, seed: int = 42, name: str = "part"
) -> DataFrame:
    """Mark every row ``test``, ``validation`` or ``train``, each label split alike: first the test
    rows of all, then the validation rows of the rest. Rows without a label are ``train``."""
    tested = stratified_split(df, id_col, label, test_share, seed, "_test")
    rest = F.when(~F.col("_test"), F.col(label))
    checked = stratified_split(tested.withColumn("_rest", rest), id_col, "_rest", validation_share, seed + 1, "_validation")
    part = F.when(F.col("_test"), "test").when(F.col("_validation"), "validation").otherwise("train")
    return checked.withColumn(name, part).drop("_test", "_rest", "_validation")
