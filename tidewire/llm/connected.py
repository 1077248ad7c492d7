"""Connected components of a distributed table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import staged, unstage


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are handed to the least of the neighbourhood."""
    around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = around.join(least, "a")
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        handed = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = handed.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Every linked node with the least node it can reach: columns node, component.

    Alternates large-star and small-star steps until the links no longer change, which
    takes about log(n) rounds for a component of n nodes. Minima are aggregated before
    the shuffle; the join that hands them back has one row per node on one side, so
    adaptive execution can split a node with very many links. Each round is written
    to the shared folder. Null ends and loops are ignored; no link gives no row.
    """
    ends = links.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where("l != r")
    current = staged(ends.select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct(), "links")
    before = _checksum(current)
    while before[0]:
        following = staged(_star(_star(current, True), False), "links")
        now = _checksum(following)
        unstage(current)
        current = following
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
