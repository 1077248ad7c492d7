"""Shards by a hierarchical weighted hash tree.

A document descends from the root to a region, to a rack, to a shard. At each level every child
draws an exponential waiting time, from a hash of the document's id and the child's name and
with the child's weight as its rate; the shortest time wins. So a child gets rows in proportion
to its weight, and a changed weight moves rows only between the children of its parent, from
there on within the subtree.

A shard that is added later raises the weights of its rack and region by an increment, and the
increment draws for itself at the root: rows that it wins follow it down to the new shard, all
others keep their earlier path at every level. Hence the law `key`: the id and the number of
shards decide, and one more shard takes rows only into itself.

Slots number the rows of a shard without gaps, in the order of another hash of the id. The
order is cut into 4,096 buckets per shard; only a bucket is numbered in one task, and the rows
of earlier buckets are added from a table of counts whose size is fixed (shards x buckets).
The text plays no part in where a row goes, so copies of one text spread like other rows.

Defined results: a null id is placed as an empty one; rows that repeat an id share their shard
and get neighbouring slots; a null text has no bytes (size 8, checksum 0); other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 12
_HASH_BITS = 52


class Shard(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0
    later: bool = False  # added after the tree was laid out


def even_tree(shards: int = 24, regions: int = 2, racks: int = 3) -> list[Shard]:
    """Equal weights; shards dealt to regions and racks in turn, runs of neighbours together."""
    each = -(-shards // (regions * racks))
    return [Shard(f"region{k // (each * racks)}", f"rack{k // each % racks}", k) for k in range(shards)]


def grown(tree: list[Shard], region: str, rack: str, weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard in a rack."""
    return [*tree, Shard(region, rack, max((s.shard for s in tree), default=-1) + 1, weight, True)]


def _hash(key: Column, name: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, _HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _literal_map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)])


def place(rows: DataFrame, key: str, tree: list[Shard], out: str) -> DataFrame:
    """Adds a struct `out` of region, rack and shard: one descent per level through the tree's table of children."""
    children: dict[str, dict[str, float]] = {"": {}}
    places: dict[str, Column] = {}
    for s in tree:
        leaf = f"later/{s.shard}" if s.later else f"{s.region}/{s.rack}/{s.shard}"
        path = ["", leaf] if s.later else ["", s.region, f"{s.region}/{s.rack}", leaf]
        for above, below in zip(path, path[1:]):
            level = children.setdefault(above, {})
            level[below] = level.get(below, 0.0) + s.weight
        places[leaf] = F.struct(F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.shard).alias("shard"))
    table = _literal_map(
        {n: F.array(*[F.struct(F.lit(c).alias("child"), F.lit(w).alias("weight")) for c, w in level.items()]) for n, level in children.items()}
    )

    def below(node: Column) -> Column:
        times = F.transform(
            F.try_element_at(table, node),
            lambda c: F.struct((-F.log((_hash(F.col(key), c["child"]) + 1) / F.lit(float(1 << _HASH_BITS))) / c["weight"]).alias("time"), c["child"].alias("child")),
        )
        return F.coalesce(F.array_min(times)["child"], node)  # a shard has no children

    at = rows.withColumn(out, below(F.lit("")))
    for _ in range(2):
        at = at.withColumn(out, below(F.col(out)))
    return at.withColumn(out, F.try_element_at(_literal_map(places), F.col(out)))


def shard_documents(docs: DataFrame, tree: list[Shard], more: list[Shard] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (in the tree `more`), region, rack for every row of docs."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
        (F.length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = place(rows, "key", tree, "at")
    rows = place(rows, "key", more, "more").withColumn("grown_shard", F.col("more.shard")) if more else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("shard", F.col("at.shard")).withColumn("turn", _hash(F.col("key"), F.lit("slot")))
    rows = rows.withColumn("bucket", F.shiftright("turn", _HASH_BITS - BUCKET_BITS))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("turn", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(inside))
    # at most shards x 2^BUCKET_BITS rows, whatever the input
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        "grown_shard",
        "at.region",
        "at.rack",
    )
