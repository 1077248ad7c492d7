"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

Two permutations of the 64-bit numbers make every coordinate of a signature: shingles go
through the first once, and coordinate k is the least value of the second one circularly
shifted by k. Equal shingle sets are reduced to one class first. Classes that share a band
are candidates. Within each band bucket all classes are first compared with the least one;
then, in buckets that still hold several components, all pairs across components that share
a band are compared inside tasks of bounded size. So every candidate pair is either checked
on full sets or already connected, and no pair list is ever written out.

Defined results: a null or empty text has no shingles and links with nothing; a text of
fewer words than a shingle has its whole sequence as its only one; a row without doc_id can
not be named, so it links with nothing and has a null component; rows that repeat a doc_id
are one vertex; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import bytescan
from tidewire.llm.batches import small_batches
from tidewire.llm.connected import components
from tidewire.session import staged

BANDS = 20
ROWS = 4
#: Shingles that the sets of one side of a comparing task hold together at most, apart from a single larger set.
CELL_SHINGLES = 1_000_000

_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, " + ", ".join(f"band_{k} long" for k in range(BANDS))
_SETS = "doc long, shingles binary, cells array<struct<cell:long,slot:int,side:int>>"
_U64 = np.uint64


def shingle_sets(source: bytescan.Texts, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashed shingles of each document."""
    words = bytescan.words(source, bytescan.BETWEEN_SPACES)
    runs = bytescan.sequence_hash(words.hash, width)
    for low, high in zip(words.bounds[:-1], words.bounds[1:]):
        if high - low >= width:
            yield np.unique(runs[low : high - width + 1])
        else:
            yield bytescan.sequence_hash(words.hash[low:high], int(high - low)) if high > low else np.zeros(0, _U64)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets, one row each."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    first = bytescan.mix(np.concatenate(sets), 101)
    out = np.empty((len(sets), size), dtype=_U64)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(bytescan.mix(first - _U64(k), 202), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number per band of ROWS coordinates, different bands apart."""
    keys = np.zeros((len(signature), BANDS), dtype=_U64)
    for r in range(ROWS):
        keys = bytescan.mix(keys + signature[:, r::ROWS][:, :BANDS], 7 + r)
    return bytescan.mix(keys + np.arange(BANDS, dtype=_U64)[None, :] * _U64(0x9E3779B97F4A7C15), 11)


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, source in bytescan.groups(batch.column(1)):
                sets = list(shingle_sets(source, width))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(sizes)
                prints = np.zeros((len(sets), 2), dtype=_U64)
                keys = np.zeros((len(sets), BANDS), dtype=_U64)
                if len(some):
                    full = [sets[i] for i in some]
                    keys[some] = band_keys(signatures(full, BANDS * ROWS))
                    flat, starts = np.concatenate(full), np.cumsum([0, *sizes[some]])[:-1]
                    for k in range(2):
                        prints[some, k] = np.add.reduceat(bytescan.mix(flat, 31 + k), starts)
                columns = [ids.slice(low, high - low), pa.array(sizes), _column(prints[:, 0]), _column(prints[:, 1])]
                columns += [_column(keys[:, k]) for k in range(BANDS)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SKETCH.split(", ")])

    return run


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Set size, 128-bit fingerprint of the shingle set and band keys of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketches(width), _SKETCH)


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, source in bytescan.groups(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(source, width)]
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(sets, pa.binary()), rows.column(2)], names=["doc", "shingles", "cells"]
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets of distinct numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _linked(percent: int):
    """Links among the sets of one cell that join different components; as few as connect them."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        docs = table["doc"].to_numpy()[order]
        sets = [np.frombuffer(x, dtype=_U64) for x in np.array(table["shingles"].to_pylist(), dtype=object)[order]]
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64)[order] if "bands" in table.column_names else None
        parent = np.unique(table["component"].to_numpy()[order], return_inverse=True)[1]
        found: list[tuple[int, int]] = []
        sizes = np.array([len(s) for s in sets])
        # a star has one row on side 0 and compares all others with it only
        firsts = range(int(np.count_nonzero(side == 0)) if bands is None else len(docs))
        for i in firsts:
            rest = slice(i + 1, None)
            wanted = (parent[rest] != parent[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
            if bands is not None:
                wanted &= (bands[rest] == bands[i]).any(axis=1)
            for j in np.flatnonzero(wanted) + i + 1:
                if parent[j] != parent[i] and similar(sets[i], sets[j], percent):
                    found.append((docs[i], docs[j]))
                    parent[parent == parent[j]] = parent[i]
        return pa.table({"left": pa.array([x for x, _ in found], pa.int64()), "right": pa.array([y for _, y in found], pa.int64())})

    return run


def _verified(cells: DataFrame, percent: int) -> DataFrame:
    return cells.groupBy("cell", "slot").applyInArrow(_linked(percent), "left long, right long")


def _parts(column: str) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.col(column) / CELL_SHINGLES)).cast("int")


def _shard(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("doc"), F.col(parts)).cast("int")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept, for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = staged(sketch(docs, shingle_words), "sketch")
    bands = [f"band_{k}" for k in range(BANDS)]
    classes = (
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy("set_a", "set_b")
        .agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("size"), *[F.first(b).alias(b) for b in bands])
    )
    classes = staged(classes, "classes")
    member = classes.select("doc", "size", F.explode(F.array(*bands)).alias("key"))
    heads = member.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    spokes = member.join(heads, "key").select("doc", "head", "size").distinct()
    spokes = staged(spokes, "spokes")

    # a star per head, cut into parts by the shingles of its members; the head goes to every part
    wheels = spokes.where("doc != head").groupBy("head").agg(F.sum("size").alias("load")).select("head", _parts("load").alias("parts"))
    cell = lambda slot, side, of: F.struct(F.col(of).alias("cell"), slot.cast("int").alias("slot"), F.lit(side).alias("side"))
    spread = spokes.where("doc != head").join(wheels, "head").select("doc", cell(_shard("parts"), 1, "head").alias("c"))
    centres = wheels.select(F.col("head").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "head")
    places = spread.unionByName(centres.select("doc", cell(F.col("k"), 0, "head").alias("c")))
    places = places.groupBy("doc").agg(F.collect_list("c").alias("cells"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    sets = staged(text.join(places.hint("merge"), "doc").mapInArrow(_set_rows(shingle_words), _SETS), "sets")
    stars = sets.select("doc", "shingles", F.explode("cells").alias("c")).select("doc", "shingles", "c.*", F.col("doc").alias("component"))
    links = staged(_verified(stars, percent), "star-links")

    links = links.unionByName(staged(_across(classes, spokes, sets, links, bands, percent), "cross-links"))
    same_id = (
        rows.where("n_shingles > 0 and doc_id is not null")
        .join(classes.select("set_a", "set_b", F.col("doc").alias("class_doc")), ["set_a", "set_b"])
        .select("doc_id", "class_doc")
    )
    return _result(rows, classes, same_id, links)


def _across(classes: DataFrame, spokes: DataFrame, sets: DataFrame, links: DataFrame, bands: list[str], percent: int) -> DataFrame:
    """Links between different components of the star links that share a band."""
    grouped = components(links, "left", "right")
    labelled = (
        classes.join(spokes.select("doc").distinct(), "doc", "left_semi")
        .join(grouped.withColumnRenamed("node", "doc"), "doc", "left")
        .select("doc", "size", F.coalesce("component", "doc").alias("component"), F.array(*bands).alias("bands"))
    )
    labelled = staged(labelled, "labelled")
    member = labelled.select("doc", "size", "component", F.explode("bands").alias("key"))
    mixed = member.groupBy("key").agg(F.min("component").alias("cell"), F.max("component").alias("most")).where("cell < most").select("key", "cell")
    inside = member.join(mixed, "key").select("doc", "size", "component", "cell").distinct()
    inside = staged(inside.withColumn("own", F.col("component") == F.col("cell")), "inside")
    loads = inside.groupBy("cell").agg(F.sum(F.expr("if(own, size, 0)")).alias("a"), F.sum(F.expr("if(own, 0, size)")).alias("b"))
    loads = loads.select("cell", _parts("a").alias("a"), _parts("b").alias("b"))
    placed = inside.join(loads, "cell")
    # members of the cell's component meet all strangers: part i of the one with part j of the other, slot i * b + j
    own = placed.where("own").withColumn("i", _shard("a")).select("doc", "cell", F.expr("explode(transform(sequence(0, b - 1), j -> i * b + j))").alias("slot"), F.lit(0).alias("side"))
    others = placed.where("not own").withColumn("j", _shard("b"))
    facing = others.select("doc", "cell", F.expr("explode(transform(sequence(0, a - 1), i -> i * b + j))").alias("slot"), F.lit(1).alias("side"))
    # strangers of different parts meet too, in slots behind those; those of one part meet in every slot that holds it
    among = others.where("b > 1").select(
        "doc", "cell", F.expr("explode(transform(filter(sequence(0, b - 1), k -> k != j), k -> a * b + least(j, k) * b + greatest(j, k)))").alias("slot"), F.lit(1).alias("side")
    )
    places = own.unionByName(facing).unionByName(among).join(labelled.select("doc", "component", "bands"), "doc")
    return _verified(places.hint("merge").join(sets.select("doc", "shingles"), "doc").select("doc", "shingles", "cell", "slot", "side", "component", "bands"), percent)


def _result(rows: DataFrame, classes: DataFrame, same_id: DataFrame, links: DataFrame) -> DataFrame:
    # an id on rows of several texts joins their classes
    twice = same_id.groupBy("doc_id").agg(F.min("class_doc").alias("left"), F.max("class_doc").alias("most")).where("left < most")
    joined = links.unionByName(same_id.join(twice, "doc_id").select("left", F.col("class_doc").alias("right")))
    grouped = components(joined, "left", "right")
    names = classes.join(grouped.withColumnRenamed("node", "doc"), "doc", "left").select("set_a", "set_b", F.coalesce("component", "doc").alias("class_component"))
    out = rows.select("doc_id", "n_shingles", "set_a", "set_b").join(names, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(component, "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
