"""Near-duplicate vectors by random-hyperplane signs, exact cosine checks and components.

Equal vectors are reduced to one class with a count. Every class gets, in several tables,
the signs of its products with random hyperplanes; classes with equal signs in a table meet
in one cell and are compared by blocked matrix products in double precision. The number of
hyperplanes follows from the number of classes, so that a cell of unrelated vectors keeps the
same expected size, and the number of tables from the wanted recall at the threshold. Cells
larger than a block are cut into blocks, and every pair of blocks is a task group of bounded
size: nothing is dropped. A pair that meets in several tables is counted in the first of them.
A cell returns one row per vector (its links and the root of its component), never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link; a row without vec_id takes no part and
has a null component; rows that repeat a vec_id each count as a vector; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.connected import components
from tidewire.session import staged

#: Expected number of unrelated vectors in a cell, and the most that one block holds.
CELL = 256
BLOCK = 2048
SEED = 20240607


def plan_tables(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hyperplanes per table and tables, for a pair exactly at the threshold to meet with probability `recall`."""
    bits = min(60, max(1, math.ceil(math.log2(max(classes, 2) / CELL))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _keys(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for row in batch.column(1):
                values = row.values.to_numpy(zero_copy_only=False).astype(kind) if row.is_valid else np.zeros(0, kind)
                good = len(values) and np.isfinite(values).all() and values.any()
                keys.append(values.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], names=["vec_id", "vector"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length as rows in double precision, scaled by powers of two so that no square over- or underflows."""
    rows = np.stack([np.frombuffer(x, dtype=kind) for x in column.to_pylist()]).astype(np.float64)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _signs(kind: str, bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(bits, dtype=np.int64)
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("vector").to_pylist()], dtype=np.int64) // np.dtype(kind).itemsize
            for dim in np.unique(lengths):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), bits * tables))
                rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                side = (_matrix(rows.column("vector"), kind) @ planes[dim] >= 0).reshape(rows.num_rows, tables, bits)
                signs = pa.array(list((side * weights).sum(axis=2)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, signs, pa.array(np.full(rows.num_rows, dim, dtype=np.int32))], names=[*rows.schema.names, "signs", "dim"]
                )

    return run


def _compared(kind: str, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["vector"], kind)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        docs, copies, block = (table[c].to_numpy() for c in ("doc", "copies", "block"))
        signs = np.array(table["signs"].to_pylist(), dtype=np.int64)[:, : table["tab"][0].as_py()]
        cross = table["low"][0].as_py() != table["high"][0].as_py()
        links, root = np.zeros(len(docs), dtype=np.int64), np.arange(len(docs))
        for low in range(0, len(docs), 256):
            part = slice(low, low + 256)
            near = (vectors[part] @ vectors.T) / (norms[part, None] * norms[None, :]) >= threshold
            near &= block[part, None] != block[None, :] if cross else ~np.eye(len(docs), dtype=bool)[part]
            for k in range(len(near)):
                others = np.flatnonzero(near[k])
                others = others[(signs[others] != signs[low + k]).all(axis=1)]  # met in no earlier table
                if len(others):
                    links[low + k] += copies[others].sum()
                    joined = np.unique(np.append(root[others], root[low + k]))
                    if len(joined) > 1:
                        root[np.isin(root, joined)] = joined[0]
        some = np.flatnonzero(links)
        return pa.table({"doc": pa.array(docs[some]), "links": pa.array(links[some]), "root": pa.array(docs[root[some]])})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id (least vec_id reachable), kept, for every row of vectors(vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType
    kind, name = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{name}>").alias("embedding"))
    rows = staged(given.mapInArrow(_keys(kind), "vec_id long, vector binary"), "vectors")
    usable = rows.where("vec_id is not null and vector is not null")
    classes = staged(usable.groupBy("vector").agg(F.min("vec_id").alias("doc"), F.count("*").alias("copies")), "vector-classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)

    signed = classes.mapInArrow(_signs(kind, bits, tables), "vector binary, doc long, copies long, signs array<long>, dim int")
    placed = staged(signed, "signed").select("*", F.posexplode("signs").alias("tab", "sign"))
    cell = ["dim", "tab", "sign"]
    parts = placed.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    spread = placed.join(parts, cell).withColumn("block", F.pmod(F.xxhash64("doc"), "parts").cast("int"))
    met = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = met.select("doc", "copies", "vector", "signs", *cell, "block", "low", "high").groupBy(*cell, "low", "high")
    found = staged(found.applyInArrow(_compared(kind, threshold), "doc long, links long, root long"), "vector-links")

    linked = found.groupBy("doc").agg(F.sum("links").alias("links"))
    grouped = components(found, "doc", "root").withColumnRenamed("node", "doc")
    named = classes.join(linked, "doc", "left").join(grouped, "doc", "left").select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("class_links"),
        F.coalesce("component", "doc").alias("class_component"),
    )
    named_rows = rows.withColumn("named", F.when(F.col("vec_id").isNotNull(), F.col("vector"))).join(named.withColumnRenamed("vector", "named"), "named", "left")
    return named_rows.select(
        "vec_id",
        F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("class_component", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
