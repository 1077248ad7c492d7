"""Fill-in-middle examples by secondary sort.

Every text is cut twice, at places that hashes of its id draw, and its parts are put in another
order behind marks. No task assembles a text: pieces of at most PIECE code points are keyed by
document and place in the output, hash-partitioned by document and sorted within partitions (the
DataFrame form of repartitionAndSortWithinPartitions), so that a task reads each output as a stream
and feeds it into a digest that grows piece by piece. The stream also names the part of the text that
a piece belongs to, from the marks it has met; the same partitions are then sorted again by part, and
a second stream restores and digests the text. Pieces are shuffled once; the second sort stays in its
partition and spills like any sort.

A document is a row of the input, known by its number, so rows that repeat an id or a text are
documents of their own and no key holds more than one row. Cuts count code points. A null text is
empty; a null id hashes as an empty string. Empty texts and texts that hold a mark stay plain.
Other columns, whatever their names, make no difference; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a piece at most.
PIECE = 1 << 14


class Marks(NamedTuple):
    """What stands before each part; no mark may hold another one or end as one begins."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Rates(NamedTuple):
    """Of 100 texts, how many are rearranged, and of 100 of these, how many lead with the suffix."""

    rearranged: int = 90
    suffix_first: int = 20


def draw(k: int, seed: int = 1) -> Column:
    """The k-th 32-bit number of a document, from a hash of its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def cut(docs: DataFrame, marks: Marks = Marks(), rates: Rates = Rates()) -> DataFrame:
    """doc_id, text, length n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    marked = reduce(Column.__or__, (F.col("text").contains(m) for m in marks))
    plain = (F.col("n") == 0) | marked | (draw(3) % 100 >= rates.rearranged)
    form = F.when(plain, "plain").when(draw(4) % 100 < rates.suffix_first, "spm").otherwise("psm")
    low, high = (pick(draw(1) % (F.col("n") + 1), draw(2) % (F.col("n") + 1)) for pick in (F.least, F.greatest))
    return (
        docs.select(docs["doc_id"], text.alias("text"))
        .withColumn("n", F.length("text").cast("long"))
        .withColumn("form", form)
        .withColumn("prefix_chars", F.when(F.col("form") != "plain", low))
        .withColumn("middle_chars", F.when(F.col("form") != "plain", high - low))
    )


def _chunks(start: Column, length: Column, size: int) -> Column:
    """The pieces of one part of the text, in order."""
    starts = F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / size).cast("long"))
    return F.when(
        length > 0, F.transform(starts, lambda i: F.substr(F.col("text"), (start + i * size + 1).cast("int"), F.least(F.lit(size), length - i * size).cast("int")))
    ).otherwise(F.array().cast("array<string>"))


def pieces(cuts: DataFrame, marks: Marks = Marks(), size: int = PIECE) -> DataFrame:
    """One row per piece: document `row`, place `at` in its output, `piece`; place 0 has the document's columns instead."""
    p, m, n, zero = F.col("prefix_chars"), F.col("middle_chars"), F.col("n"), F.lit(0).cast("long")
    parts = {"prefix": _chunks(zero, p, size), "middle": _chunks(p, m, size), "suffix": _chunks(p + m, n - p - m, size)}

    def arranged(*names: str) -> Column:
        return F.concat(*(x for name in names for x in (F.array(F.lit(getattr(marks, name))), parts[name])))

    output = (
        F.when(F.col("form") == "plain", _chunks(zero, n, size))
        .when(F.col("form") == "psm", arranged("prefix", "suffix", "middle"))
        .otherwise(arranged("suffix", "prefix", "middle"))
    )
    head = F.col("at") == 0
    return (
        cuts.withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", "n", "form", "prefix_chars", "middle_chars", F.posexplode(F.concat(F.array(F.lit("")), output)).alias("at", "piece"))
        .select("row", "at", "piece", "form", *(F.when(head, F.col(c)).alias(c) for c in ("doc_id", "n", "prefix_chars", "middle_chars")))
    )


def _bytes(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each value, without copies."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [view[a:b] for a, b in zip(bounds, bounds[1:])]


#: Columns of a document that its streams carry along.
_CARRIED = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
_LAST = 3


def _outputs(marks: Marks, schema: pa.Schema, keep_text: bool):
    """Digest the output of each document; name the part of the text of every piece; end a document with its own row."""
    part_of = {marks.prefix.encode(): 0, marks.middle.encode(): 1, marks.suffix.encode(): 2}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, digest, part, kept = None, None, 0, []

        def ended() -> dict:
            whole = {"output": b"".join(kept).decode()} if keep_text else {}
            return doc | whole | {"part": _LAST, "at": 0, "output_sha256": digest.hexdigest()}

        for batch in batches:
            rows, at, form = (batch.column(c).to_pylist() for c in ("row", "at", "form"))
            carried = {c: batch.column(c) for c in _CARRIED}
            parts, done = np.full(len(rows), -1, np.int8), []
            for i, piece in enumerate(_bytes(batch.column("piece"))):
                if at[i] == 0:
                    if doc is not None:
                        done.append(ended())
                    doc, digest, part, kept = {"row": rows[i]} | {c: x[i].as_py() for c, x in carried.items()}, hashlib.sha256(), 0, []
                    continue
                digest.update(piece)
                if keep_text:
                    kept.append(bytes(piece))
                mark = part_of.get(bytes(piece)) if form[i] != "plain" and len(piece) <= 64 else None
                if mark is None:
                    parts[i] = part
                else:
                    part = mark
            stay = np.flatnonzero(parts >= 0)
            if len(stay):
                texts = batch.select(["row", "at", "piece"]).take(pa.array(stay))
                columns = {"row": texts.column(0), "part": pa.array(parts[stay]), "at": texts.column(1), "piece": texts.column(2)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(len(stay), f.type) for f in schema], schema=schema)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if doc is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=schema)

    return run


def _restored(schema: pa.Schema):
    """Digest each document's pieces in the order of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            last = np.flatnonzero(batch.column("part").to_numpy() == _LAST)
            low, ends, pieces = 0, [], batch.column("piece")
            for high in [*last.tolist(), len(batch)]:
                for piece in _bytes(pieces.slice(low, high - low)):
                    digest.update(piece)
                if high < len(batch):
                    ends.append(digest.hexdigest())
                    digest = hashlib.sha256()
                low = high + 1
            out = batch.take(pa.array(last))
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.string()) if f.name == "restored_sha256" else out.column(f.name) for f in schema], schema=schema)

    return run


def rearranged(docs: DataFrame, marks: Marks = Marks(), rates: Rates = Rates(), size: int = PIECE, keep_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n, form, prefix_chars, middle_chars, digests of the output and of the text restored from it.

    With `keep_text`, also the output itself; a task then holds one output at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    placed = pieces(cut(docs, marks, rates), marks, size)
    sorted_pieces = placed.repartition("row").sortWithinPartitions("row", "at")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    columns = {"row": "long", "part": "byte", "at": "int", "piece": "string", **{c: kinds[c] for c in _CARRIED}, "output_sha256": "string"}
    columns |= {"output": "string"} if keep_text else {}
    first = docs.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in columns.items())).schema
    streamed = sorted_pieces.mapInArrow(_outputs(marks, to_arrow_schema(first), keep_text), first)
    wanted = {c: columns[c] for c in [*_CARRIED, "output_sha256"]} | {"restored_sha256": "string"} | ({"output": "string"} if keep_text else {})
    second = docs.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in wanted.items())).schema
    return streamed.sortWithinPartitions("row", "part", "at").mapInArrow(_restored(to_arrow_schema(second)), second)
