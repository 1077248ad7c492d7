"""Benchmark passages in training documents, by suffix arrays over the training side.

Each task takes its documents in shards of a bounded size and sorts the suffixes of their
word sequences by prefix doubling, together with the benchmark's suffixes so that ranks
compare. Every test suffix is then searched by bisection in the sorted training suffixes:
its neighbours there give the longest verbatim match and its place, and the interval of
suffixes that begin with the same window gives all its occurrences. Only runs of words that
the benchmark has, long enough for its shortest window, enter the array: no other suffix can
match. A document never leaves its row, so nothing is shuffled; one row per document comes out.

The benchmark is numbered into blocks of BLOCK_BYTES of text (the row that reaches past the end
included) by running sums in Spark. There is one broadcast and one pass per block, whatever their
number: only one block is fetched and held at a time, each pass but the last is written to the
shared folder, and it adds to what the row has gathered from earlier blocks.

Defined results: a null or empty text, or one without words, has no words and is clean; an item
without words has no window; a null item_id hits documents but is not listed; items that share
an id are one item with the windows of all its rows; an empty benchmark hits nothing; documents
that repeat an id are separate rows; extra columns of either table are kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytescan
from tidewire.llm.batches import packed
from tidewire.session import staged, unstage

WINDOW = 10
#: Benchmark text that one pass searches for: bounds what is broadcast.
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 4 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),  # first and past-the-last word of each hit run, in turn
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),  # words of the longest verbatim match
        T.StructField("longest_at", T.LongType()),  # its first word in the document
        T.StructField("longest_item", T.StringType()),
    ]
)


class Block(NamedTuple):
    """Test side: vocabulary of word hashes, items' word ids with a 0 behind each item, and their windows."""

    vocabulary: np.ndarray
    ids: np.ndarray
    item: np.ndarray  # item of each place in ids
    left: np.ndarray  # words from each place to the end of its item
    windows: dict[int, np.ndarray]  # window length -> places in ids
    names: list[str | None]


def test_block(rows: list[tuple[str | None, str | None]], width: int) -> Block:
    source = bytescan.texts(pa.array([text or "" for _, text in rows], pa.string()))
    words = bytescan.words(source, bytescan.ALNUM)
    vocabulary = np.unique(words.hash)
    counts = np.diff(words.bounds)
    ends = np.cumsum(counts + 1)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    item = np.repeat(np.arange(len(rows)), counts + 1)
    ids[np.arange(len(words.hash)) + words.doc] = np.searchsorted(vocabulary, words.hash) + 1
    left = (ends - 1)[item] - np.arange(len(ids)) if len(ids) else np.zeros(0, np.int64)
    windows: dict[int, list[np.ndarray]] = {}
    for k, n in enumerate(counts):
        start = ends[k] - n - 1
        if n:
            windows.setdefault(int(min(n, width)), []).append(np.arange(start, start + max(1, n - width + 1)))
    names = [None if name is None else str(name) for name, _ in rows]
    return Block(vocabulary, ids, item, left, {w: np.concatenate(x) for w, x in windows.items()}, names)


def doubled_ranks(sequence: np.ndarray, depth: int) -> list[np.ndarray]:
    """Order-preserving ranks of all suffixes by their first 1, 2, 4, ... words, to at least `depth`."""
    ranks, length = [np.unique(sequence, return_inverse=True)[1]], 1
    while length < depth:
        now = ranks[-1]
        behind = np.zeros_like(now)
        behind[:-length] = now[length:] + 1
        ranks.append(np.unique(now * (len(now) + 2) + behind, return_inverse=True)[1])
        length *= 2
    return ranks


def prefix_rank(ranks: list[np.ndarray], width: int) -> np.ndarray:
    """Order-preserving ranks by exactly the first `width` words, from the binary digits of width."""
    out, done = np.zeros(len(ranks[0]), dtype=np.int64), 0
    for k in reversed(range(len(ranks))):
        if width - done >= 1 << k:
            part = np.zeros_like(out)
            part[: len(out) - done] = ranks[k][done:] + 1
            out = np.unique(out * (len(out) + 2) + part, return_inverse=True)[1]
            done += 1 << k
    return out


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that suffixes a and b share, at most `most`, by descending the doubling levels."""
    done = np.zeros(len(a), dtype=np.int64)
    size = len(ranks[0])
    for k in reversed(range(len(ranks))):
        x, y = a + done, b + done
        fits = (x < size) & (y < size)
        same = fits & (ranks[k][np.minimum(x, size - 1)] == ranks[k][np.minimum(y, size - 1)])
        done += same * (1 << k)
    return np.minimum(done, most)


def _candidate_runs(ids: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """Which words lie in a run of at least `shortest` benchmark words of one document."""
    known = ids > 0
    if not known.any():
        return known
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(ids)))
    return np.repeat(known[first] & (length >= shortest), length)


def search(block: Block, words: bytescan.Words, documents: int) -> list[dict]:
    """For each document of the shard: its spans of hit words, its items, its longest match."""
    out: list[dict] = [{"spans": [], "items": [], "longest": 0, "longest_at": None, "longest_item": None} for _ in range(documents)]
    if not block.windows or not len(words.hash):
        return out
    at = np.searchsorted(block.vocabulary, words.hash)
    at[at == len(block.vocabulary)] = 0
    ids = np.where(block.vocabulary[at] == words.hash, at + 1, 0)
    inside = np.flatnonzero(_candidate_runs(ids, words.doc, min(block.windows)))
    if not len(inside):
        return out
    # training side: the runs, a 0 behind each; place[i] is the word in the shard
    gap = np.append((np.diff(inside) != 1) | (np.diff(words.doc[inside]) != 0), True)
    behind = np.cumsum(gap) - gap
    train = np.zeros(len(inside) + int(gap.sum()), dtype=np.int64)
    where = np.arange(len(inside)) + behind
    train[where] = ids[inside]
    place = np.full(len(train), -1, dtype=np.int64)
    place[where] = inside
    tests = len(block.ids)
    ranks = doubled_ranks(np.concatenate([block.ids, train]), int(block.left.max()))
    suffixes = where + tests
    array = suffixes[np.argsort(ranks[-1][suffixes], kind="stable")]  # the suffix array of the training shard

    hit = np.zeros(len(words.hash) + 1, dtype=np.int64)
    pairs = []
    for width, starts in block.windows.items():
        rank = prefix_rank(ranks, width)
        ordered = rank[array]
        distinct, owner = np.unique(rank[starts], return_inverse=True)
        low, high = np.searchsorted(ordered, distinct, "left"), np.searchsorted(ordered, distinct, "right")
        count = high - low
        some = np.flatnonzero(count)
        if not len(some):
            continue
        spot = np.repeat(low[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(int(count[some].sum()))
        first = place[array[spot] - tests]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + width, -1)
        # each window once per document, then with each item that has it
        window_doc = np.unique(np.repeat(some, count[some]) * documents + words.doc[first])
        has_item = np.unique(owner * len(block.names) + block.item[starts])
        window, item = has_item // len(block.names), has_item % len(block.names)
        first_item, past_item = np.searchsorted(window, window_doc // documents, "left"), np.searchsorted(window, window_doc // documents, "right")
        many = past_item - first_item
        which = np.repeat(first_item - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pairs.append(np.unique(np.repeat(window_doc % documents, many) * len(block.names) + item[which]))
    if not pairs:
        return out
    _longest(block, words, ranks, array, place, out)
    covered = np.cumsum(hit[:-1]) > 0
    edge = np.ones(len(covered), dtype=bool)
    edge[1:] = (covered[1:] != covered[:-1]) | (words.doc[1:] != words.doc[:-1])
    first = np.flatnonzero(edge)
    past = np.append(first[1:], len(covered))
    for a, b in zip(first[covered[first]], past[covered[first]]):
        begin = words.bounds[words.doc[a]]
        out[words.doc[a]]["spans"] += [int(a - begin), int(b - begin)]
    for pair in np.unique(np.concatenate(pairs)):
        name = block.names[pair % len(block.names)]
        if name is not None:
            out[pair // len(block.names)]["items"].append(name)
    return out


def _longest(block: Block, words: bytescan.Words, ranks: list[np.ndarray], array: np.ndarray, place: np.ndarray, out: list[dict]) -> None:
    """The longest match of any test suffix with each document: of the suffixes next to it in the array."""
    tests = len(block.ids)
    test = np.flatnonzero(block.left > 0)
    order = np.argsort(ranks[-1][test], kind="stable")
    test = test[order]
    # bisection of each training suffix among test suffixes and of test among training ones meet in the same order
    spot = np.searchsorted(ranks[-1][test], ranks[-1][array])
    doc = words.doc[place[array - tests]]
    best = np.zeros(len(array), dtype=np.int64)
    source = np.zeros(len(array), dtype=np.int64)
    for step in (-1, 0):
        near = test[np.clip(spot + step, 0, len(test) - 1)]
        length = common_prefix(ranks, array, near, block.left[near])
        source = np.where(length > best, near, source)
        best = np.maximum(best, length)
    top = np.lexsort((place[array - tests], -best, doc))
    lead = top[np.append(True, np.diff(doc[top]) != 0)]
    for k in lead:
        d, first = int(doc[k]), int(place[array[k] - tests])
        out[d].update(longest=int(best[k]), longest_at=first - int(words.bounds[d]), longest_item=block.names[block.item[source[k]]])


def merged(old: dict | None, new: dict) -> dict:
    """What two blocks of the benchmark found in one document."""
    if old is None:
        return new
    flat = sorted(zip([*old["spans"][::2], *new["spans"][::2]], [*old["spans"][1::2], *new["spans"][1::2]]))
    spans: list[int] = []
    for a, b in flat:
        if spans and a <= spans[-1]:
            spans[-1] = max(b, spans[-1])
        else:
            spans += [a, b]
    longest = max(old, new, key=lambda x: x["longest"])
    return {**longest, "n_words": new["n_words"], "spans": spans, "items": [*old["items"], *new["items"]]}


def _searcher(shared, kind: pa.DataType, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for low, high, source in bytescan.groups(batch.column("doc").field("text"), SHARD_BYTES):
                words = bytescan.words(source, bytescan.ALNUM)
                found = search(block, words, len(source))
                for row, n in zip(found, np.diff(words.bounds)):
                    row["n_words"] = int(n)
                part = batch.slice(low, high - low)
                if not first:
                    found = [merged(a, b) for a, b in zip(part.column("found").to_pylist(), found)]
                for row in found:
                    row["items"] = sorted(set(row["items"]))
                columns = {n: part.column(n) for n in part.schema.names if n != "found"} | {"found": pa.array(found, kind)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _numbered(benchmark: DataFrame) -> DataFrame:
    """item_id, text and the number of the block that each row begins in, by the bytes of the rows before it."""
    text = F.col("text").cast("string")
    rows = staged(
        benchmark.select(
            F.col("item_id").cast("string").alias("item_id"), text.alias("text"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("nth"),
        ),
        "benchmark",
    )
    # running sums of numbers alone: within each slice, then over the sums of the slices
    before = Window.partitionBy("slice").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = rows.groupBy("slice").agg(F.sum("size").alias("size")).select("slice", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    places = rows.select("slice", "nth", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")).join(F.broadcast(offsets), "slice")
    return rows.join(places.select("nth", F.floor((F.col("offset") + F.col("before")) / BLOCK_BYTES).alias("block")), "nth").select("block", "nth", "item_id", "text")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of docs(doc_id, text, ...) as struct `doc`, and struct `found` (see FOUND)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = to_arrow_type(FOUND)
    out = packed(docs)
    schema = T.StructType([*out.schema.fields, T.StructField("found", FOUND)])
    numbered = staged(_numbered(benchmark), "blocks")
    blocks = sorted(r["block"] for r in numbered.select("block").distinct().collect()) or [None]
    past = None
    for k, block in enumerate(blocks):
        rows = [] if block is None else numbered.where(F.col("block") == block).orderBy("nth").collect()
        shared = spark.sparkContext.broadcast(test_block([(r["item_id"], r["text"]) for r in rows], window))
        out = out.mapInArrow(_searcher(shared, kind, k == 0), schema)
        if k + 1 < len(blocks):  # the pass is finished before the next block is fetched
            out = staged(out, "pass")
            shared.destroy()
            if past is not None:
                unstage(past)
            past = out
    return out


def hit_words(found: str = "found") -> F.Column:
    """How many words of a document lie in its spans."""
    return F.expr(f"aggregate({found}.spans, struct(0L as n, -1L as sign), (s, x) -> struct(s.n + s.sign * x as n, -s.sign as sign), s -> s.n)")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, words, hit words, items with occurring windows, hit runs, longest match and its place."""
    narrow = docs.select("doc_id", "text")
    return matches(narrow, benchmark, window).select(
        F.col("doc.doc_id").alias("doc_id"), "found.n_words", hit_words().alias("n_hit"), "found.items", "found.spans", "found.longest", "found.longest_at", "found.longest_item"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with their columns."""
    return matches(docs, benchmark, window).where(F.size("found.spans") == 0).select("doc.*")
