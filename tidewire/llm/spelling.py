"""Grouping of spelling variants by k-d trees over letter counts.

The vocabulary (distinct words that are long and frequent enough) is counted over all texts. One edit
changes the letter counts of a word by at most two in L1: a replacement takes one letter and adds one,
an insertion or deletion changes one count. So the near words of a word lie in a small box around its
counts, and per pair of lengths (equal, one less, one more) a range search over a k-d tree of counts finds
them; what the boxes leave is verified letter by letter.

Trees have two levels. The upper one, per length, is fitted on a hash sample of at most SAMPLE words and
broadcast; it only deals words out: every word lies in one leaf as a point, and is sent as a search to each
leaf whose box its range meets. Leaves of more than LEAF words are dealt to several tasks by a hash, and
every search goes to all of them, so a task never holds more than about LEAF points, whatever the sample missed. Searches
stream past the points of their leaf, behind a sort within partitions. The lower tree is made in the
task, with the exact bounding box of each node.

Forms follow from near words and counts; roots by pointer doubling, as each step of a chain multiplies the
count, so chains are short. Words must consist of letters up to U+00FF, one byte each in Latin-1.

Null texts have no words, a null id hashes as an empty string. Repeated rows count as often as they are there.
Ties of forms go to the smallest word. Other columns make no difference; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.sampling import thinned
from tidewire.session import staged

#: Words that the upper trees are fitted on, at most (in expectation).
SAMPLE = 100_000
#: Points of a leaf of the upper tree, as planned; a task holds about this many.
LEAF = 16_384
#: Points of a leaf of the lower tree.
POINTS = 48
#: Searches that are answered together.
SEARCHES = 16_384
MIN_LETTERS, MIN_COUNT, MARGIN = 6, 5, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DIMS = 32
_DIM = 26 + np.arange(256) % (DIMS - 26)
_DIM[ord("a") : ord("z") + 1] = np.arange(26)


def vocabulary(docs: DataFrame, drop: int = 199, letters: int = MIN_LETTERS, count: int = MIN_COUNT) -> DataFrame:
    """word and its occurrences n: runs of letters, A-Z lower-cased, of which a hash picks one in `drop` to lose a letter."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"([A-Za-zÀ-ÿ]{{{letters},}})"), F.lit(1))
    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    run, size = F.translate("run", _UPPER, _LOWER), F.length("run")
    hashed = F.crc32(F.concat(F.col("id"), F.lit(":"), run).cast("binary"))
    place = (hashed % size).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2, size))
    words = rows.select(F.when(hashed % drop == 0, shorter).otherwise(run).alias("word"))
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


class Words(NamedTuple):
    """Words of one length: letters (rows of bytes) and letter counts."""

    letters: np.ndarray
    counts: np.ndarray


def of_one_length(words: list[bytes]) -> Words:
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), -1)
    cell = np.arange(len(words))[:, None] * DIMS + _DIM[letters]
    return Words(letters, np.bincount(cell.ravel(), minlength=len(words) * DIMS).reshape(len(words), DIMS).astype(np.int32))


def by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, Words]]:
    """(length, positions, words) for each length there is."""
    size = np.array([len(w) for w in words])
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        yield length, at, of_one_length([words[i] for i in at])


#: By how much a near word's length differs: letters that its counts may have more and fewer, at most.
RANGE = {0: (1, 1), 1: (1, 0), -1: (0, 1)}


def meets(counts: np.ndarray, low: np.ndarray, high: np.ndarray, change: int) -> np.ndarray:
    """Which searches for words that are `change` letters longer can have a near word in the box."""
    more, fewer = RANGE[change]
    return (np.maximum(low - counts, 0).sum(1) <= more) & (np.maximum(counts - high, 0).sum(1) <= fewer)


class Node(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray | None
    children: tuple


def grow(counts: np.ndarray, points: np.ndarray, most: int) -> Node:
    """A tree with exact boxes over the given points: halved along their widest letter; equal points are parted anyhow."""
    inside = counts[points]
    low, high = inside.min(0), inside.max(0)
    if len(points) <= most:
        return Node(low, high, points, ())
    axis = int(np.argmax(high - low))
    values = inside[:, axis]
    middle = int(np.median(values))
    left = values <= (middle if middle < high[axis] else middle - 1)
    if low[axis] == high[axis]:
        left = np.arange(len(points)) < len(points) // 2
    return Node(low, high, None, (grow(counts, points[left], most), grow(counts, points[~left], most)))


def near_pairs(a: np.ndarray, b: np.ndarray, change: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of words that one edit turns into each other; words of b are `change` letters longer."""
    if change == 0:
        return np.nonzero((a[:, None, :] != b[None, :, :]).sum(2) == 1)
    if change < 0:
        j, i = near_pairs(b, a, 1)
        return i, j
    n = a.shape[1]
    ahead = np.logical_and.accumulate(a[:, None, :] == b[None, :, :n], axis=2).sum(2)
    behind = np.logical_and.accumulate((a[:, None, :] == b[None, :, 1:])[:, :, ::-1], axis=2).sum(2)
    return np.nonzero(ahead + behind >= n)


def search(tree: Node, points: Words, wanted: Words, change: int) -> tuple[np.ndarray, np.ndarray]:
    """All (search, point) that are near."""
    found = []
    todo = [(tree, np.arange(len(wanted.letters)))]
    while todo:
        node, at = todo.pop()
        at = at[meets(wanted.counts[at], node.low, node.high, change)]
        if not len(at):
            continue
        if node.points is None:
            todo += [(child, at) for child in node.children]
            continue
        step = max(1, (1 << 21) // (len(node.points) * points.letters.shape[1]))
        for low in range(0, len(at), step):
            i, j = near_pairs(wanted.letters[at[low : low + step]], points.letters[node.points], change)
            found.append((at[low : low + step][i], node.points[j]))
    pair = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
    return pair[0], pair[1]


class Split(NamedTuple):
    """A node of the upper tree: letter counts up to `value` go left. A leaf has axis -1 and its number as value."""

    axis: int
    value: int
    left: int
    right: int


def deal(counts: np.ndarray, leaves: int) -> list[Split]:
    """An upper tree of up to `leaves` leaves, halving the sample along the letter that does so most evenly."""
    out: list[Split] = []

    def part(rows: np.ndarray, wanted: int) -> int:
        at = len(out)
        out.append(Split(-1, sum(s.axis < 0 for s in out), 0, 0))
        if wanted < 2 or len(rows) < 2:
            return at
        best = None
        for axis in range(DIMS):
            values = rows[:, axis]
            for value in np.unique(values)[:-1].tolist():
                skew = abs(int(np.count_nonzero(values <= value)) * 2 - len(rows))
                if best is None or skew < best[0]:
                    best = (skew, axis, value)
        if best is None:
            return at
        _, axis, value = best
        left = rows[:, axis] <= value
        out[at] = Split(axis, value, 0, 0)
        halves = part(rows[left], (wanted + 1) // 2), part(rows[~left], wanted // 2)
        out[at] = Split(axis, value, *halves)
        return at

    part(counts, leaves)
    number = 0
    for i, node in enumerate(out):
        if node.axis < 0:
            out[i] = Split(-1, number, 0, 0)
            number += 1
    return out


def leaf_of(tree: list[Split], counts: np.ndarray) -> np.ndarray:
    """The leaf that each point lies in."""
    out, todo = np.zeros(len(counts), np.int64), [(0, np.arange(len(counts)))]
    while todo:
        k, at = todo.pop()
        node = tree[k]
        if node.axis < 0:
            out[at] = node.value
            continue
        left = counts[at, node.axis] <= node.value
        todo += [(node.left, at[left]), (node.right, at[~left])]
    return out


def leaves_met(tree: list[Split], counts: np.ndarray, change: int) -> tuple[np.ndarray, np.ndarray]:
    """All (search, leaf) where the search's range meets the leaf's box."""
    found, far = [], np.iinfo(np.int32).max
    todo = [(0, np.arange(len(counts)), np.zeros(DIMS, np.int64), np.full(DIMS, far, np.int64))]
    while todo:
        k, at, low, high = todo.pop()
        at = at[meets(counts[at], low, high, change)]
        node = tree[k]
        if not len(at):
            continue
        if node.axis < 0:
            found.append((at, np.full(len(at), node.value)))
            continue
        below, above = high.copy(), low.copy()
        below[node.axis], above[node.axis] = min(high[node.axis], node.value), max(low[node.axis], node.value + 1)
        todo += [(node.left, at, low, below), (node.right, at, above, high)]
    pair = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 2
    return pair[0], pair[1]


_ONE_LEAF = [Split(-1, 0, 0, 0)]


def upper_trees(words: DataFrame, count: int, leaf: int) -> dict[int, list[Split]]:
    """Per length of the sample, a tree with leaves for about `leaf` words each; lengths without one have a single leaf."""
    sample = [r["word"].encode("latin-1") for r in thinned(words.select("word"), "word", SAMPLE, count).collect()]
    share = count / max(1, len(sample))
    trees = {}
    for length, at, found in by_length(sample) if sample else ():
        leaves = int(np.ceil(len(at) * share / leaf))
        if leaves > 1:
            trees[length] = deal(found.counts, leaves)
    return trees


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _placed(trees):
    """length and leaf of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _latin(batch.column(0))
            if not words:
                continue
            length, leaf = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
            for size, at, found in by_length(words):
                length[at], leaf[at] = size, leaf_of(trees.value.get(size, _ONE_LEAF), found.counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(leaf)], names=["word", "n", "length", "leaf"])

    return run


def _dealt(trees, tasks):
    """Each word as a point in its own part of its leaf, and as a search in all parts of the leaves that its range meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tasks.value
        for batch in batches:
            words, n, part = _latin(batch.column("word")), batch.column("n").to_numpy(), batch.column("part").to_numpy()
            if not words:
                continue
            columns: list[list[np.ndarray]] = [[], [], [], [], []]

            def add(length, leaf, part, search, row):
                for column, x in zip(columns, (np.full(len(row), length), leaf, part, np.full(len(row), search), row)):
                    column.append(x)

            for size, at, found in by_length(words):
                leaf = leaf_of(trees.value.get(size, _ONE_LEAF), found.counts)
                add(size, leaf, part[at] % np.array([sizes.get((size, x), 1) for x in leaf.tolist()]), False, at)
                for change in RANGE:
                    i, met = leaves_met(trees.value.get(size + change, _ONE_LEAF), found.counts, change)
                    parts = np.array([sizes.get((size + change, x), 0) for x in met.tolist()], dtype=np.int64)
                    i, met = np.repeat(i, parts), np.repeat(met, parts)
                    number = np.arange(len(i)) - np.repeat(np.cumsum(parts) - parts, parts)
                    add(size + change, met, number, True, at[i])
            length, leaf, number, search, row = (np.concatenate(x) for x in columns)
            keep = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(length, pa.int32()), pa.array(leaf, pa.int64()), pa.array(number, pa.int64()), pa.array(search.astype(bool)), batch.column("word").take(keep), pa.array(n[row])],
                names=["length", "leaf", "part", "search", "word", "n"],
            )

    return run


class _Leaf:
    """The points of one part of one leaf, and the searches that wait for them."""

    def __init__(self, key: tuple, words: list[bytes], n: list[int]):
        self.key, self.words, self.n = key, words, n
        self.points = of_one_length(words)
        self.tree = grow(self.points.counts, np.arange(len(words)), POINTS)
        best = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[best] = np.arange(len(words))
        self.best = np.array(best)

    def answer(self, words: list[bytes]) -> Iterator[tuple[bytes, int, int, bytes]]:
        """word, number of near words here, and count and letters of the best of them, for words that have any."""
        for size, at, found in by_length(words):
            i, j = search(self.tree, self.points, found, self.key[0] - size)
            near = np.bincount(i, minlength=len(at))
            first = np.full(len(at), len(self.words))
            np.minimum.at(first, i, self.rank[j])
            for k in np.flatnonzero(near).tolist():
                top = int(self.best[first[k]])
                yield words[at[k]], int(near[k]), self.n[top], self.words[top]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one leaf follow each other, points first."""
    leaf, points, counts, waiting, at = None, [], [], [], None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal leaf, waiting
        if waiting and points:
            leaf = leaf or _Leaf(at, points, counts)
            found = list(leaf.answer(waiting))
            if found:
                word, near, n, best = zip(*found)
                text = [[w.decode("latin-1") for w in x] for x in (word, best)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text[0], pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()), pa.array(text[1], pa.string())], names=["word", "near", "best_n", "best"]
                )
        waiting = []

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("length", "leaf", "part"))))
        words, n, search = _latin(batch.column("word")), batch.column("n").to_pylist(), batch.column("search").to_pylist()
        for key, word, count, asks in zip(keys, words, n, search):
            if key != at:
                yield from flush()
                leaf, points, counts, at = None, [], [], key
            if asks:
                waiting.append(word)
                if len(waiting) >= SEARCHES:
                    yield from flush()
            else:
                points.append(word)
                counts.append(count)
    yield from flush()


def neighbours(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """For each word of (word, n): its number of near words, and the count and letters of the most frequent (ties: smallest) of them."""
    spark = words.sparkSession
    context = spark.sparkContext
    total = words.count()
    trees = context.broadcast(upper_trees(words, total, leaf))
    rows = words.select("word", "n")
    sizes = rows.mapInArrow(_placed(trees), "word string, n long, length int, leaf long").groupBy("length", "leaf").count().collect()  # one row per leaf
    tasks = context.broadcast({(r["length"], r["leaf"]): -(-r["count"] // (2 * leaf)) for r in sizes})
    hashed = rows.withColumn("part", F.shiftrightunsigned(F.xxhash64("word"), 1))
    dealt = hashed.mapInArrow(_dealt(trees, tasks), "length int, leaf long, part long, search boolean, word string, n long")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(width, "length", "leaf", "part").sortWithinPartitions("length", "leaf", "part", "search")
    found = together.mapInArrow(_searched, "word string, near long, best_n long, best string")
    best = F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))
    every = found.select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("b")).unionByName(
        rows.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<k:bigint,w:string>").alias("b"))
    )
    return every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b")).select(
        "word", "n", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms followed to the last one, by doubling; forms must not run in circles."""
    current = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        following = staged(current.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        current = following.select("word", "root")


def variants(docs: DataFrame, margin: int = MARGIN, leaf: int = LEAF) -> DataFrame:
    """All words with their forms and roots: word, form, root, n, n_near, form_n."""
    words = staged(vocabulary(docs), "words")
    near = staged(neighbours(words, leaf), "near")
    better: Column = F.col("best_n") >= margin * F.col("n")
    formed = near.select("word", "n", "n_near", F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    followed = roots(formed.where(F.col("form").isNotNull()))
    return formed.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
