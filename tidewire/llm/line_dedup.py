"""Repeated line runs across documents, by a suffix array over sequences of line ids.

Every line is an id; a document is a sequence of ids and each of its lines starts a suffix. Prefix
doubling ranks suffixes by their first 1, 2, 4, ... lines: the pair of ranks (i, i + length) is
ranked again, as a distributed sort of the distinct pairs in buckets of a fixed number, the order of
lines being that of their hashes. Suffixes of equal rank at a length are an interval of the suffix
array with a common prefix of at least that length; intervals of one suffix cannot repeat and leave.

A run of lines of at least `min_words` words that occurs earlier too, by id of the document and
then by line, is a later copy. It is covered by its shortest windows of that many words that start
or end at one of its lines, so the windows' intervals (found from two overlapping ranks) give the
union of all maximal repeated runs exactly; those lines are deleted. The first copy of every run
stays. Doubling stops at the longest window: longer intervals add no line.

Words of a line are its parts between blanks. Defined results: a null text has no lines and
stays; an empty text is one empty line; documents whose id and text are equal are one document and
keep the same lines; of one id with several texts, the order of their hashes decides; a null id comes
first; lines are compared whole and exactly; all columns of the input are kept, `text` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.batches import packed
from tidewire.session import staged

MIN_WORDS = 5
_BUCKETS = 4096
_AT = ["id", "h", "line"]


def _named(docs: DataFrame) -> DataFrame:
    return packed(docs).select(
        F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("doc.text").alias("h"), "doc"
    )


def _lines(docs: DataFrame) -> DataFrame:
    lines = _named(docs).select("id", "h", F.posexplode(F.split("doc.text", "\n", -1)).alias("line", "value"))
    inner = F.trim("value")
    words = F.when(F.length(inner) == 0, 0).otherwise(F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1)
    lines = lines.select(*_AT, F.xxhash64("value").alias("a"), F.xxhash64(F.lit(29), "value").alias("b"), words.cast("int").alias("words"))
    return lines.distinct()  # rows that repeat an id and a text are one document; numbers alone are moved, not texts


def _ranked(pairs: DataFrame, bucket: F.Column) -> DataFrame:
    """Ranks of the pairs (a, b) that occur more than once, in their order: columns a, b, rank."""
    repeated = staged(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b", bucket.alias("bucket")), "pairs")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most _BUCKETS rows
    offsets = repeated.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket").orderBy("a", "b")
    numbered = repeated.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(offsets), "bucket")
    return numbered.select("a", "b", (F.col("offset") + F.col("nth") - 1).alias("rank"))


def _doubled(suffixes: DataFrame, length: int) -> DataFrame:
    """From ranks by `length` lines those by twice as many, of the suffixes that can still repeat."""
    ahead = Window.partitionBy("id", "h").orderBy("line").rangeBetween(length, length)
    pairs = suffixes.withColumn("b", F.max("rank").over(ahead)).where("b is not null").withColumnRenamed("rank", "a")
    pairs = staged(pairs, "rank-pairs")
    most = max(1, (pairs.agg(F.max("a")).first()[0] or 0) + 1)
    ranks = _ranked(pairs, F.floor(F.col("a") * (_BUCKETS / most)).cast("int"))
    return staged(pairs.join(ranks, ["a", "b"]).select(*_AT, "rank"), "suffixes")


def _windows(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of repeated lines with enough words that start or end at each line: id, h, line, size."""
    doc = Window.partitionBy("id", "h").orderBy("line")
    islands = suffixes.withColumn("island", F.col("line") - F.row_number().over(doc))
    whole = Window.partitionBy("id", "h", "island")
    upto = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    counted = islands.withColumn("after", F.sum("words").over(upto)).withColumn("before", F.col("after") - F.col("words"))
    counted = counted.withColumn("total", F.sum("words").over(whole)).withColumn("low", F.min("line").over(whole)).withColumn("high", F.max("line").over(whole))
    following = whole.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing)
    preceding = whole.orderBy("after").rangeBetween(Window.unboundedPreceding, -min_words)
    ends = F.coalesce(F.min("line").over(following), F.when(F.col("total") - F.col("before") >= min_words, F.col("high") + 1))
    starts = F.coalesce(F.max("line").over(preceding) + 1, F.when(F.col("after") >= min_words, F.col("low")))
    both = counted.select("id", "h", "line", ends.alias("end"), starts.alias("start"))
    runs = F.array(F.struct(F.col("line").alias("first"), F.col("end").alias("past")), F.struct(F.col("start").alias("first"), (F.col("line") + 1).alias("past")))
    listed = both.select("id", "h", F.explode(F.array_distinct(runs)).alias("run")).where("run.first is not null and run.past is not null")
    return listed.select("id", "h", F.col("run.first").alias("line"), (F.col("run.past") - F.col("run.first")).cast("int").alias("size")).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete, per document: id (null ids as the least number), h (hash of the text), line, size."""
    lines = staged(_lines(docs), "lines")
    # buckets of the first sort: leading bits of the line's hash
    ranks = _ranked(lines, F.shiftright("a", 64 - 12).cast("int"))
    suffixes = staged(lines.join(ranks, ["a", "b"]).select(*_AT, "words", "rank"), "suffixes")
    windows = staged(_windows(suffixes, min_words), "windows")
    longest = windows.agg(F.max("size")).first()[0] or 0

    level, length, keyed = suffixes.select(*_AT, "rank"), 1, None
    while length <= longest:
        here = windows.where((F.col("size") >= length) & (F.col("size") < 2 * length))
        tail = level.select("id", "h", F.col("line").alias("last"), F.col("rank").alias("tail"))
        found = here.withColumn("last", F.col("line") + F.col("size") - length).join(level, _AT).join(tail, ["id", "h", "last"])
        found = found.select(*_AT, "size", F.col("rank").alias("head"), "tail")
        keyed = found if keyed is None else keyed.unionByName(found)
        if 2 * length <= longest:
            level = _doubled(level, length)
        length *= 2
    if keyed is None:
        return windows
    keyed = staged(keyed, "intervals")
    place = F.struct(*_AT)
    firsts = keyed.groupBy("size", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("size", "head", "tail", "first")
    return _later(keyed, staged(firsts, "first-places")).select("id", "h", "line", "size")


def _later(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """Windows behind the first of their interval.

    `firsts` must be a written table: behind an aggregate on the same key, adaptive execution
    does not split the windows of a run that very many documents hold.
    """
    return keyed.join(firsts, ["size", "head", "tail"]).where(F.struct(*_AT) > F.col("first"))


def _deleter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, gone, words = batch.column("doc").field("text").to_pylist(), [], [], []
        for k, runs in enumerate(batch.column("runs").to_pylist()):
            lost: set[int] = set()
            if runs:
                lost.update(x for run in runs for x in range(run["line"], run["line"] + run["size"]))
                lines = texts[k].split("\n")
                words.append(sum(len([w for w in lines[x].split(" ") if w]) for x in lost))
                texts[k] = "\n".join([x for i, x in enumerate(lines) if i not in lost])
                kept.append(len(lines) - len(lost))
            else:
                words.append(0)
                kept.append(0 if texts[k] is None else texts[k].count("\n") + 1)
            gone.append(len(lost))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(gone, pa.int64()), pa.array(words, pa.int64())],
            names=["doc", "text", "n_kept", "n_removed", "words_removed"],
        )


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs as struct `doc`, the remaining `text`, and numbers of lines kept and removed and of words removed."""
    runs = later_copies(docs, min_words).groupBy("id", "h").agg(F.collect_list(F.struct("line", "size")).alias("runs"))
    joined = _named(docs).join(runs.hint("merge"), ["id", "h"], "left").select("doc", "runs")
    kinds = [T.StructField("text", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_kept", "n_removed", "words_removed")]]
    return joined.mapInArrow(_deleter, T.StructType([joined.schema["doc"], *kinds]))
