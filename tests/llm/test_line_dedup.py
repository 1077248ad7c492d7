import random

import pytest
from pyspark.sql import functions as F

from tests.llm import awkward
from tidewire.llm import line_dedup


def count(line):
    inner = line.strip(" ")
    return inner.count(" ") + 1 if inner else 0


def brute(rows, min_words):
    """Texts without every line that lies in a run of enough words which occurs earlier as well; rows: (order, text)."""
    first, out = {}, []
    for order, (key, text) in enumerate(sorted(set(rows))):
        lines = text.split("\n")
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(map(count, run)) >= min_words and first.setdefault(run, (order, a)) < (order, a):
                    gone.update(range(a, b))
        out.append((key, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_random_lines(spark, min_words):
    rng = random.Random(min_words)
    kinds = ["", "a", "b", "a b", "c d e", "f g h i j", "k l m n o p q"]
    rows = []
    for k in range(40):
        start = rng.choice(rows)[1].split("\n")[: rng.randint(0, 6)] if rows and rng.random() < 0.5 else []
        rows.append((k, "\n".join([*start, *[rng.choice(kinds) for _ in range(rng.randint(1, 9))]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cleaned = line_dedup.remove_repeated_lines(frame, min_words).select("doc.doc_id", "text", "n_removed").collect()
    assert sorted(tuple(r) for r in cleaned) == brute(rows, min_words)


def test_long_run_of_short_lines(spark):
    """The run only has enough words as a whole, over many doublings."""
    run = "\n".join(["x", ""] * 40)
    rows = [(1, "q\n" + run), (2, "r\nr2\n" + run + "\ns"), (3, "\n".join(["x", ""] * 10))]
    cleaned = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 30).select("doc.doc_id", "text", "n_removed")
    assert sorted(tuple(r) for r in cleaned.collect()) == brute(rows, 30)


def test_hot_run_is_split(spark):
    """Half of all windows belong to one run: its rows are dealt to several tasks, and the result is the plain one."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    hot = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id"))
    keyed = spark.range(0, 40000, 1, 8).select("id", F.xxhash64("id").alias("h"), F.lit(0).alias("line"), F.lit(1).alias("size"), hot.alias("head"), hot.alias("tail"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        keyed = line_dedup.staged(keyed, "keyed")
        firsts = keyed.groupBy("size", "head", "tail").agg(F.min(F.struct("id", "h", "line")).alias("first"))
        later = line_dedup._later(keyed, line_dedup.staged(firsts, "firsts"))
        assert sorted(r["id"] for r in later.collect()) == list(range(2, 40000, 2))
        assert "skew=true" in later._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_repeated_rows_of_short_lines(spark):
    """Rows that repeat id and text are one document: its runs of several short lines are found as in a single row."""
    run = "a b\nc d\ne f\ng h\ni j"
    texts = [(1, "p\n" + run + "\nq"), (2, "r\n" + run), (3, run + "\ns\n" + run), (4, "t u\nv w\nx y")]
    rows = [*texts, *[texts[k] for k in (1, 1, 1, 2, 0, 3)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cleaned = line_dedup.remove_repeated_lines(frame).select("doc.doc_id", "text", "n_removed").collect()
    expected = {(a[0], a[1]): b for a, b in zip(sorted(set(rows)), brute(rows, 5))}
    assert sorted(tuple(r) for r in cleaned) == sorted(expected[r] for r in rows)


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    rows = line_dedup.remove_repeated_lines(docs).collect()
    assert len(rows) == len(awkward.texts())
    assert rows[0]["doc"].asDict().keys() == set(docs.columns)
    by = {}
    for r in rows:
        by.setdefault(r["doc"]["doc_id"], []).append(r["text"])
    base, given = awkward.texts()[0][1], dict(awkward.texts())
    assert sorted(by[None]) == ["loose row", base]  # a null id comes first and keeps its lines
    assert by[1] == ["", ""] and by[3] == [""] and by[5] == [None] and by[6] == [""]
    assert by[13] == [given[13]] and by[14] == ["zz"]
    assert by[15] == ["same words in this line"]
    assert by[11] == [given[11]] and by[12] == [given[12]]
    again = {repr((r["doc"]["doc_id"], r["text"])) for r in line_dedup.remove_repeated_lines(docs.repartition(7)).collect()}
    assert again == {repr((r["doc"]["doc_id"], r["text"])) for r in rows}


def test_empty(spark):
    assert line_dedup.remove_repeated_lines(awkward.no_documents(spark)).collect() == []
