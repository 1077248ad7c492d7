import random
import re

from pyspark.sql import functions as F

from tests.llm import awkward
from tidewire.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in sizes:
                run = tuple(w[k : k + n])
                if len(run) == n and run in windows:
                    hit.update(range(k, k + n))
                    found |= windows[run]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.report(docs, items).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, doc_id int")


def test_awkward_rows(spark):
    base = awkward.texts()[0][1].split(" ")
    items = [(1, " ".join(base[5:18])), (2, None), (3, ""), (4, "AB"), (5, " ".join(base[30:42])), (None, " ".join(base[44:56])), (1, "loose  ROW"), (6, " ".join(base[7:20])), (7, ".,")]
    assert got(awkward.documents(spark), table(spark, items)) == brute(awkward.texts(), items)


def test_random_repeats(spark, monkeypatch):
    """Few different words, so that matches overlap, repeat and touch; also in blocks of the benchmark."""
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(k, line(rng.randint(0, 200))) for k in range(30)]
    items = [(k, line(rng.choice([0, 3, 6, 9, 10, 11, 14]))) for k in range(25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute(docs, items)
    assert got(frame, table(spark, items)) == expected
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 60)
    assert got(frame, table(spark, items)) == expected


def test_one_block_at_a_time(spark, monkeypatch):
    """Each pass is finished, and its block let go, before the next block is fetched."""
    docs, items = [(1, "a b c d e f g"), (2, "x y z")], [(k, t) for k, t in enumerate(["a b c", "e f g", "y z", "q"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 6)
    sizes, build = [], decontamination.test_block
    monkeypatch.setattr(decontamination, "test_block", lambda rows, width: sizes.append(len(rows)) or build(rows, width))
    found = decontamination.report(frame, table(spark, items).coalesce(1))
    assert len(sizes) > 1 and sum(sizes) == len(items)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()), key=repr) == brute(docs, items)


def test_longest_match_and_place(spark):
    rng = random.Random(9)
    item = awkward.sentence(rng, 40).split(" ")
    docs = spark.createDataFrame([(1, " ".join(["q", "r", *item[3:25], "s", *item[:12]]))], "doc_id long, text string")
    row = decontamination.report(docs, table(spark, [(7, " ".join(item))])).first()
    assert (row["longest"], row["longest_at"], row["longest_item"]) == (22, 2, "7")
    assert row["spans"] == [2, 24, 25, 37]


def test_decontaminate_keeps_columns(spark):
    docs = awkward.documents(spark)
    items = table(spark, [(1, awkward.texts()[0][1])])
    clean = decontamination.decontaminate(docs, items)
    assert clean.schema == docs.schema
    hit = {i for i, _, n, _ in brute(awkward.texts(), [(1, awkward.texts()[0][1])]) if n}
    assert sorted(map(repr, clean.select("doc_id").collect())) == sorted(map(repr, docs.where(~F.col("doc_id").isin(hit - {None}) & F.col("doc_id").isNotNull()).select("doc_id").union(docs.where("doc_id is null and text = 'loose row'").select("doc_id")).collect()))


def test_empty_tables(spark):
    assert got(awkward.no_documents(spark), table(spark, [(1, "a")])) == []
    assert got(awkward.documents(spark), table(spark, [])) == brute(awkward.texts(), [])
