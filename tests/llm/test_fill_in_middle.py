import hashlib
import random

import pytest

from tests.llm import awkward
from tidewire.llm import fill_in_middle


def numbers(doc_id):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def brute(doc_id, text):
    text = text or ""
    n, (h1, h2, h3, h4) = len(text), numbers(doc_id)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc_id, n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}", text


def digested(row):
    return (*row[:5], *(hashlib.sha256(x.encode()).hexdigest() for x in row[5:]))


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()), key=repr)


@pytest.mark.parametrize("size", [7, fill_in_middle.PIECE])
def test_awkward_rows(spark, size):
    got = plain(fill_in_middle.rearranged(awkward.documents(spark), size=size))
    assert got == sorted((digested(brute(*row)) for row in awkward.texts()), key=repr)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_marks_code_points_and_batches(spark, batch):
    """Pieces shorter than marks, texts with marks and parts of marks, letters of up to four bytes, small batches."""
    rng = random.Random(11)
    letters = ["a", "é", "日", "😀", "<", "P", "S", ">", "<P", "S>", "é", "\n", "<M>"]
    rows = [(i, "".join(rng.choice(letters[: 13 if i % 5 == 0 else 12]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = fill_in_middle.rearranged(spark.createDataFrame(rows, "doc_id long, text string"), size=2, keep_text=True)
        expected = [brute(*row) for row in rows]
        assert plain(out) == sorted(map(digested, expected), key=repr)
        assert sorted(tuple(r) for r in out.select("doc_id", "output").collect()) == sorted((r[0], r[5]) for r in expected)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r[2] for r in expected} == {"plain", "psm", "spm"}


def test_other_marks_and_rates(spark):
    marks = fill_in_middle.Marks("[a]", "[b]", "[c]")
    docs = spark.createDataFrame([(i, "<P> one two three") for i in range(60)], "doc_id string, text string")
    rows = fill_in_middle.rearranged(docs, marks, fill_in_middle.Rates(100, 100), keep_text=True).collect()
    assert len(rows) == 60 and {r["form"] for r in rows} == {"spm"} and all(r["output"].startswith("[b]") for r in rows)
    assert {r["restored_sha256"] for r in rows} == {hashlib.sha256(b"<P> one two three").hexdigest()}


def test_one_exchange_and_streaming_sort(spark):
    plan = fill_in_middle.rearranged(awkward.documents(spark))._jdf.queryExecution().executedPlan().toString()
    below = plan.split("RoundRobinPartitioning")[0]  # the test table's own exchange
    assert below.count("Exchange hashpartitioning(row") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert fill_in_middle.rearranged(awkward.no_documents(spark)).collect() == []
