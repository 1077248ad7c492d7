"""The queries of the subpackage that SQL can express, the digests' shapes, and the pipeline against its parts."""

from pathlib import Path

import pytest

import corpus_pipeline
from tests.compare import compare, duck
from tests.llm.test_bpe import PATH
from tests.llm.test_decontamination import brute as hit_words
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_minhash_dedup import brute as groups
from tidewire.llm import bpe, queries, quality

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF_DIR), duck(SF_DIR), queries.oracle_sql()[name]) is None


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline_equals_brute_force(spark):
    """Each stage on the rows that brute force leaves of the one before; the fitted scores are the operator's own."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scores = quality.score(docs, queries.quality_labels(spark, SF_DIR)).select("doc.doc_id", "doc.text", "score").collect()
    rows = [(r["doc_id"], r["text"]) for r in scores if r["score"] >= 0.3]
    assert 0 < len(rows) < len(scores)
    rows = [(i, t) for i, t, gone in _lines(rows) if not gone or t.strip()]
    component, _ = groups(rows, 5)
    rows = [row for row, c in zip(rows, component) if row[0] == c]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _, n, _ in hit_words(rows, items) if n}
    rows = [row for row in rows if row[0] not in hit]
    expected = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def _lines(rows):
    """The brute force of line runs, which is cubic in lines, on short windows only."""
    return without_lines(rows, 5) if max(t.count("\n") for _, t in rows) < 40 else _windows(rows)


def _windows(rows):
    from tests.llm.test_line_dedup import count

    first, out = {}, []
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        words = [count(x) for x in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, min(len(lines), a + 12)):
                total += words[b]
                if total >= 5 and first.setdefault(tuple(lines[a : b + 1]), (key, a)) < (key, a):
                    gone.update(range(a, b + 1))
        out.append((key, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out
