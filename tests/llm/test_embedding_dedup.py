import math

import numpy as np
import pytest

from tidewire.llm import embedding_dedup


def brute(rows):
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for a in good:
        for b in good:
            x, y = (np.float64(rows[k][1]) / max(map(abs, rows[k][1])) for k in (a, b))
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a].append(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, stack = {k}, [k]
        while stack:
            for b in links[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        c = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((i, len(links[k]), c, i is None or i == c))
    return sorted(out, key=repr)


def check(spark, rows, kind="float"):
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, doc string, sign int")
    assert sorted((tuple(r) for r in embedding_dedup.near_vectors(frame).collect()), key=repr) == brute(rows)


def test_awkward_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, [-1.0, -2.0, -3.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0])]
    rows += [(9, [1.0, float("nan"), 3.0]), (10, [float("inf"), 2.0, 3.0]), (11, [1.0, 2.0]), (None, v), (12, [1e-30, 2e-30, 3e-30]), (13, [1.0, 2.0, 3.4])]
    check(spark, rows)
    check(spark, [(i, None if x is None else [None if y is None else y * 1e200 for y in x]) for i, x in rows], "double")


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_vectors(frame).collect() == []


@pytest.mark.parametrize("block", [2048, 16])
def test_groups(spark, monkeypatch, block):
    """Copies, near copies and chains, with cells cut into blocks as well."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(8):
        v = rng.standard_normal(24)
        for _ in range(20):
            v = v + rng.standard_normal(24) * rng.choice([0, 0.05, 0.25])
            rows.append((len(rows), [float(np.float32(x)) for x in v]))
    check(spark, rows)


def test_tables_reach_the_recall():
    bits, tables = embedding_dedup.plan_tables(1_000_000, 0.95, 0.999)
    assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.999
