import hashlib
import math
import zlib

from tests.llm import awkward
from tidewire.llm import sharding


def draw(key, name, weight):
    return -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / weight


def brute(key, tree):
    level = [s for s in tree if not s.later]
    groups = {}
    for s in level:
        groups.setdefault(s.region, []).append(s)
    tops = {**groups, **{f"later/{s.shard}": [s] for s in tree if s.later}}
    name = min(tops, key=lambda n: draw(key, n, sum(s.weight for s in tops[n])))
    if name not in groups:
        return tops[name][0].shard
    racks = {}
    for s in groups[name]:
        racks.setdefault(f"{name}/{s.rack}", []).append(s)
    rack = min(racks, key=lambda n: draw(key, n, sum(s.weight for s in racks[n])))
    return min(racks[rack], key=lambda s: draw(key, f"{rack}/{s.shard}", s.weight)).shard


def test_awkward_rows(spark):
    tree = sharding.even_tree(24)
    more = sharding.grown(tree, "region1", "rack2")
    rows = sharding.shard_documents(awkward.documents(spark), tree, more).collect()
    assert len(rows) == len(awkward.texts())
    expected = []
    for i, t in awkward.texts():
        raw, key = (t or "").encode(), "" if i is None else str(i)
        expected.append((i, len(raw) + 8, zlib.crc32(raw), "key", brute(key, tree), brute(key, more)))
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in map(_plain, rows)), key=repr) == sorted(expected, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def _plain(row):
    from types import SimpleNamespace

    return SimpleNamespace(**{k: row[k] for k in row.__fields__})


def test_weights_and_movement(spark):
    ids = spark.range(6000).selectExpr("id as doc_id", "cast(id as string) as text")
    tree = [s._replace(weight=3.0) if s.rack == "rack0" else s for s in sharding.even_tree(12, 2, 3)]
    more = sharding.grown(tree, "region0", "rack0", 2.0)
    rows = sharding.shard_documents(ids, tree, more).collect()
    share = sum(r["rack"] == "rack0" for r in rows) / len(rows)
    assert abs(share - 0.6) < 0.03
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {12}
    assert abs(len(moved) / len(rows) - 2 / 22) < 0.02


def test_changed_weight_moves_only_within_its_parent(spark):
    ids = spark.range(3000).selectExpr("id as doc_id", "'' as text")
    tree = sharding.even_tree(24)
    # the same weights of region and rack, so that only the rack's own draws change
    before, after = ([s._replace(weight=2.0) if s.shard == heavy else s for s in tree] for heavy in (5, 4))
    moved = [r for r in sharding.shard_documents(ids, before, after).collect() if r["shard"] != r["grown_shard"]]
    assert moved and all(r["shard"] // 4 == r["grown_shard"] // 4 == 1 for r in moved)
    assert all(r["shard"] == 5 or r["grown_shard"] == 4 for r in moved)


def test_empty(spark):
    assert sharding.shard_documents(awkward.no_documents(spark), sharding.even_tree(24)).collect() == []
