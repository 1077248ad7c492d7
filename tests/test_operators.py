"""Windows, order, keep-first, splits, scaling: hand-worked rows and brute force."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.operators import dedup, ordering, scaling, sketches, split, summaries
from tidewire.operators.windows import SeriesOrder, row_sequences
from tidewire.plans import market_panel as market
from tidewire.plans import tail_models
from tidewire.sources import tables


def day(i):
    return (datetime.date(2020, 1, 1) + datetime.timedelta(days=i)).isoformat()


def prices(spark, values, series="s"):
    rows = [(series, day(i), v) for i, v in enumerate(values)]
    return market.load_prices(
        spark.createDataFrame(rows, "k string, d string, p double"), "d", "p", "2019-01-01", "2030-01-01", "k"
    )


def test_price_gap(spark):
    panel = market.market_panel(prices(spark, [20.00, 18.27, -36.98, 8.91, 13.64]), "2030-01-01").orderBy("date")
    rows = panel.collect()
    returns = [r["log_return"] for r in rows]
    assert returns[1] == pytest.approx(-0.090472, abs=1e-6) and returns[4] == pytest.approx(0.425832, abs=1e-6)
    assert returns[0] is returns[2] is returns[3] is None
    assert [rows[i]["target_tail_t_plus_1"] for i in (1, 2, 4)] == [0, 0, 0]
    assert [r["price_valid_for_log"] for r in rows] == [True, True, False, True, True]
    assert not any(r["usable_for_model"] for r in rows)


def test_rows_without_price_are_dropped_first(spark):
    rows = prices(spark, [1.0, None, float("nan"), 2.0]).orderBy("date").collect()
    assert [r["wti_price"] for r in rows] == [1.0, 2.0]


def test_rolling(spark):
    returns = [0.01, 0.02, 0.03, 0.04, 0.05, 0.5]
    rows = spark.createDataFrame([("s", i, r) for i, r in enumerate(returns)], "k string, t int, r double")
    s = SeriesOrder(("k",), ("t",))
    out = rows.select("t", s.rolling_std(F.col("r"), 5, False).alias("sd"), s.rolling_mean(F.col("r"), 5, False).alias("m"))
    out = out.orderBy("t").collect()
    assert out[5]["sd"] == pytest.approx(0.0158114, abs=1e-7) and out[5]["m"] == pytest.approx(0.03)
    assert all(r["sd"] is None for r in out[:5])
    gap = rows.withColumn("r", F.when(F.col("t") != 2, F.col("r")))
    last = gap.select("t", s.rolling_mean(F.col("r"), 5, False).alias("m")).orderBy("t").collect()[5]
    assert last["m"] is None


def test_panel_matches_pandas(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.uniform(1, 100), rng.uniform(1, 100), -5.0]) for _ in range(200)]
    panel = market.market_panel(prices(spark, values), "2020-05-01").orderBy("date").toPandas()
    p = pd.Series(values)
    r = np.log(p.where(p > 0)).diff()
    for k in (5, 10, 22):
        np.testing.assert_allclose(panel[f"rv_{k}"].astype(float), r.rolling(k).std().shift(1), rtol=1e-9)
    np.testing.assert_allclose(panel["ret_mean_10"].astype(float), r.rolling(10).mean().shift(1), rtol=1e-9)
    train = pd.to_datetime(panel["date"]) <= "2020-05-01"
    threshold = r.shift(-1)[train].dropna().quantile(0.1)
    assert panel["tail_threshold_train"].iloc[0] == pytest.approx(threshold)
    assert (panel["target_tail_t_plus_1"] == (r.shift(-1) < threshold).astype(int)).all()


@pytest.mark.parametrize("chunk_rows", [30, 64, 100000])
def test_chunks_equal_whole_windows(spark, chunk_rows):
    rng = random.Random(2)
    values = [rng.choice([rng.uniform(1, 9), -1.0, rng.uniform(1, 9), rng.uniform(1, 9)]) for _ in range(700)]
    data = prices(spark, values).unionByName(prices(spark, values[:40], "short"))
    whole = market.return_features(data).orderBy("series_id", "date").toPandas()
    chunks = market.Chunks(chunk_rows)
    cut = market.return_features(data, chunks=chunks).select(*whole.columns).orderBy("series_id", "date").toPandas()
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)


def test_chunked_panel_has_the_same_threshold(spark):
    rng = random.Random(3)
    data = prices(spark, [rng.uniform(1, 9) for _ in range(300)])
    whole = market.market_panel(data, "2020-08-01").orderBy("date").toPandas()
    chunks = market.Chunks(50)
    cut = market.market_panel(data, "2020-08-01", chunks=chunks).orderBy("date").toPandas()
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-9)


def test_sequences(spark):
    rows = spark.createDataFrame([("s", i, float(i)) for i in range(1, 7)], "k string, t int, x double")
    out = row_sequences(rows, SeriesOrder(("k",), ("t",)), ["x"], 3).orderBy("t").collect()
    assert [r["t"] for r in out] == [4, 5, 6]
    assert out[0]["sequence"] == [[1.0], [2.0], [3.0]]


def test_chunked_sequences(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"k": ["long"] * 5000 + ["short"] * 7 + ["one"], "t": [*range(5000), *range(7), 0], "x": rng.normal(size=5008)})
    rows, order = spark.createDataFrame(frame), SeriesOrder(("k",), ("t",))
    for current in (False, True):
        whole = row_sequences(rows, order, ["x", "t"], 6, current).orderBy("k", "t").toPandas()
        cut = row_sequences(rows, order, ["x", "t"], 6, current, chunk_rows=64).orderBy("k", "t").toPandas()
        pd.testing.assert_frame_equal(whole, cut[whole.columns])
    with pytest.raises(ValueError):
        row_sequences(rows, order, ["x"], 65, chunk_rows=64)


def test_last_share_is_the_rank_of_the_row(spark):
    frame = pd.DataFrame({"series_id": ["a"] * 101 + ["b"] * 6 + ["c"], "date": [*range(101), *range(6), 0]})
    rows = spark.createDataFrame(frame)
    place = F.percent_rank().over(Window.partitionBy("series_id").orderBy("date"))
    wanted = rows.withColumn("last", place > 0.8).orderBy("series_id", "date").toPandas()
    found = tail_models.last_share(rows, SeriesOrder(("series_id",), ("date",)), 0.2, "last").orderBy("series_id", "date").toPandas()
    pd.testing.assert_frame_equal(wanted, found[wanted.columns])
    assert found["last"].sum() == 21


def test_quantiles(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "x double")
    found = ordering.exact_quantiles(rows, "x", {"a": 0.1, "b": 0.5, "c": 1.0, "d": 0.0}).first()
    assert tuple(found) == pytest.approx((1.3, 3.0, 9.0, 1.0))
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=2000), np.zeros(1000)])
    keys = ["a" if i % 3 else None for i in range(3000)]
    frame = pd.DataFrame({"k": keys, "x": values})
    found = ordering.exact_quantiles(spark.createDataFrame(frame), "x", {"p": 0.1, "q": 0.77}, ["k"]).collect()
    assert len(found) == 2
    for row in found:
        part = frame[frame.k.isna() if row["k"] is None else frame.k == row["k"]].x
        assert (row["p"], row["q"]) == pytest.approx((part.quantile(0.1), part.quantile(0.77)))


def brute_auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, result = sum(y), 0.0
    for score in set(s):
        tp = sum(a for a, b in zip(y, s) if b >= score)
        here = sum(a for a, b in zip(y, s) if b == score)
        result += here / total * tp / sum(b >= score for b in s)
    return result


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double")
    found = ordering.ranking_metrics(rows, "y", "s").first()
    assert (found["roc_auc"], found["average_precision"]) == pytest.approx((0.875, 0.833333), abs=1e-6)
    flipped = ordering.ranking_metrics(rows.withColumn("s", -F.col("s")), "y", "s").first()
    assert flipped["roc_auc"] == pytest.approx(1 - 0.875)


def test_ranking_metrics_with_hot_score_and_null_group(spark):
    rng = random.Random(4)
    data = []
    for i in range(900):
        group = rng.choice(["a", "b", None])
        score = 0.5 if i % 3 == 0 else round(rng.random(), 2)
        data.append((group, rng.randint(0, 1), score))
    data += [("only positives", 1, 0.3)]
    rows = spark.createDataFrame(data, "g string, y int, s double")
    found = {r["g"]: r for r in ordering.ranking_metrics(rows, "y", "s", ["g"]).collect()}
    for g in ("a", "b", None):
        y, s = zip(*[(y, s) for h, y, s in data if h == g])
        assert found[g]["roc_auc"] == pytest.approx(brute_auc(y, s))
        assert found[g]["average_precision"] == pytest.approx(brute_ap(y, s))
    assert found["only positives"]["roc_auc"] is None


def test_keep_first(spark):
    rows = spark.createDataFrame([(1, "u", "t1"), (2, "u", "t2"), (3, "v", "t1"), (4, None, "t3"), (5, None, "t4")], "id int, url string, t string")
    by_url = dedup.keep_first(rows, "id", [{"url": F.col("url")}])
    assert sorted(r.id for r in by_url.collect()) == [1, 3, 4]
    both = dedup.keep_first(rows, "id", [{"url": F.col("url")}, {"t": F.col("t")}])
    assert sorted(r.id for r in both.collect()) == [1, 4]
    again = dedup.keep_first(both, "id", [{"url": F.col("url")}, {"t": F.col("t")}])
    assert sorted(r.id for r in again.collect()) == [1, 4]
    late = dedup.first_ids(rows, "id", [{"url": F.col("url")}], F.col("id") > 1)
    assert sorted(r.id for r in late.collect()) == [2, 3, 4]


def test_keep_first_with_a_hot_key(spark):
    rows = spark.range(30000).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500))
    kept = dedup.first_ids(rows, "id", [{"k": F.col("k")}])
    expected = {}
    for i in range(30000):
        expected.setdefault(-1 if i % 3 == 0 else i % 500, i)
    assert sorted(r.id for r in kept.collect()) == sorted(expected.values())
    plan = kept._jdf.queryExecution().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_stratified_split(spark):
    rows = spark.range(1000).withColumn("y", F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    marked = split.stratified_split(rows, "id", "y", 0.2, seed=42).collect()
    counts = {y: sum(r["is_test"] for r in marked if r["y"] == y) for y in (0, 1)}
    assert counts == {0: 180, 1: 20} and len(marked) == 1000
    again = split.stratified_split(rows.repartition(7), "id", "y", 0.2, seed=42).collect()
    assert {r["id"] for r in marked if r["is_test"]} == {r["id"] for r in again if r["is_test"]}
    other = split.stratified_split(rows, "id", "y", 0.2, seed=1).collect()
    assert {r["id"] for r in marked if r["is_test"]} != {r["id"] for r in other if r["is_test"]}


def test_date_split_has_no_overlap(spark):
    rows = spark.range(100).select(F.expr("date_add(date'2020-01-01', cast(id as int))").alias("date"))
    train, test = split.split_by_date(rows, "date", "2020-02-01", "2020-03-01")
    assert train.count() == 31 and test.count() == 30
    assert train.intersect(test).count() == 0


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    both = train.unionByName(spark.createDataFrame([(5.0, 6.0)], "x double, c double"))
    rows = scaling.standardize(both, train, ["x", "c"]).collect()
    assert sorted(r["x"] for r in rows) == [-1.0, 1.0, 3.0]
    assert sorted(r["c"] for r in rows) == [0.0, 0.0, 1.0]


def test_median_fill(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    assert sorted(r["x"] for r in scaling.fill_median(rows, ["x"]).collect()) == [1.0, 3.0, 3.0, 10.0]
    assert rows.agg(summaries.rate(F.col("x").isNotNull())).first()[0] == 0.75


def test_class_weights(spark):
    rows = spark.createDataFrame([(0,)] * 8 + [(1,)] * 2, "y int")
    row = scaling.class_weights(rows, "y").first()
    assert (row["weight0"], row["weight1"], row["positive_weight"]) == (0.625, 2.5, 4.0)
    assert scaling.class_weights(rows.filter("y = 0"), "y").first()["positive_weight"] == 8.0
    weighted = scaling.with_class_weight(rows, "y")
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(10.0)


def test_agreement_and_reports(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "a int, b int")
    found = summaries.agreement(rows, F.col("a"), F.col("b")).first()
    assert tuple(found) == pytest.approx((1, 3, 1 / 3))
    table = {r["a"]: (r["b_0"], r["b_1"]) for r in summaries.crosstab(rows, "a", "b").collect()}
    assert table == {0: (1, 1), 1: (1, 1)}
    never = spark.createDataFrame([(1, 0), (0, 0)], "a int, b int")
    report = {r["class"]: r for r in summaries.classification_report(never, "a", "b").collect()}
    assert report[1]["precision"] == 0.0 and report[1]["recall"] == 0.0 and report[1]["f1"] == 0.0
    assert report[0]["recall"] == 1.0 and report[0]["accuracy"] == 0.5


def test_describe(spark):
    values = [float(i * i % 37) for i in range(100)]
    row = summaries.describe(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    expected = pd.Series(values).describe()
    assert tuple(row) == pytest.approx(tuple(expected))
    assert math.isclose(row["std"], np.std(values, ddof=1))


def test_value_counts(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "v string")
    found = {r["v"]: (r["n"], r["share"]) for r in summaries.value_counts(rows, "v").collect()}
    assert found == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}


def test_counters_of_a_write(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") % 2).alias("odd"))
    counts = {"odd": F.col("odd") == 1, "none": F.lit(False), "unknown": F.col("odd").isNull()}
    for shuffled in (rows, rows.repartition(5, "id")):
        for by in ([], ["k"]):
            found = tables.write_counted(shuffled, str(tmp_path / "out"), counts, by)
            back = spark.read.parquet(str(tmp_path / "out"))
            assert found == {"rows": 1000, "odd": back.filter("odd = 1").count(), "none": 0, "unknown": back.filter("odd is null").count()}
    assert tables.write_counted(rows.limit(0), str(tmp_path / "empty"), counts) == dict.fromkeys(("rows", *counts), 0)
    with pytest.raises(ValueError, match="rows"):
        tables.write_counted(rows, str(tmp_path / "bad"), {"rows": F.lit(True)})


def test_sketched_quantiles_by_rank(spark, tmp_path):
    draw = np.random.default_rng(8)
    values = np.round(draw.lognormal(size=60000), 2)
    days = np.where(np.arange(60000) % 3 == 0, 0, np.arange(60000) % 30)  # a third on one day
    rows = spark.createDataFrame(pd.DataFrame({"day": days, "v": values}))
    awkward = spark.createDataFrame([(31, None), (31, float("nan")), (32, 5.0)], "day long, v double")
    path = str(tmp_path / "sketches")
    sketches.sketched(rows.filter("day < 20"), "v", ["day"]).write.parquet(path)
    sketches.sketched(rows.filter("day >= 20").union(awkward), "v", ["day"]).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95}

    def close(found, of):
        ordered = np.sort(of)
        assert found["n"] == len(of)
        for name, share in shares.items():
            first, last = np.searchsorted(ordered, found[name], "left"), np.searchsorted(ordered, found[name], "right")
            assert first / len(of) - 0.01 <= share <= last / len(of) + 0.01

    per_day = {r["day"]: r for r in sketches.quantiles(stored, shares).collect()}
    assert per_day.keys() == {*days.tolist(), 32}
    for d in (0, 1, 20):
        close(per_day[d], values[days == d])
    assert (per_day[32]["n"], per_day[32]["mid"]) == (1, 5.0)
    close(sketches.quantiles(sketches.merged(stored.filter("day < 32")), shares).first(), values)
    tens = sketches.merged(stored.filter("day < 30"), [F.floor(F.col("day") / 10).alias("ten")])
    for r in sketches.quantiles(tens, shares).collect():
        close(r, values[days // 10 == r["ten"]])
    assert sketches.sketched(awkward.limit(0), "v", ["day"]).count() == 0


def test_csv_rejects(spark, tmp_path):
    """Each kind of bad record, between good ones with quotes, commas, line ends and empty fields."""
    lines = [
        "id,name,price", '1,"a ""b"", c",1.5', '2,"two\nlines",2.5', "x,bad id,1.0", "3,few", "4,many,1.0,9",
        '5,,', '6,"in, quotes",oops', "7,last,7.0",
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("id,name,price\n8,eight,8.0\n9,bad price,-\n")
    good, rejected = tables.read_csv_checked(spark, str(tmp_path), "id int, name string, price double")
    assert good.count() == 5 and rejected.count() == 5
    assert sorted(tuple(r) for r in good.collect()) == [
        (1, 'a "b", c', 1.5), (2, "two\nlines", 2.5), (5, None, None), (7, "last", 7.0), (8, "eight", 8.0)
    ]
    found = sorted((r["source_file"][-5:], r["line"]) for r in rejected.collect())
    assert found == [
        ("a.csv", "3,few"), ("a.csv", "4,many,1.0,9"), ("a.csv", '6,"in, quotes",oops'), ("a.csv", "x,bad id,1.0"), ("b.csv", "9,bad price,-"),
    ]
    assert good.select("name").filter("name = 'last'").count() == 1
