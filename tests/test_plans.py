"""Cleaning, extraction, signals, resume, streaming and models on small tables."""

import datetime
import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.plans import article_cleaning as cleaning
from tidewire.plans import extraction, language, model_table, tail_models, text_classifier, text_signal
from tidewire.operators.ordering import ranking_metrics
from tidewire.operators.split import contiguous_folds
from tidewire.plans.linear_fits import FitSpec, NotConverged, fit_together
from tidewire.session import stage_path
from tidewire.sources import resume, tables
from tidewire.streaming.incremental import run_incremental


def long(word, n=80):
    return " ".join([word] * n)


def test_clean_pass1(spark):
    rows = spark.createDataFrame(
        [
            (1, "u", True, "primary_html", long("alpha") + "  x", "en", 1.5),
            (2, "u", True, "primary_html", long("beta"), "en", 1.0),
            (3, "v", True, None, long("alpha") + " x", "en", 1.0),
            (4, "w", False, "primary_html", long("gamma"), "en", 1.0),
            (5, "x", True, "Download_Failed", long("delta"), "en", 1.0),
            (6, "y", True, "primary_html", "short", "en", 1.0),
            (7, "z", True, None, long("12 34"), "en", 1.0),
            (8, "q", True, None, None, "en", 1.0),
        ],
        "id int, url_norm string, extract_success boolean, extract_method string, text string, lang string, tone_score double",
    )
    found = {r["id"]: r for r in cleaning.clean_pass1(rows, "id").collect()}
    assert sorted(found) == [1, 7]
    assert found[1]["is_english"] and found[1]["tone_score"] == 1.5
    assert found[7]["quality_flag"] == "low_alpha" and not found[7]["is_english"]
    again = cleaning.clean_pass1(cleaning.clean_pass1(rows, "id").withColumnRenamed("text_clean", "text"), "id")
    assert sorted(r["id"] for r in again.collect()) == [1, 7]


def test_optional_columns(spark):
    rows = spark.createDataFrame([(1, long("alpha"), "en"), (2, long("alpha"), "en")], "id int, text string, lang string")
    assert [r["id"] for r in cleaning.clean_pass1(rows, "id").collect()] == [1]
    with pytest.raises(ValueError, match="text"):
        cleaning.clean_pass1(rows.drop("text"), "id")
    with pytest.raises(ValueError, match="year.*news_date"):
        tables.load_url_sample(rows, "id", 2000, 2001)


def pass2_rows(spark):
    ok = long("word", 60)
    cases = [
        (1, "http://e.com/story/1", "e.com", ok),
        (2, "http://e.com/tag/x", "e.com", ok + "a"),
        (3, None, None, ok + "b"),
        (4, "http://upstract.com/s", "upstract.com", ok + "c"),
        (5, "s", "e.com", "x" * 199),
        (6, "s", "e.com", "x" * 200),
        (7, "s", "e.com", "y" * 20000),
        (8, "s", "e.com", "y" * 20001),
        (9, "s", "e.com", ok + " more" * 9),
        (10, "s", "e.com", ok + " more" * 8),
        (11, "s", "e.com", "  " + ok + "  "),
        (12, "s", "e.com", ok + " itâ€™s"),
    ]
    return spark.createDataFrame(cases, "id int, url string, domain string, text_clean string")


def test_clean_pass2(spark):
    kept = cleaning.clean_pass2(pass2_rows(spark), "id")
    found = {r["id"]: r["text_clean"] for r in kept.collect()}
    assert sorted(found) == [1, 3, 6, 7, 10, 12]
    assert found[12].endswith("it's")
    assert sorted(r["id"] for r in cleaning.clean_pass2(kept, "id").collect()) == sorted(found)


def test_removed_by_rule(spark):
    counts = {r["rule"]: r["n"] for r in cleaning.removed_by_rule(pass2_rows(spark)).collect()}
    assert counts == {"kept": 6, "duplicate": 1, "navigation_url": 1, "blocked_domain": 1, "length": 2, "junk": 1}


def test_extraction(spark):
    body = "<p>" + long("prose") + "</p>"
    lines = "".join(f"<div>{long(w, 30)}</div>" for w in ("one", "two", "three"))
    pages = spark.createDataFrame(
        [(1, f"<html><nav>m</nav>{body}</html>"), (2, f"<body>{lines}</body>"), (3, "<p>tiny</p>"), (4, None)],
        "id int, html string",
    )
    found = {r["id"]: r for r in extraction.extract_text(pages).collect()}
    assert [found[i]["extract_method"] for i in (1, 2, 3, 4)] == [
        "primary_html", "fallback_html", "primary_html", "download_failed"
    ]
    assert [found[i]["extract_success"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert found[1]["text"] == long("prose") and found[1]["text_len"] == len(long("prose"))
    assert found[3]["text"] is None and found[3]["text_len"] == 0


def test_language(spark):
    truth = spark.createDataFrame(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", "en")], "text string, lang string"
    )
    profiles = language.fit_profiles(truth, "text", "lang", ["en", "fr"])
    assert profiles.count() == 9  # every word of both languages
    rows = spark.createDataFrame([(1, "The dog."), (2, "le chat"), (3, "12 34"), (4, "")], "id int, text string")
    found = {r["id"]: r["lang"] for r in language.detect_language(rows, "id", "text", profiles).collect()}
    assert found == {1: "en", 2: "fr", 3: "unknown", 4: "unknown"}


@pytest.mark.parametrize("share", [1, 8, 1 << 16])
def test_language_moves_rare_words_only(spark, monkeypatch, share):
    """None, some or all words of the profile are frequent; ids that repeat are one text, null ids none."""
    monkeypatch.setattr(language, "FREQUENT", share)
    texts = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", "en"), ("la maison", "fr")]
    profiles = language.fit_profiles(spark.createDataFrame(texts, "text string, lang string"), "text", "lang", ["en", "fr"])
    rows = [(1, "The dog."), (2, "le chat le"), (3, "12"), (1, "house maison"), (None, "le"), (4, None), (5, "das"), (6, "the le chat")]
    df = spark.createDataFrame(rows, "id int, text string")
    weight = {r["word"]: (r["en"], r["fr"]) for r in profiles.collect()}
    wanted = {}
    for i in {i for i, _ in rows}:
        met = [weight[w] for j, t in rows if j == i and i is not None for w in re.findall(r"[a-z]+", (t or "").lower()) if w in weight]
        en, fr = (round(sum(m[k] for m in met), 6) for k in (0, 1))
        wanted[i] = "unknown" if not met else "en" if en >= fr else "fr"
    detected = language.detect_language(df, "id", "text", profiles)
    assert sorted((r["id"] or 0, r["lang"]) for r in detected.collect()) == sorted((i or 0, wanted[i]) for i, _ in rows)
    assert "BroadcastHashJoin" in detected._jdf.queryExecution().executedPlan().toString()


def test_language_in_row(spark):
    truth = spark.createDataFrame(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house", "en"), ("das Haus", "de"), (None, "en")],
        "text string, lang string",
    )
    rows = spark.createDataFrame(
        [(1, "The dog.", "x"), (2, "le chat", None), (3, "12 34", "x"), (4, "", "x"), (5, None, "x"), (6, "das", "x")],
        "id int, text string, lang string",
    )
    for slot_of in (language.crc32_slot, language.md5_slot):
        profile = language.fit_slots(truth, "text", "lang", ["en", "fr"], slot_of=slot_of)
        assert profile.count() == 1 and profile.columns == ["en", "fr"]
        scored = language.language_in_row(rows, "text", profile, slot_of, "found")
        assert scored.columns == [*rows.columns, "found"]
        found = {r["id"]: r["found"] for r in scored.collect()}
        assert found == {1: "en", 2: "fr", 3: "unknown", 4: "unknown", 5: "unknown", 6: "unknown"}
    none = language.fit_slots(truth.limit(0), "text", "lang", ["en", "fr"])
    assert {r["lang"] for r in language.language_in_row(rows, "text", none).collect()} == {"unknown"}


def test_language_in_row_by_brute_force(spark):
    """Few slots, so that words share them; scores recomputed with dictionaries."""
    slots, words = 64, ["der", "die", "the", "of", "le", "et", "été", "über", "cat", "chien", "hund", "zz"]
    rng = np.random.default_rng(8)
    data = [(i, " ".join(rng.choice(words, rng.integers(0, 9))), ["en", "fr", "de"][i % 3]) for i in range(120)]
    frame = spark.createDataFrame(data, "id int, text string, lang string").repartition(5)
    counts = {}
    for _, value, lang in data:
        for w in value.split():
            cell = counts.setdefault(zlib.crc32(w.encode()) % slots, dict.fromkeys(["en", "fr", "de"], 0))
            cell[lang] += 1
    totals = {x: sum(c[x] for c in counts.values()) for x in ("en", "fr", "de")}
    weight = {s: {x: round(math.log((c[x] + 1) / (totals[x] + len(counts))) * language.PARTS) for x in c} for s, c in counts.items()}
    profile = language.fit_slots(frame, "text", "lang", ["en", "fr", "de"], slots)
    kept = profile.first()
    assert [kept["fr"][s] for s in range(slots)] == [weight.get(s, {}).get("fr", 0) for s in range(slots)]
    plan_side = language.language_in_row(frame.select("id", "text"), "text", profile)
    for row in plan_side.collect():
        sums = {x: sum(weight[zlib.crc32(w.encode()) % slots][x] for w in row["text"].split()) for x in ("en", "fr", "de")}
        assert row["lang"] == (max(sums, key=sums.get) if row["text"] else "unknown")


def test_cleaning_takes_the_language_from_the_row(spark):
    truth = spark.createDataFrame([("the word lies here", "en"), ("le mot est ici", "fr")], "text string, lang string")
    profile = language.fit_slots(truth, "text", "lang", ["en", "fr"])
    rows = spark.createDataFrame(
        [(1, "u1", long("word the"), True), (2, "u2", long("mot le"), True), (3, "u3", long("xyz"), True)],
        "id int, url string, text string, extract_success boolean",
    )
    by_join = cleaning.clean_pass1(rows, "id", lambda r: language.language_in_row(r, "text_clean", profile).select("id", "lang"))
    in_row = cleaning.clean_pass1(rows, "id", with_language=lambda r: language.language_in_row(r, "text_clean", profile))
    found = [tuple(r) for r in in_row.orderBy("id").collect()]
    assert found == [tuple(r) for r in by_join.orderBy("id").collect()]
    assert [r["lang"] for r in in_row.orderBy("id").collect()] == ["en", "fr", "unknown"]


def test_language_in_row_moves_no_texts(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr")], "id int, text string, lang string").write.parquet(path)
    rows = spark.read.parquet(path)
    profile = language.fit_slots(rows, "text", "lang", ["en", "fr"])
    plan = language.language_in_row(rows.select("id", "text"), "text", profile)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subqueries")[0]
    assert "Exchange" not in main and "Join" not in main and "Python" not in main


def test_daily_signal_c(spark):
    flags = {c: F.lit(1) for c in fv.TOPIC_FLAGS}
    rows = spark.createDataFrame([("d1", 0.2), ("d1", 0.8), ("d2", 0.6)], "news_date string, climatebert_prob double")
    rows = rows.withColumn("climatebert_label", (F.col("climatebert_prob") >= 0.5).cast("int")).withColumns(flags)
    found = {r["news_date"]: r for r in text_signal.daily_signal_c(rows).collect()}
    one = found["d1"]
    assert (one["n_articles"], one["n_climate_bert"]) == (2, 1)
    assert one["climate_prob_std"] == pytest.approx(0.424264, abs=1e-6)
    assert (one["climate_share_bert"], one["climate_prob_max"]) == (0.5, 0.8)
    assert one["log_n_articles"] == pytest.approx(1.098612, abs=1e-6)
    assert found["d2"]["climate_prob_std"] == 0.0


def test_signal_leaves_out_missing_columns(spark):
    rows = spark.createDataFrame([("2024-01-01", "t", 0.7), ("bad", "t", 0.7)], "news_date string, text_clean string, pred_prob_climate double")
    daily = text_signal.daily_signal_a(text_signal.with_predictions(rows))
    assert "avg_tone_score" not in daily.columns and daily.count() == 1


def test_news_features(spark):
    base = {c: 1.0 for c in [*fv.NEWS_WITHIN_FEATURES, *fv.NEWS_GLOBAL_FEATURES] if "within" not in c and c != "narrative_entropy"}
    counts = dict(zip(fv.TOPIC_COUNTS, (1, 1, 0, 0, 0, 0)))
    row = {"news_date": "31/12/2021", "n_articles_climate": 0, **counts, **base}
    found = model_table.news_features(spark.createDataFrame([row])).first()
    assert found["date"] == datetime.date(2021, 12, 31)
    assert found["share_policy_within"] is None
    assert found["narrative_entropy"] == pytest.approx(0.693147, abs=1e-6)


KEYS = "news_date string, url_norm string"


def test_resume(spark):
    todo = spark.createDataFrame([("d1", "u1"), ("d2", "u1"), ("d1", "u2"), ("d3", None)], KEYS)
    done = spark.createDataFrame([("d1", "u1"), ("d3", None)], KEYS)
    assert sorted(tuple(r) for r in resume.remaining(todo, done).collect()) == [("d1", "u2"), ("d2", "u1")]
    assert resume.remaining(todo, todo).count() == 0
    path = stage_path(spark, "resume")
    for part in (done, todo, todo):
        resume.append_remaining(part, path)
    assert spark.read.parquet(path).count() == 4


def test_resume_reads_only_its_days(spark, capsys):
    """The finished table is read through a partition filter; day, null day and an early crash's rows are all known."""
    path = stage_path(spark, "resume-days")
    days = spark.createDataFrame([(f"2024-01-{d:02d}", "u") for d in range(1, 29)] + [(None, "u")], KEYS)
    resume.append_remaining(days, path)
    for _ in range(2):
        resume.append_remaining(days.filter("news_date = '2024-01-05' or news_date is null"), path)
    assert spark.read.parquet(path).count() == 29
    done = resume.finished(days.filter("news_date = '2024-01-05'"), path, "news_date")
    assert done.count() == 1
    done.explain("formatted")
    assert "PartitionFilters: [" in capsys.readouterr().out.replace("PartitionFilters: []", "")


def test_incremental(spark):
    source, target, progress = (stage_path(spark, n) for n in ("in", "out", "progress"))
    for rows in ([("d1", "u1"), ("d2", "u2")], [("d1", "u1"), ("d3", "u3")], []):
        part = spark.createDataFrame(rows, KEYS)
        part.write.mode("append").parquet(source)
        run_incremental(spark, source, part.schema, target, progress, lambda b: b.dropDuplicates()).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(target).select("news_date", "url_norm").collect()) == [("d1", "u1"), ("d2", "u2"), ("d3", "u3")]


def test_partition_pruning(spark):
    path = stage_path(spark, "pruned")
    rows = spark.range(100).select("id", F.expr("date_add(date'2024-01-01', cast(id % 10 as int))").alias("ingest_date"))
    tables.write_parquet(rows, path, ["ingest_date"])
    part = spark.read.parquet(path).filter(F.col("ingest_date").between("2024-01-02", "2024-01-03"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan and part.count() == 20


def test_csv_keeps_difficult_text(spark):
    path = stage_path(spark, "csv")
    rows = spark.createDataFrame([(1, 'a "quote", b\nline '), (2, " lead"), (3, "c\\d")], "id int, t string")
    tables.write_csv(rows, path)
    back = tables.read_csv(spark, path, rows.schema).orderBy("id").collect()
    assert [r["t"] for r in back] == ['a "quote", b\nline ', " lead", "c\\d"]


def test_term_weights(spark):
    rows = spark.createDataFrame([(1, "solar wind solar"), (2, "wind farm"), (3, "the Élan")], "id int, t string")
    found = {(r["id"], r["term"]): r["weight"] for r in text_classifier.term_weights(rows, "id", "t").collect()}
    idf = lambda df: np.log(4 / (1 + df)) + 1
    raw = {"solar": 2 * idf(1), "wind": idf(2), "solar wind": idf(1), "wind solar": idf(1)}
    norm = np.sqrt(sum(v * v for v in raw.values()))
    assert {t: found[1, t] for t in raw} == pytest.approx({t: v / norm for t, v in raw.items()})
    assert found[3, "élan"] == pytest.approx(1.0)


@pytest.mark.parametrize("slots,spare", [(1 << 21, 4), (1 << 21, 1), (8, 1)])
def test_frequent_terms(spark, monkeypatch, slots, spare):
    """The exact vocabulary, also where slots are shared by many terms and the fullest ones do not suffice."""
    monkeypatch.setattr(text_classifier, "SLOTS", slots)
    monkeypatch.setattr(text_classifier, "SPARE", spare)
    texts = [[f"t{j}" for j in range(60) if (i * 7 + j) % (j + 1) < 3] * (1 + i % 2) for i in range(30)] + [[], None]
    terms = spark.createDataFrame([(t,) for t in texts], "_terms array<string>")
    tf, df = Counter(t for x in texts for t in x or []), Counter(t for x in texts for t in {*(x or [])})
    wanted = [(t, n, df[t]) for t, n in sorted(tf.items(), key=lambda r: (-r[1], r[0]))]
    for most in (1, 10, 25, 1000):
        found = text_classifier.vocabulary(text_classifier.frequent_terms(terms, most), most).collect()
        assert [(r["term"], r["tf"], r["df"]) for r in found] == wanted[:most]
    assert text_classifier.frequent_terms(terms.limit(0), 5).count() == 0


def test_term_weights_of_repeated_ids(spark):
    """Rows of one id are one text, rows without id another; only chosen terms count for the length."""
    rows = [(1, "solar wind"), (2, "wind farm"), (1, "wind"), (None, "farm gate"), (None, "farm"), (4, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    weights = text_classifier.term_weights(df, "id", "t", max_terms=2)
    idf = lambda df: math.log(7 / (1 + df)) + 1
    wind, farm = idf(2), idf(2)
    norm = math.hypot(wind, farm)
    found = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert found == pytest.approx({(1, "wind"): 1, (2, "wind"): wind / norm, (2, "farm"): farm / norm, (None, "farm"): 1})
    assert text_classifier.term_weights(df.limit(0), "id", "t").count() == 0


def test_text_classifier(spark):
    words = [("solar wind power", "climate_yes"), ("football match goal", "climate_no")]
    rows = [(i, words[i % 2][0] + f" w{i}", words[i % 2][1]) for i in range(40)] + [(99, "x", "other"), (98, "  ", "climate_no")]
    labelled = text_signal.prepare_labels(spark.createDataFrame(rows, "id int, text_clean string, suggested_label string"))
    assert labelled.count() == 40
    model = text_classifier.fit_text_classifier(labelled, max_iter=50)
    path = stage_path(spark, "model")
    model.write().overwrite().save(path)
    loaded = type(model).load(path)
    scored = text_classifier.score_with_pipeline(labelled, loaded)
    assert scored.filter((F.col("pred_prob_climate") >= 0.5).cast("int") != F.col("label")).count() == 0
    assert scored.columns == ["id", "text_clean", "suggested_label", "label", "pred_prob_climate"]
    terms = text_classifier.top_terms(loaded, 3).collect()
    assert "wind" in {r["term"] for r in terms if r["side"] == "positive"} | {"solar", "wind"}
    assert all(r["coef"] > 0 for r in terms if r["side"] == "positive")


def fit_rows(spark, n=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.8).astype(int)
    rows = [(int(b), *map(float, a), i % 5) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "y int, a double, b double, c double, fold int").persist()


def slope(x, y, weights, fit, names):
    """Gradient of the weighted log loss at a fit, intercept first."""
    intercept, coefs = fit
    margin = intercept + sum(coefs[n] * x[:, i] for i, n in enumerate(names) if n in coefs)
    error = np.where(y == 1, weights[1], weights[0]) * (1 / (1 + np.exp(-margin)) - y)
    return np.array([error.sum(), *[(error * x[:, i]).sum() for i in range(len(names))]])


def test_joint_fits_are_optimal(spark):
    x, y, rows = fit_rows(spark)
    names, weights = ("a", "b", "c"), (0.7, 2.0)
    specs = [
        FitSpec(names, weights, l2=1.0),
        FitSpec(("a",), weights, l2=1.0),
        FitSpec(names, weights, l1=15.0),
        FitSpec(names, weights, l1=15.0, left_out=2),
        FitSpec(names, weights, l1=1e6),
    ]
    full, one, lasso, fold, empty = fit_together(rows, names, "y", specs, "fold")
    gradient = slope(x, y, weights, full, names)
    assert np.abs(gradient + [0, *full[1].values()]).max() < 1e-5
    assert set(one[1]) == {"a"}
    for fit, keep in ((lasso, np.ones(len(y), bool)), (fold, np.arange(len(y)) % 5 != 2)):
        gradient = slope(x[keep], y[keep], weights, fit, names)
        values = np.array(list(fit[1].values()))
        assert abs(gradient[0]) < 1e-4
        assert np.abs(gradient[1:][values != 0] + 15.0 * np.sign(values[values != 0])).max() < 1e-4
        assert np.all(np.abs(gradient[1:][values == 0]) <= 15.0 + 1e-6)
    assert all(v == 0 for v in empty[1].values())
    rows.unpersist()


def test_joint_fits_equal_spark_ml(spark):
    _, y, rows = fit_rows(spark)
    features = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows)
    there = LogisticRegression(featuresCol="x", labelCol="y", regParam=3.0 / len(y), standardization=False, tol=1e-12, maxIter=500).fit(features)
    intercept, here = fit_together(rows, ("a", "b", "c"), "y", [FitSpec(("a", "b", "c"), l2=3.0)])[0]
    assert [intercept, *here.values()] == pytest.approx([there.intercept, *there.coefficients], abs=1e-6)
    rows.unpersist()


def test_unfinished_fits_are_refused(spark):
    _, _, rows = fit_rows(spark)
    with pytest.raises(NotConverged):
        fit_together(rows, ("a", "b", "c"), "y", [FitSpec(("a", "b", "c"), l2=0.1)], max_steps=1)
    rows.unpersist()


def test_staged_tables_go_with_the_driver(tmp_path):
    code = """
from tidewire.session import build_session, staged
spark = build_session(master="local[1]", spark__checkpoint__dir=%r)
assert staged(spark.range(3), "t").count() == 3
spark.stop()
""" % str(tmp_path)
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120)
    left = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert left == []


def test_folds_are_repeatable(spark):
    """Ties in the day are ordered by series; the blocks are those of ntile."""
    rows = spark.range(203).select((F.col("id") % 3).cast("string").alias("series_id"), F.expr("date_add(date '2021-01-01', cast(id / 3 as int))").alias("date"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    folds = [{tuple(r) for r in contiguous_folds(rows.repartition(n), "y", ["date", "series_id"], 5).select("series_id", "date", "fold").collect()} for n in (1, 5)]
    by = Window.partitionBy("y").orderBy("date", "series_id")
    assert folds[0] == folds[1] == {tuple(r) for r in rows.select("series_id", "date", (F.ntile(5).over(by) - 1)).collect()}


def test_nan_scores_are_left_out(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, float("nan")), (0, None)], "y int, p double")
    assert ranking_metrics(rows, "y", "p").first()["roc_auc"] == 1.0


def model_rows(spark, n=300):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        a, b = rng.normal(), rng.normal()
        rows.append(("s", datetime.date(2021, 1, 1) + datetime.timedelta(days=i), float(a), float(b), int(a + rng.normal() > 1)))
    return spark.createDataFrame(rows, "series_id string, date date, a double, b double, target_tail int")


def test_model_grid_and_lasso(spark):
    periods = {"first_test": "2021-08-01", "last_test": "2021-12-31"}
    table = model_rows(spark).withColumn("b", F.when(F.dayofmonth("date") > 5, F.col("b")))
    grid = tail_models.fit_grid(table, {"M1": ["a"], "M2": ["a", "b"], "M3": ["b"]}, **periods)
    results = {r["config"]: r for r in tail_models.compare(grid).collect()}
    # a gap in b costs the model of a alone no rows
    n = table.filter("date < date '2021-08-01'").count()
    gaps = table.filter("date < date '2021-08-01' and b is null").count()
    assert [(results[m]["n_train"], results[m]["n_dropped"]) for m in ("M1", "M2", "M3")] == [(n, 0), (n - gaps, gaps), (n - gaps, gaps)]
    assert all(r["weighted_positives"] == pytest.approx(r["n_train"] / 2, abs=1e-4) for r in results.values())
    assert results["M1"]["delta_roc_auc"] == 0.0 and results["M1"]["roc_auc"] > 0.65
    best = tail_models.best_model(tail_models.compare(grid)).first()
    assert best["roc_auc"] == max(r["roc_auc"] for r in results.values())
    with tail_models.scaled_split(model_rows(spark), ["a", "b"], **periods) as split:
        lasso = tail_models.fit_lasso_path(split, strengths=[0.001, 0.1, 10.0], folds=3)
    assert lasso.folds.count() == 9 and lasso.best_strength in (0.1, 10.0)
    kept = tail_models.coefficients([lasso.model], spark, 0.001).collect()
    assert kept[0]["feature"] == "a"


def test_sequence_models(spark):
    samples = tail_models.sequence_samples(model_rows(spark), ["a", "b"], 4, first_test="2021-08-01")
    assert samples.count() == 296
    assert len(samples.first()["features"]) == 8
    scored = tail_models.fit_sequence_models(
        samples, first_test="2021-08-01", last_test="2021-12-31", seeds=(0, 1), max_iter=2
    )
    assert scored.filter("prob < 0 or prob > 1").count() == 0
    assert scored.select("seed").distinct().count() == 2


def test_batch_scorer(spark):
    def make():
        def predict(texts):
            return np.array([[0.0, float(len(t))] for t in texts], dtype=np.float32)

        return predict

    rows = spark.createDataFrame([(1, ""), (2, "abc")], "id int, text_clean string")
    found = {r["id"]: r["pred_prob_climate"] for r in text_classifier.score_with_function(rows, make).collect()}
    assert found[1] == pytest.approx(0.5) and found[2] == pytest.approx(1 / (1 + np.exp(-3)))
