"""Stored models: same scores in a new session, versions, refusals."""

import json
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import scaling
from tidewire.plans import language, tail_models, text_classifier
from tidewire.sources import models

TEXTS = [("warm seas rise", 1), ("warm rain falls", 1), ("stock prices fall", 0), ("prices and stock", 0)]


def features(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal(3, 2)), float(rng.normal() * 1e-7), 5.0) for i in range(60)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double")


def linear():
    return [
        tail_models.LinearModel(0, "one", 0.1 + 0.2, {"a": 1 / 3, "b": -math.pi * 1e5}),
        tail_models.LinearModel(1, "two", -1e-300, {"c": 2.0, "a": 0.0}),
    ]


def scores(df, found, scaler):
    return [tuple(r) for r in scaler.apply(df).select("id", *[m.probability().alias(m.name) for m in found]).orderBy("id").collect()]


def test_scaler_is_standardize(spark):
    rows = features(spark)
    whole = scaling.standardize(rows, rows, ["a", "b", "c"]).orderBy("id").collect()
    apart = scaling.fit_scaler(rows, ["a", "b", "c"]).apply(rows).orderBy("id").collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in apart]
    empty = scaling.fit_scaler(rows.limit(0), ["a"])
    assert empty.statistics == {"a": (None, None)}
    assert empty.apply(rows).filter("a is not null").count() == 0


def test_linear_models_come_back_exactly(spark, tmp_path):
    rows, path = features(spark), str(tmp_path / "m")
    scaler = scaling.fit_scaler(rows, ["a", "b", "c"])
    assert models.save_linear(linear(), scaler, rows, path, {"l2": 0.5}) == 1
    found, again = models.load_linear(spark, path, scored=rows)
    assert found == linear() and again == scaler
    assert [list(m.coefficients) for m in found] == [["a", "b"], ["c", "a"]]
    assert scores(rows, found, again) == scores(rows, linear(), scaler)
    assert models.manifests(spark, path)[0].notes == {"l2": 0.5}
    with pytest.raises(ValueError, match="lacks"):
        models.save_linear([tail_models.LinearModel(0, "x", 0.0, {"z": 1.0})], scaler, rows, path)


def test_versions(spark, tmp_path):
    rows, path = features(spark), str(tmp_path / "m")
    assert models.manifests(spark, path) == []
    with pytest.raises(FileNotFoundError):
        models.load_scaler(spark, path)
    first = scaling.fit_scaler(rows, ["a"])
    second = scaling.fit_scaler(rows.filter("id < 30"), ["a"])
    assert [models.save_scaler(s, rows, path) for s in (first, second)] == [1, 2]
    assert models.load_scaler(spark, path) == second
    assert models.load_scaler(spark, path, 1) == first
    with pytest.raises(FileNotFoundError, match="version 3"):
        models.load_scaler(spark, path, 3)


def test_an_interrupted_save_is_not_read(spark, tmp_path, monkeypatch):
    rows, path = features(spark), str(tmp_path / "m")
    kept = scaling.fit_scaler(rows, ["a"])
    models.save_scaler(kept, rows, path)

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(models, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            models.save_scaler(scaling.fit_scaler(rows, ["b"]), rows, path)
    assert models.load_scaler(spark, path) == kept
    assert models.save_scaler(kept, rows, path) == 2


def test_refusals(spark, tmp_path):
    rows, path = features(spark), str(tmp_path / "m")
    models.save_scaler(scaling.fit_scaler(rows, ["a", "b"]), rows, path)
    models.load_scaler(spark, path, scored=rows.withColumn("more", F.lit(1)))
    with pytest.raises(models.ModelMismatch, match="b: double wanted, missing"):
        models.load_scaler(spark, path, scored=rows.drop("b"))
    with pytest.raises(models.ModelMismatch, match="a: double wanted, float"):
        models.load_scaler(spark, path, scored=rows.withColumn("a", F.col("a").cast("float")))
    with pytest.raises(models.ModelMismatch, match="is a scaler, not a pipeline"):
        models.load_pipeline(spark, path)
    later = spark.createDataFrame([(2, 9, "scaler", "x", "{}", "{}")], models._MANIFEST)
    later.write.mode("append").json(f"{path}/manifests")
    with pytest.raises(models.ModelMismatch, match="layouts"):
        models.load_scaler(spark, path)


def test_profiles(spark, tmp_path):
    truth = spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string")
    rows = spark.createDataFrame([(1, "cat"), (2, "chat"), (3, "")], "id int, text string")
    whole = language.fit_profiles(truth, "text", "lang", ["fr", "en"])
    slots = language.fit_slots(truth, "text", "lang", ["fr", "en"], 512)
    models.save_profiles(whole, "string", "text", str(tmp_path / "whole"))
    models.save_profiles(slots, "string", "text", str(tmp_path / "slots"))
    kept = models.load_profiles(spark, str(tmp_path / "whole"), scored=rows)
    assert kept.columns == whole.columns
    found = {r["id"]: r["lang"] for r in language.detect_language(rows, "id", "text", kept).collect()}
    assert found == {1: "en", 2: "fr", 3: "unknown"}
    kept = models.load_profiles(spark, str(tmp_path / "slots"), scored=rows)
    assert kept.columns == ["fr", "en"]
    assert {r["id"]: r["lang"] for r in language.language_in_row(rows, "text", kept).collect()} == found


def test_same_scores_in_another_session(spark, tmp_path):
    """Saved here, loaded by another process with a session of its own, compared bit by bit."""
    rows, texts = features(spark), spark.createDataFrame(TEXTS, "text_clean string, label int")
    rows.write.parquet(str(tmp_path / "rows"))
    texts.write.parquet(str(tmp_path / "texts"))
    scaler = scaling.fit_scaler(rows, ["a", "b", "c"])
    models.save_linear(linear(), scaler, rows, str(tmp_path / "linear"))
    fitted = text_classifier.fit_text_classifier(texts, max_terms=50)
    models.save_pipeline(fitted, texts, ["text_clean"], str(tmp_path / "texts_model"))
    here = {
        "linear": [[x.hex() for x in r[1:]] for r in scores(rows, linear(), scaler)],
        "texts": [
            [r["text_clean"], r["pred_prob_climate"].hex()]
            for r in text_classifier.score_with_pipeline(texts, fitted).orderBy("text_clean").collect()
        ],
    }
    code = """
import json
from tidewire.plans import text_classifier
from tidewire.session import build_session
from tidewire.sources import models
root = %r
spark = build_session("later", master="local[2]", spark__sql__shuffle__partitions=2)
rows, texts = spark.read.parquet(root + "/rows"), spark.read.parquet(root + "/texts")
found, scaler = models.load_linear(spark, root + "/linear", scored=rows)
scored = scaler.apply(rows).select("id", *[m.probability().alias(m.name) for m in found]).orderBy("id").collect()
pipeline = models.load_pipeline(spark, root + "/texts_model", scored=texts)
marked = text_classifier.score_with_pipeline(texts, pipeline).orderBy("text_clean").collect()
there = {
    "linear": [[x.hex() for x in r[1:]] for r in scored],
    "texts": [[r["text_clean"], r["pred_prob_climate"].hex()] for r in marked],
}
with open(root + "/there.json", "w") as out:
    json.dump(there, out)
spark.stop()
""" % str(tmp_path)
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=240)
    assert json.loads((tmp_path / "there.json").read_text()) == here
