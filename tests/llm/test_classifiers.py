import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import awkward
from tidewire.llm import bytescan, language_id, quality, queries, toxicity
from tidewire.llm.sampling import remainder

SF_DIR = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    rows = queries.queries()[name](spark, SF_DIR).where("held_out").select("doc_id", "score", "predicted")
    return rows.join(spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", label), "doc_id").toPandas()


def test_quality_on_held_out_documents(spark):
    found = held_out(spark, "op1_quality", "quality")
    assert found.score.between(0, 1).all()
    assert (found.predicted == found.quality).mean() > 0.93
    assert found.score[found.quality == 1].mean() > found.score[found.quality == 0].mean() + 0.4


def test_toxicity_on_held_out_documents(spark):
    """The smallest tables teach few words: order and precision are checked, recall at larger sizes is in the README."""
    found = held_out(spark, "op6_toxicity", "toxic")
    assert found.score.between(0, 1).all()
    assert (found.predicted == found.toxic).mean() > 0.9
    assert found.score[found.toxic == 1].mean() > found.score[found.toxic == 0].mean() + 0.3


def test_language_on_held_out_documents(spark):
    rows = queries.op7_language_id(spark, SF_DIR).where("held_out").join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert rows.where("score < 0 or score > 1").count() == 0


def test_folds(spark):
    import zlib

    rows = spark.range(50).select("id", remainder(5, "id").alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def _scored(frame):
    return {(r["doc"]["doc_id"], r["doc"]["text"]): r for r in frame.collect()}


@pytest.mark.parametrize("rows", [None, [], [(1, 1, 1)], [(None, None, None)]])
def test_awkward_rows(spark, rows):
    docs, labels = awkward.documents(spark), awkward.labels(spark, rows)
    for frame in (quality.score(docs, labels.select("doc_id", F.col("quality").alias("label"))), toxicity.score(docs, labels)):
        found = frame.collect()
        assert len(found) == len(awkward.texts()) and all(0 <= r["score"] <= 1 for r in found)
        assert found[0]["doc"].asDict().keys() == set(docs.columns)
    if rows == []:
        assert {r["score"] for r in quality.score(docs, labels.select("doc_id", F.col("quality").alias("label"))).collect()} == {0.5}


def test_awkward_languages(spark):
    docs = awkward.documents(spark)
    found = _scored(language_id.identify(docs, docs))
    assert len(found) == len(set(awkward.texts()))
    for (_, text), row in found.items():
        if text is None or not any(c.isalpha() for c in text):
            assert (row["lang_pred"], row["score"], row["accepted"]) == ("und", 0.0, False)
        else:
            assert row["lang_pred"] == "en" and 0 <= row["score"] <= 1
    untaught = language_id.identify(docs, docs.where("1 = 0")).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def test_empty(spark):
    none, labels = awkward.no_documents(spark), awkward.labels(spark)
    assert quality.score(none, labels.select("doc_id", F.col("quality").alias("label"))).collect() == []
    assert toxicity.score(none, labels).collect() == []
    assert language_id.identify(none, none).collect() == []


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(1, "zzqx xqzz kkwv vwkk zzqx qqxz wwkk " * 20)], "doc_id long, text string")
    assert language_id.identify(odd, docs).first()["accepted"] is False
    assert language_id.identify(docs.where("lang = 'fr' and n_chars > 500"), docs).agg(F.avg(F.col("accepted").cast("int"))).first()[0] > 0.9


def test_label_model_counts_copies_once():
    """Three voters that always speak together are no stronger than one."""
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    vote = lambda hit, false: (rng.random(4000) < np.where(truth, hit, false)).astype(np.int8)
    weak, good = vote(0.5, 0.3), [vote(0.7, 0.02) for _ in range(3)]
    votes = np.stack([weak, weak, weak, *good, -(1 - np.maximum.reduce(good))], axis=1).astype(np.int8)
    posterior = toxicity.label_model(votes, 0.3)
    assert ((posterior > 0.5) == truth).mean() > 0.95


def _taught(spark, toxic, clean):
    docs = spark.createDataFrame(list(enumerate([*toxic, *clean])), "doc_id long, text string")
    return docs, spark.createDataFrame([(k, int(k < len(toxic))) for k in range(len(toxic) + len(clean))], "doc_id long, toxic int")


def test_rare_toxic_words_are_learned(spark):
    """A word of ten toxic texts is learned beside a thousand others and beside copies, which teach once."""
    rng = np.random.default_rng(3)
    plain = lambda: " ".join("".join(rng.choice(list("aeioustnrl"), 6)) for _ in range(8))
    toxic = [f"{plain()} vvile{plain()[:2]} {'zqqzz' if k < 10 else 'wkkww'}" for k in range(600)]
    docs, labels = _taught(spark, [*toxic, *[toxic[-1]] * 1400], [plain() for _ in range(600)])
    word = toxicity.terms(bytescan.texts(pa.array(["zqqzz"])))[0][0]
    assert word in toxicity.fit(docs, labels).features
    once, twice = toxicity.fit(*_taught(spark, toxic[:3], [plain() for _ in range(60)])), toxicity.fit(*[(d.union(d)) for d in _taught(spark, toxic[:3], [plain() for _ in range(60)])])
    assert word not in once.features and word not in twice.features


def test_rare_toxic_documents_count_in_the_fit(spark, monkeypatch):
    """Toxic documents are few beside the sample, of which a third is one repeated row: words of theirs score as toxic all the same."""
    monkeypatch.setattr(toxicity, "SAMPLE", 300)
    rng = np.random.default_rng(4)
    plain = lambda: " ".join("".join(rng.choice(list("aeioustnrl"), 6)) for _ in range(8))
    words = ["zqqzz", "wkkww", "vxxvv"]
    toxic = [f"{plain()} {words[k % 3]} {words[(k + 1) % 3]}" for k in range(60)]
    clean = [plain() for _ in range(12_000)]
    docs = spark.createDataFrame([*enumerate([*toxic, *clean]), *[(100, clean[40])] * 6000], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(260)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights))
    assert all(weight[int(toxicity.terms(bytescan.texts(pa.array([w])))[0][0])] > 1 for w in words)
    found = {r["doc"]["doc_id"]: r["score"] for r in toxicity.score(docs, labels).where("doc.doc_id < 200").collect()}
    assert min(found[k] for k in range(60)) > 0.5 > max(found[k] for k in range(60, 200))


def test_terms_of_words():
    keys, docs = toxicity.terms(bytescan.texts(pa.array(["lowering lowered", "low", ""])))
    shared = set(keys[docs == 0])
    assert len(keys) == len(docs) and set(docs) == {0, 1}
    # two words and, of each, the beginnings of 4 to 8 bytes that are shorter than the word; "lowe" and "lower" are shared
    assert len(shared) == 2 + 2 * len([s for s in toxicity.STEMS if s < 7]) - 2 + 1


def test_shapes_do_not_depend_on_neighbours():
    given = ["A a a B!", "", "one\ntwo\none", "x" * 5000]
    together = quality.shapes(bytescan.texts(pa.array(given)))
    apart = np.concatenate([quality.shapes(bytescan.texts(pa.array([t]))) for t in given])
    assert (together == apart).all()


def test_ngrams_across_pieces(monkeypatch):
    whole = bytescan.ngram_counts(bytescan.texts(pa.array(["abcabc", "", "xyzxyzxyz"])), (2, 3), 256)
    monkeypatch.setattr(bytescan, "PIECE_BYTES", 4)
    assert (bytescan.ngram_counts(bytescan.texts(pa.array(["abcabc", "", "xyzxyzxyz"])), (2, 3), 256) == whole).all()
    assert whole.sum(axis=1).tolist() == [9, 0, 15]
