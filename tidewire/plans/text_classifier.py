"""Term weights and a linear text classifier on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import fixed_values as fv
from tidewire.functions import numeric
from tidewire.session import staged

#: Slots of the hash by which terms are first counted, and how many times the wanted terms the fullest slots are.
SLOTS, SPARE = 1 << 21, 4
HELPERS = ("_words", "_kept", "_pairs", "_terms", "_counts", "_weighted", "_features")


def token_stages(text_col: str, stop_words: Sequence[str] | None = None) -> list:
    """Words of two or more characters without stop words, then neighbouring pairs."""
    stop_words = list(stop_words or StopWordsRemover.loadDefaultStopWords("english"))
    return [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=stop_words),
        NGram(inputCol="_kept", outputCol="_pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
    ]


def with_terms(df: DataFrame, text_col: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    terms = PipelineModel(stages=token_stages(text_col, stop_words)).transform(df)
    return terms.drop("_words", "_kept", "_pairs")


def term_counts(terms: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """``term, tf, df`` in one aggregate, of all terms or of those in the given slots.

    Each text's terms are sorted, so a term that differs from its predecessor is
    the first of its text and counts for the document frequency.
    """
    ordered = terms.select(F.sort_array("_terms").alias("_ordered"))
    marked = F.transform(
        F.col("_ordered"),
        lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(F.col("_ordered"), i - 1) != t)).alias("first")),
    )
    # an outer explode lets no filter on the terms sink below the cutting
    single = ordered.select(F.explode_outer(marked).alias("t")).filter("t is not null").select("t.*")
    if slots is not None:
        single = single.withColumn("_slot", term_slot("term")).join(F.broadcast(slots.select("_slot")), "_slot", "left_semi")
    return single.groupBy("term").agg(F.count("*").alias("tf"), F.count_if("first").alias("df"))


def term_slot(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def vocabulary(counts: DataFrame, max_terms: int = fv.MAX_TERMS) -> DataFrame:
    """The most frequent terms; ties at the limit go to the smaller term."""
    return counts.orderBy(F.desc("tf"), "term").limit(max_terms)


def frequent_terms(terms: DataFrame, max_terms: int = fv.MAX_TERMS) -> DataFrame:
    """The exact `vocabulary` of all terms, without counting all of them by name.

    Most pairs are rare, and counting each would move nearly every term of every text.
    So occurrences are first counted per slot of a hash: a slot's load is no less than
    the count of any of its terms. Terms of the fullest slots are counted by name; if the
    last one chosen has more than the fullest other slot, no other term can be among them.
    Otherwise the terms of all slots that reach its count are counted.
    """
    single = terms.select(F.explode_outer("_terms").alias("term")).filter("term is not null")
    loads = staged(single.groupBy(term_slot("term").alias("_slot")).agg(F.count("*").alias("load")), "term-slots")
    fullest, wanted = [F.desc("load"), "_slot"], SPARE * max_terms
    chosen = staged(vocabulary(term_counts(terms, loads.orderBy(*fullest).limit(wanted)), max_terms), "vocabulary")
    least = chosen.agg(F.min("tf")).first()[0]
    other = loads.orderBy(*fullest).offset(wanted).limit(1).first()
    if other and other["load"] >= least:
        chosen = staged(vocabulary(term_counts(terms, loads.filter(F.col("load") >= least)), max_terms), "vocabulary")
    return chosen


def smooth_idf(n_docs: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.ln((1 + n_docs) / (1 + df)) + 1


def term_weights(df: DataFrame, id_col: str, text_col: str, max_terms: int = fv.MAX_TERMS, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``id, term, weight`` in long form: tf * idf, scaled to length 1 per text.

    Only chosen terms are counted per text, by their place in the vocabulary, and only these
    counts are shuffled. The vocabulary, at most ``max_terms`` rows, comes to the driver
    and goes into the plan as constants.
    """
    terms = with_terms(df.select(id_col, text_col), text_col, stop_words)
    rows = frequent_terms(terms, max_terms).select("term").orderBy("term").collect()
    places = df.sparkSession.createDataFrame([(r["term"], i) for i, r in enumerate(rows)], "term string, place int")
    single = terms.select(id_col, F.explode_outer("_terms").alias("term")).join(F.broadcast(places), "term")
    per_term = single.groupBy(id_col, "place").agg(F.count("*").alias("n"))
    # rows of one id are one text; its list has at most max_terms entries
    per_text = staged(per_term.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "n"))).alias("_counts")), "term-counts")
    n_docs = df.agg(F.count("*"))
    found = per_text.select(F.explode("_counts.place").alias("place")).groupBy("place").agg(F.count("*").alias("df"))
    weights = found.withColumn("_n", n_docs.scalar()).select("place", smooth_idf(F.col("_n"), F.col("df")).alias("idf"))
    idf = {r["place"]: r["idf"] for r in weights.collect()}
    known = F.lit([idf.get(i, 0.0) for i in range(len(rows))]) if rows else F.array().cast("array<double>")
    raw = per_text.withColumn("_raw", F.transform("_counts", lambda c: c["n"] * F.get(known, c["place"])))
    norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda total, w: total + w * w))
    scaled = F.explode(F.transform("_counts", lambda c, i: F.struct(c["place"].alias("place"), (F.get("_raw", i) / F.col("_norm")).alias("weight"))))
    weighted = raw.withColumn("_norm", norm).select(id_col, scaled.alias("w")).select(id_col, "w.*")
    return weighted.join(F.broadcast(places), "place").select(id_col, "term", "weight")


def fit_text_features(train: DataFrame, text_col: str, max_terms: int = fv.MAX_TERMS, stop_words: Sequence[str] | None = None) -> PipelineModel:
    """Stages from text to a weighted vector of length 1 in ``_features``.

    Only the vocabulary, at most ``max_terms`` rows, comes to the driver.
    """
    terms = with_terms(train.select(text_col), text_col, stop_words)
    n_docs = train.agg(F.count("*"))
    chosen = vocabulary(frequent_terms(terms, max_terms), max_terms).withColumn("_n", n_docs.scalar())
    rows = chosen.select("term", smooth_idf(F.col("_n"), F.col("df")).alias("idf")).collect()
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="_terms", outputCol="_counts")
    idf = Vectors.dense([r["idf"] for r in rows])
    return PipelineModel(
        stages=[
            *token_stages(text_col, stop_words),
            counter,
            ElementwiseProduct(inputCol="_counts", outputCol="_weighted", scalingVec=idf),
            Normalizer(inputCol="_weighted", outputCol="_features", p=2.0),
        ]
    )


def fit_text_classifier(
    train: DataFrame,
    text_col: str = "text_clean",
    label_col: str = "label",
    max_terms: int = fv.MAX_TERMS,
    strength: float = 1.0,
    max_iter: int = 1000,
    stop_words: Sequence[str] | None = None,
) -> PipelineModel:
    """Term weights and an L2 logistic regression; the penalty is 1 / (C n)."""
    features = fit_text_features(train, text_col, max_terms, stop_words)
    ready = features.transform(train).select("_features", F.col(label_col).cast("double").alias(label_col))
    # the fit holds blocks of the rows in memory itself: kept here on disk, they leave it that room
    ready.persist(StorageLevel.DISK_ONLY)
    try:
        n = ready.count()
        classifier = LogisticRegression(
            featuresCol="_features",
            labelCol=label_col,
            regParam=1.0 / (strength * n),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=max_iter,
            rawPredictionCol="_raw",
            probabilityCol="_probability",
            predictionCol="_prediction",
        )
        model = classifier.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[*features.stages, model])


def score_with_pipeline(df: DataFrame, model: PipelineModel, prob: str = "pred_prob_climate") -> DataFrame:
    scored = model.transform(df).withColumn(prob, F.get(vector_to_array("_probability"), F.lit(1)))
    return scored.drop(*HELPERS, "_raw", "_probability", "_prediction")


def score_with_function(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    text_col: str = "text_clean",
    prob: str = "pred_prob_climate",
    batch: int = fv.SCORER_BATCH,
) -> DataFrame:
    """Score texts with a function from a batch of strings to rows of class scores.

    ``make_predict`` runs once per Python worker, so a model is loaded there once.
    Class scores become probabilities here; column 1 is kept.
    """
    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    scores = df.withColumn("_scores", predict(F.col(text_col)).cast("array<double>"))
    return scores.withColumn(prob, F.get(numeric.softmax(F.col("_scores")), F.lit(1))).drop("_scores")


def top_terms(model: PipelineModel, n: int = 20) -> DataFrame:
    """The n terms that speak most for and against the positive class."""
    counter = next(s for s in model.stages if isinstance(s, CountVectorizerModel))
    linear = model.stages[-1]
    spark = SparkSession.active()
    pairs = list(zip(counter.vocabulary, (float(c) for c in linear.coefficients.toArray())))
    table = spark.createDataFrame(pairs, "term string, coef double")
    most = table.orderBy(F.desc("coef"), F.desc("term")).limit(n).withColumn("side", F.lit("positive"))
    least = table.orderBy("coef", "term").limit(n).withColumn("side", F.lit("negative"))
    return most.unionByName(least)

