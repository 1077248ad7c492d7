"""Fitted models: term weights, text classifier, model grid, lasso path, row windows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.operators import summaries
from tidewire.operators.ordering import ranking_metrics
from tidewire.operators.split import contiguous_folds, stratified_split
from tidewire.plans import tail_models as models
from tidewire.plans import text_classifier as classifier
from tidewire.plans import text_signal as signal
from tidewire.session import stage_path, staged
from tidewire.suite import inputs
from tidewire.suite.modelling import TABLE_CTE, model_rows
from tidewire.suite.registry import query, r6, rounded, table, text_table
from tidewire.suite.signals import LABELLED_CTE, labelled

_STOP = ["the", "of", "and", "to", "in", "is", "that", "for", "la", "le", "de", "der", "die", "und"]


@query(rf"""
with words as (
  select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'),
    lambda w: not list_contains([{', '.join(f"'{w}'" for w in _STOP)}], w)) as kept
  from documents
),
terms as (
  select doc_id, unnest(kept) as term from words
  union all
  select doc_id, unnest(list_transform(range(1, len(kept)), lambda i: kept[i] || ' ' || kept[i + 1])) from words
),
per_text as (select doc_id, term, count(*) as n from terms group by all),
vocabulary as (
  select term, sum(n) as tf, count(*) as df from per_text group by term order by tf desc, term limit 10000
),
idf as (select term, df, ln((1 + (select count(*) from documents)) / (1 + df)) + 1 as idf from vocabulary),
raw as (select doc_id, term, n * idf as w from per_text join idf using (term)),
scaled as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)
select term, count(*) as n_texts, {r6('sum(weight)', 'total')}, {r6('max(weight)', 'top')} from scaled group by term
""")
def tfidf_weights(spark, sf_dir):
    """Term weights of all documents, added up per term."""
    weights = classifier.term_weights(text_table(spark, sf_dir, "documents", "doc_id"), "doc_id", "text", stop_words=_STOP)
    return rounded(
        weights.groupBy("term").agg(
            F.count("*").alias("n_texts"), F.sum("weight").alias("total"), F.max("weight").alias("top")
        )
    )


_models: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf_dir):
    """The marked labelled texts and the classifier, staged and fitted once per session and input, then read from files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        rows = signal.prepare_labels(labelled(spark, sf_dir))
        marked = staged(stratified_split(rows, "doc_id", "label", 0.2), "labelled")
        path = stage_path(spark, "text-classifier")
        classifier.fit_text_classifier(marked.filter(~F.col("is_test"))).write().overwrite().save(path)
        _models[key] = marked, PipelineModel.load(path)
    return _models[key]


@query()
def text_scores(spark, sf_dir):
    """Every document scored by the classifier fitted on the labelled ones."""
    _, model = _fitted(spark, sf_dir)
    documents = signal.drop_blank(inputs.article_text(spark, sf_dir).withColumnRenamed("text", "text_clean"))
    scored = signal.with_predictions(classifier.score_with_pipeline(documents, model))
    return rounded(
        scored.select("doc_id", "news_date", "pred_prob_climate", "pred_label", "pred_label_name", "high_conf")
    )


@query(f"""
with {inputs.ARTICLE_CTE}
select doc_id, news_date, true as consistent from article_text where length({inputs.sql_strip('text')}) > 0
""")
def text_scores_rows(spark, sf_dir):
    """Every non-blank document has one score, and label and confidence follow from it."""
    scored = text_scores(spark, sf_dir)
    prob = F.col("pred_prob_climate")
    label = F.col("pred_label") == (prob >= 0.5).cast("int")
    sure = F.col("high_conf").cast("int") == ((prob >= 0.9) | (prob <= 0.1)).cast("int")
    return scored.select("doc_id", "news_date", (prob.between(0, 1) & label & sure).alias("consistent"))


@query(f"""
with {LABELLED_CTE},
marked as (
  select *, row_number() over (partition by suggested_label order by md5(concat(doc_id::varchar, '|42')))
    <= ceil(0.2 * count(*) over (partition by suggested_label) - 1e-9) as is_test
  from labelled where suggested_label in ('climate_yes', 'climate_no') and length({inputs.sql_strip('text')}) > 0
)
select count(*) as n_train, count(*) filter (where suggested_label = 'climate_yes') as n_pos,
  cast(count(*) filter (where suggested_label = 'climate_yes') as double) as fitted_positives
from marked where not is_test
""")
def text_model_balance(spark, sf_dir):
    """As the intercept is free, the training probabilities add up to the number of positives, as near as the fit ends."""
    marked, model = _fitted(spark, sf_dir)
    train = marked.filter(~F.col("is_test"))
    scored = classifier.score_with_pipeline(train.select("doc_id", "text_clean", "label"), model)
    sums = scored.agg(F.count("*").alias("n_train"), F.sum("label").cast("long").alias("n_pos"), F.sum("pred_prob_climate").alias("fitted_positives"))
    return rounded(sums, 0)


@query()
def text_model_report(spark, sf_dir):
    """Precision, recall, F1, accuracy and ranking metrics on the held-out texts."""
    marked, model = _fitted(spark, sf_dir)
    test = marked.filter("is_test").select("doc_id", "text_clean", "label")
    scored = classifier.score_with_pipeline(test, model).drop("text_clean")
    scored = signal.with_predictions(staged(scored, "held-out-scores"))
    report = summaries.classification_report(scored, "label", "pred_label")
    ranking = ranking_metrics(scored, "label", "pred_prob_climate").select(F.struct("roc_auc", "average_precision").alias("r"))
    return rounded(report.withColumn("_r", ranking.scalar()).select("*", "_r.*").drop("_r"))


@query()
def text_signal_from_model(spark, sf_dir):
    """Daily signal of the scored documents."""
    _, model = _fitted(spark, sf_dir)
    documents = signal.drop_blank(inputs.article_text(spark, sf_dir).withColumnRenamed("text", "text_clean"))
    scored = signal.with_predictions(classifier.score_with_pipeline(documents, model))
    return rounded(signal.daily_signal_a(scored))


@query()
def top_terms(spark, sf_dir):
    _, model = _fitted(spark, sf_dir)
    return rounded(classifier.top_terms(model))


def _word_rate_scorer():
    """A stand-in for a pretrained model: class scores from word shares."""
    import numpy as np

    def predict(texts):
        scores = np.zeros((len(texts), 2), dtype=np.float32)
        for i, value in enumerate(texts):
            words = (value or "").lower().split()
            scores[i, 1] = 10.0 * sum(w in ("the", "that", "with") for w in words) / max(len(words), 1) - 1.0
        return scores

    return predict


@query(rf"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(lower(text), '{inputs.SQL_SPACE}+'), lambda w: w <> '') as w from documents
),
scores as (
  select doc_id, 10.0::double * len(list_filter(w, lambda x: x in ('the', 'that', 'with'))) / greatest(len(w), 1) - 1 as s from words
)
select doc_id, round(1 / (1 + exp(-s)), 4) + 0.0::double as prob from scores
""")
def batch_scores(spark, sf_dir):
    """Whole texts scored in Arrow batches by a user's function."""
    documents = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    scored = classifier.score_with_function(documents, _word_rate_scorer, "text", "prob")
    return rounded(scored.select("doc_id", "prob"), 4)


_ALL = [*fv.MARKET_FEATURES, *fv.NEWS_WITHIN_FEATURES, *fv.NEWS_GLOBAL_FEATURES]
_LABEL = "target_tail"
_PERIODS = {"first_test": inputs.SPLIT, "last_test": inputs.TEST_END}


def _sql_rows(configs, extra: str = "") -> str:
    """Rows and class weights per feature set; a free intercept makes the weighted probabilities add up to half of them."""
    parts = [
        f"""select {i} as config_no, '{name}' as config,
          count(*) filter (where {complete} and date < date '{inputs.SPLIT}') as n_train,
          count(*) filter (where not ({complete}) and date < date '{inputs.SPLIT}') as n_dropped,
          count(*) filter (where {complete} and date between date '{inputs.SPLIT}' and date '{inputs.TEST_END}') as n,
          coalesce(sum(target_tail) filter (where {complete} and date between date '{inputs.SPLIT}' and date '{inputs.TEST_END}'), 0) as n_pos
        from model_table"""
        for i, (name, features) in enumerate(configs.items())
        for complete in [" and ".join(f"{f} is not null" for f in features)]
    ]
    return f"""with {TABLE_CTE}, counted as ({' union all '.join(parts)})
      select config_no, config, n_train, n_dropped, n, n_pos, round(n_train / 2, 4) + 0.0::double as weighted_positives,
        true as ranked from counted"""


def _fitted_rows(results):
    """The part of a comparison that SQL can say as well, and that its metrics are possible ones."""
    possible = F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1)
    return rounded(
        results.select("config_no", "config", "n_train", "n_dropped", "n", "n_pos", "weighted_positives", F.coalesce(possible, F.lit(False)).alias("ranked")), 4
    )


@query()
def model_grid(spark, sf_dir):
    """Six feature sets: exact AUC and average precision, difference to the first."""
    return rounded(models.compare(models.fit_grid(model_rows(spark, sf_dir), **_PERIODS)))


@query(_sql_rows(fv.MODEL_CONFIGS))
def model_grid_rows(spark, sf_dir):
    """The rows each of the six models could use, and the sum that its fit must give."""
    return _fitted_rows(models.compare(models.fit_grid(model_rows(spark, sf_dir), **_PERIODS)))


@query()
def merged_grid(spark, sf_dir):
    """Market, with news, and with the text signal as well: what the text adds."""
    return rounded(models.compare(models.fit_grid(model_rows(spark, sf_dir), fv.MERGED_CONFIGS, **_PERIODS)))


@query(_sql_rows(fv.MERGED_CONFIGS))
def merged_grid_rows(spark, sf_dir):
    return _fitted_rows(models.compare(models.fit_grid(model_rows(spark, sf_dir), fv.MERGED_CONFIGS, **_PERIODS)))


@query()
def text_to_models(spark, sf_dir):
    """The whole chain: fitted text scores, daily signal, modelling table, the three models."""
    _, model = _fitted(spark, sf_dir)
    days = F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 7) % 2400).cast("int"))
    documents = inputs.article_text(spark, sf_dir).withColumnRenamed("text", "text_clean").withColumn("news_date", F.date_format(days, "yyyy-MM-dd"))
    scored = signal.with_predictions(classifier.score_with_pipeline(signal.drop_blank(documents), model))
    rows = model_rows(spark, sf_dir, signal.daily_signal_c(scored, "pred_prob_climate", "pred_label"))
    return rounded(models.compare(models.fit_grid(rows, fv.MERGED_CONFIGS, **_PERIODS)))


@query()
def model_regimes(spark, sf_dir):
    """The best of the six models, measured per period."""
    fitted = models.fit_grid(model_rows(spark, sf_dir), **_PERIODS)
    best = fitted[models.best_model(models.compare(fitted)).first()["config_no"]]
    scored = models.score_models([(best.model, best.test)], "date", _LABEL)
    regimes = {"1999": F.year("date") == 1999, "2000 on": F.year("date") >= 2000}
    return rounded(models.regime_metrics(scored, _LABEL, "prob", regimes, "config"))


@query()
def model_coefficients(spark, sf_dir):
    """Coefficients by absolute size, without the ones near 0."""
    fitted = models.fit_grid(model_rows(spark, sf_dir), **_PERIODS)
    return rounded(models.coefficients([f.model for f in fitted], spark, fv.MIN_COEFFICIENT))


@query()
def lasso_path(spark, sf_dir):
    """Cross-validated AUC per L1 strength, the best one, and its metrics on test rows."""
    with models.scaled_split(model_rows(spark, sf_dir), _ALL, **_PERIODS) as split:
        lasso = models.fit_lasso_path(split)
    path = lasso.folds.groupBy("strength").agg(F.avg("roc_auc").alias("mean_auc"), F.count("*").alias("n_folds"))
    scored = models.score_models([(lasso.model, split.test)], _LABEL)
    final = ranking_metrics(scored, _LABEL, "prob").select(F.struct("roc_auc", "average_precision").alias("r"))
    is_best = F.col("strength") == lasso.best_strength
    shown = path.withColumns({"is_best": is_best, "_r": F.when(is_best, final.scalar())})
    return rounded(
        shown.select("strength", "mean_auc", "n_folds", "is_best", F.col("_r.roc_auc").alias("test_auc"), F.col("_r.average_precision").alias("test_ap"))
    )


@query(f"""
with {TABLE_CTE},
train as (
  select target_tail as y, row_number() over (partition by target_tail order by date) - 1 as place, count(*) over (partition by target_tail) as size
  from model_table where date < date '{inputs.SPLIT}' and {' and '.join(f'{f} is not null' for f in _ALL)}
),
blocks as (
  select y, case when place < size % 5 * (size // 5 + 1) then place // (size // 5 + 1)
    else size % 5 + (place - size % 5 * (size // 5 + 1)) // (size // 5) end as fold from train
)
select cast(fold as int) as fold, count(*) as n, cast(sum(y) as bigint) as n_pos from blocks group by 1
""")
def lasso_folds(spark, sf_dir):
    """The blocks that the L1 path is cross-validated on."""
    with models.scaled_split(model_rows(spark, sf_dir), _ALL, **_PERIODS) as split:
        folds = contiguous_folds(split.train, _LABEL, ["date", "series_id"], fv.LASSO_FOLDS)
        return staged(folds.groupBy("fold").agg(F.count("*").alias("n"), F.sum(_LABEL).cast("long").alias("n_pos")), "folds")


@query()
def lasso_features(spark, sf_dir):
    """The features the best L1 model keeps."""
    with models.scaled_split(model_rows(spark, sf_dir), _ALL, **_PERIODS) as split:
        return rounded(models.coefficients([models.fit_lasso_path(split).model], spark, fv.MIN_COEFFICIENT))


_SEQUENCE_SETS = {
    "market": fv.MARKET_FEATURES,
    "market+global": fv.MARKET_FEATURES + fv.NEWS_GLOBAL_FEATURES,
    "market+global+text": fv.MARKET_FEATURES + fv.NEWS_GLOBAL_FEATURES + fv.TEXT_SIGNAL,
}


def _sql_samples() -> str:
    parts = []
    for name, features in _SEQUENCE_SETS.items():
        for window in fv.SEQUENCE_WINDOWS:
            complete = " and ".join(f"{f} is not null" for f in features)
            parts.append(f"""select '{name}, W={window}' as model, {len(features) * window} as width,
              count(*) filter (where date < date '{inputs.SPLIT}') as n_train,
              count(*) filter (where date between date '{inputs.SPLIT}' and date '{inputs.TEST_END}') as n_test,
              coalesce(cast(sum(target_tail) as bigint), 0) as n_pos
            from (select *, row_number() over (order by date) as place from model_table where {complete}) where place > {window}""")
    return f"with {TABLE_CTE} {' union all '.join(parts)}"


@query(_sql_samples())
def sequence_samples(spark, sf_dir):
    """The samples of every feature set and window."""
    rows, parts = model_rows(spark, sf_dir), []
    test = F.col("date").between(F.lit(inputs.SPLIT).cast("date"), F.lit(inputs.TEST_END).cast("date"))
    for name, features in _SEQUENCE_SETS.items():
        for window in fv.SEQUENCE_WINDOWS:
            samples = models.sequence_samples(rows, features, window, first_test=inputs.SPLIT)
            parts.append(samples.agg(
                F.lit(f"{name}, W={window}").alias("model"), F.max(F.size(vector_to_array("features"))).alias("width"),
                F.count_if(F.col("date") < F.lit(inputs.SPLIT).cast("date")).alias("n_train"), F.count_if(test).alias("n_test"),
                F.sum(_LABEL).cast("long").alias("n_pos"),
            ))
    return reduce(DataFrame.unionByName, parts)


@query()
def sequence_classifier(spark, sf_dir):
    """Boosted trees over windows of rows: every feature set and window, five seeds, summarised per variant."""
    rows = model_rows(spark, sf_dir)
    runs = []
    for name, features in _SEQUENCE_SETS.items():
        for window in fv.SEQUENCE_WINDOWS:
            samples = staged(models.sequence_samples(rows, features, window, first_test=inputs.SPLIT), "samples")
            scored = models.fit_sequence_models(samples, **_PERIODS)
            runs.append(scored.withColumn("model", F.lit(f"{name}, W={window}")))
    scored = staged(reduce(DataFrame.unionByName, runs), "sequence-scores")
    sizes = scored.groupBy("model").agg(F.max("n_train").alias("n_train"), (F.count("*") / F.count_distinct("seed")).cast("long").alias("n_test"))
    summary = models.run_summary(ranking_metrics(scored, _LABEL, "prob", ["model", "seed"]))
    return rounded(summary.join(sizes, "model"))
