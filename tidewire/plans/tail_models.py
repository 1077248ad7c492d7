"""Linear and sequence models of the tail event, and their comparison.

The modelling table holds one row per day and series. Linear models are fitted
together by distributed passes, and all models of a grid are scored in one pass
over the test rows, as column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import numeric
from tidewire.operators.ordering import ranking_metrics
from tidewire.operators.scaling import standardize, with_class_weight
from tidewire.operators.split import contiguous_folds, split_by_date
from tidewire.operators.windows import SeriesOrder, row_sequences, with_positions
from tidewire.plans.linear_fits import FitSpec, fit_together
from tidewire.session import staged


#: Fits that run at the same time; each is a row of short jobs that leave most tasks of a cluster idle.
FITS_AT_ONCE = 8


def side_by_side(work: Callable, items: Sequence) -> list:
    """Results of ``work`` over the items, in their order, from jobs submitted in parallel."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(work, items))


@dataclass(frozen=True)
class LinearModel:
    """Coefficients over named, already scaled features."""

    number: int
    name: str
    intercept: float
    coefficients: Mapping[str, float]

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for feature, coefficient in self.coefficients.items():
            if coefficient:
                margin = margin + F.col(feature) * F.lit(coefficient)
        return numeric.sigmoid(margin)


@dataclass(frozen=True)
class ScaledSplit:
    """Train and test rows scaled by training statistics."""

    features: tuple[str, ...]
    label: str
    train: DataFrame
    test: DataFrame
    class_sizes: Mapping[int, int]
    n_dropped: int = 0

    @property
    def n_train(self) -> int:
        return sum(self.class_sizes.values())


@contextmanager
def scaled_split(
    table: DataFrame,
    features: Sequence[str],
    label: str = "target_tail",
    first_test: str = fv.MODEL_SPLIT,
    last_test: str = fv.MODEL_TEST_END,
) -> Iterator[ScaledSplit]:
    """Split by date, drop rows with a missing feature, scale by the training rows.

    ``table`` should be written or cached: statistics and rows are read apart. The
    training rows are held in memory until the context ends. ``n_dropped`` counts the
    training rows that lack one of these features.
    """
    complete = F.lit(True)
    for feature in features:
        complete = complete & F.col(feature).isNotNull() & ~F.isnan(F.col(feature).cast("double"))
    known = split_by_date(table, "date", first_test, last_test)[0].groupBy(label, complete.alias("complete"))
    counts = known.agg(F.count("*").alias("n")).collect()
    sizes = {int(r[label]): r["n"] for r in counts if r["complete"]}
    train, test = split_by_date(table.filter(complete), "date", first_test, last_test)
    scaled = standardize(train, train, features).persist()
    try:
        yield ScaledSplit(tuple(features), label, scaled, standardize(test, train, features), sizes, sum(r["n"] for r in counts if not r["complete"]))
    finally:
        scaled.unpersist()


def balanced(sizes: Mapping[int, int]) -> tuple[float, float]:
    """Class weights n / (2 n_class); a class that is absent weighs 0."""
    n = sum(sizes.values())
    return tuple(n / (2 * sizes[k]) if sizes.get(k) else 0.0 for k in (0, 1))


@dataclass(frozen=True)
class FittedConfig:
    """One feature set: its model, the scaled test rows, and the training rows used and left out.

    ``weighted_positives`` is the sum of the fitted probabilities times the class weights:
    as the intercept is free, it equals the weighted number of positives.
    """

    model: LinearModel
    test: DataFrame
    n_train: int
    n_dropped: int
    weighted_positives: float


def fit_grid(
    table: DataFrame,
    configs: Mapping[str, Sequence[str]] = fv.MODEL_CONFIGS,
    strength: float = 1.0,
    label: str = "target_tail",
    first_test: str = fv.MODEL_SPLIT,
    last_test: str = fv.MODEL_TEST_END,
) -> list[FittedConfig]:
    """Class-balanced L2 models, one per named feature set.

    Every set uses all rows that have its own features, so that a gap in one feature
    costs no rows of the models without it.
    """

    def fit(numbered: tuple[int, tuple[str, Sequence[str]]]) -> FittedConfig:
        number, (name, features) = numbered
        with scaled_split(table, features, label, first_test, last_test) as split:
            weights = balanced(split.class_sizes)
            spec = FitSpec(split.features, weights, l2=1.0 / strength)
            model = LinearModel(number, name, *fit_together(split.train, split.features, label, [spec])[0])
            weight = F.when(F.col(label) == 1, weights[1]).otherwise(weights[0])
            total = split.train.agg(F.sum(model.probability() * weight).alias("total")).first()["total"]
            return FittedConfig(model, split.test, split.n_train, split.n_dropped, total)

    return side_by_side(fit, list(enumerate(configs.items())))


def score_models(fitted: Sequence[tuple[LinearModel, DataFrame]], *keep: str) -> DataFrame:
    """``config_no, config, prob`` for every model and test row, written once: metrics read it twice."""
    scored = [
        test.select(*keep, F.lit(m.number).alias("config_no"), F.lit(m.name).alias("config"), m.probability().alias("prob"))
        for m, test in fitted
    ]
    return staged(reduce(DataFrame.unionByName, scored), "model-scores")


def with_first_difference(results: DataFrame, order: str = "config_no", metric: str = "roc_auc") -> DataFrame:
    """Add the difference of a metric to the first row's; a results table is small."""
    first = results.agg(F.min_by(metric, order))
    return results.withColumn(f"delta_{metric}", F.col(metric) - first.scalar())


def compare(fitted: Sequence[FittedConfig], label: str = "target_tail") -> DataFrame:
    """Rows used, ROC-AUC, average precision and the difference to the first model."""
    scored = score_models([(f.model, f.test) for f in fitted], label)
    results = with_first_difference(ranking_metrics(scored, label, "prob", ["config_no", "config"]))
    counts = F.create_map(
        *[x for f in fitted for x in (F.lit(f.model.number), F.struct(F.lit(f.n_train).alias("n_train"), F.lit(f.n_dropped).alias("n_dropped"), F.lit(f.weighted_positives).alias("weighted_positives")))]
    )
    return results.withColumn("_counts", counts[F.col("config_no")]).select("*", "_counts.*").drop("_counts")


def best_model(results: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """The row with the highest metric, the first one on ties."""
    return results.orderBy(F.desc_nulls_last(metric), "config_no").limit(1)


def regime_metrics(scored: DataFrame, label: str, score: str, regimes: Mapping[str, Column], *by: str) -> DataFrame:
    """Metrics per named slice of the rows; slices without positives are left out."""
    parts = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in regimes.items()]), lambda x: x.isNotNull())
    sliced = scored.select(*by, label, score, F.explode(parts).alias("regime"))
    return ranking_metrics(sliced, label, score, ["regime", *by]).filter("n_pos > 0")


def coefficients(models: Sequence[LinearModel], spark: SparkSession, minimum: float = 0.0) -> DataFrame:
    """``config, feature, coef`` by absolute size, small ones left out."""
    rows = [
        (m.number, m.name, feature, c)
        for m in models
        for feature, c in m.coefficients.items()
        if abs(c) > minimum
    ]
    table = spark.createDataFrame(rows, "config_no int, config string, feature string, coef double")
    return table.orderBy("config_no", F.desc(F.abs("coef")), "feature")


@dataclass(frozen=True)
class LassoPath:
    """Validation AUC per strength and fold, and the model refitted at the best strength."""

    folds: DataFrame
    best_strength: float
    model: LinearModel


def lasso_strengths(n: int = fv.LASSO_STRENGTHS) -> list[float]:
    """n values from 1e-4 to 1e4, evenly spaced in their logarithm."""
    return [10 ** (-4 + 8 * i / (n - 1)) for i in range(n)]


def _validation_scores(rows: DataFrame, split: ScaledSplit, fits: Sequence[tuple[int, float, tuple]]) -> DataFrame:
    """Every row scored by the models that left its fold out: ``strength, fold, label, prob``.

    The table of models has one row per fold and strength.
    """
    spark = rows.sparkSession
    models = spark.createDataFrame(
        [(fold, c, intercept, [coefs[f] for f in split.features]) for fold, c, (intercept, coefs) in fits],
        "fold int, strength double, intercept double, weights array<double>",
    )
    values = rows.select("fold", split.label, F.array(*[F.col(f).cast("double") for f in split.features]).alias("x"))
    products = F.zip_with("x", "weights", lambda a, b: a * b)
    margin = F.aggregate(products, F.col("intercept"), lambda acc, v: acc + v)
    return values.join(F.broadcast(models), "fold").select("strength", "fold", split.label, numeric.sigmoid(margin).alias("prob"))


def fit_lasso_path(
    split: ScaledSplit, strengths: Sequence[float] | None = None, folds: int = fv.LASSO_FOLDS
) -> LassoPath:
    """L1 models: strength chosen by cross-validated AUC, then refit on all training rows.

    Folds are blocks in date order per class, and each fold balances its own
    classes. All folds and strengths share the same passes over the rows.
    """
    strengths = list(strengths or lasso_strengths())
    rows = contiguous_folds(split.train, split.label, ["date", *[c for c in ("series_id",) if c in split.train.columns]], folds).persist()
    try:
        held = {(r["fold"], r[split.label]): r["n"] for r in rows.groupBy("fold", split.label).agg(F.count("*").alias("n")).collect()}
        keys, specs = [], []
        for fold in range(folds):
            sizes = {k: n - held.get((fold, k), 0) for k, n in split.class_sizes.items()}
            for c in strengths:
                keys.append((fold, c))
                specs.append(FitSpec(split.features, balanced(sizes), l1=1.0 / c, left_out=fold))
        fits = fit_together(rows, split.features, split.label, specs, "fold")
        scored = _validation_scores(rows, split, [(*key, fit) for key, fit in zip(keys, fits)])
        per_fold = ranking_metrics(scored, split.label, "prob", ["strength", "fold"])
        means = {r["strength"]: r["auc"] for r in per_fold.groupBy("strength").agg(F.avg("roc_auc").alias("auc")).collect()}
        best = max(strengths, key=lambda c: (means.get(c) or 0.0, -c))
        spec = FitSpec(split.features, balanced(split.class_sizes), l1=1.0 / best)
        final = fit_together(rows, split.features, split.label, [spec])[0]
    finally:
        rows.unpersist()
    return LassoPath(per_fold, best, LinearModel(0, "Lasso (all features)", *final))


def sequence_samples(
    table: DataFrame, features: Sequence[str], window: int, label: str = "target_tail", first_test: str = fv.MODEL_SPLIT,
    include_current: bool = False, chunk_rows: int | None = None,
) -> DataFrame:
    """Scaled row windows as one flat vector per day.

    Scaling uses training rows; windows run over the whole table, so the first test
    windows reach back into the training period. ``chunk_rows`` is for series without
    a bound, as in `row_sequences`.
    """
    whole = table.na.drop(subset=list(features))
    train = whole.filter(F.col("date") < F.lit(first_test).cast("date"))
    scaled = standardize(whole, train, features)
    order = SeriesOrder(("series_id",), ("date",))
    kept = scaled.select("series_id", "date", label, *features)
    samples = row_sequences(kept, order, features, window, include_current, chunk_rows=chunk_rows)
    return samples.select("series_id", "date", label, array_to_vector(F.flatten("sequence")).alias("features"))


def last_share(df: DataFrame, series: SeriesOrder, share: float, name: str) -> DataFrame:
    """Mark the last rows of each series, by their place from 0 to 1; no task sorts a whole series.

    The order must be strict: no two rows of a series may tie.
    """
    placed = with_positions(df, series, "_place", "_length")
    place = F.coalesce(F.try_divide(F.col("_place"), F.col("_length") - 1), F.lit(0.0))
    return placed.withColumn(name, place > 1 - share).drop("_place", "_length")


def fit_sequence_models(
    samples: DataFrame,
    label: str = "target_tail",
    first_test: str = fv.MODEL_SPLIT,
    last_test: str = fv.MODEL_TEST_END,
    seeds: Sequence[int] = (0, 1, 2, 3, 4),
    max_iter: int = 30,
    max_depth: int = 3,
    validation_share: float = 0.2,
) -> DataFrame:
    """Boosted trees over row windows, one model per seed, scored on the test rows.

    The number of trees is chosen on the last part of the training period, never on
    test rows. Returns ``seed, date, label, prob, n_train``.
    """
    train, test = split_by_date(samples, "date", first_test, last_test)
    marked = last_share(train, SeriesOrder(("series_id",), ("date",)), validation_share, "_validation")
    weighted = with_class_weight(marked, label).withColumn("label", F.col(label).cast("double"))
    rows = weighted.persist()

    def fit(seed: int) -> DataFrame:
        estimator = GBTClassifier(
            labelCol="label", weightCol="weight", validationIndicatorCol="_validation", seed=seed,
            maxIter=max_iter, maxDepth=max_depth, subsamplingRate=0.7, featureSubsetStrategy="sqrt",
        )
        prob = F.get(vector_to_array("probability"), F.lit(1))
        return estimator.fit(rows).transform(test).select(F.lit(seed).alias("seed"), "date", label, prob.alias("prob"))

    try:
        n_train = rows.count()
        scored = side_by_side(fit, list(seeds))
    finally:
        rows.unpersist()
    return reduce(DataFrame.unionByName, scored).withColumn("n_train", F.lit(n_train))


def run_summary(runs: DataFrame, by: str = "model") -> DataFrame:
    """Mean, population deviation and best of repeated runs."""
    return runs.groupBy(by).agg(
        F.count("*").alias("n_runs"),
        F.avg("roc_auc").alias("roc_mean"),
        F.stddev_pop("roc_auc").alias("roc_std"),
        F.max("roc_auc").alias("roc_best"),
        F.avg("average_precision").alias("pr_mean"),
        F.stddev_pop("average_precision").alias("pr_std"),
    )


def random_baseline(test: DataFrame, label: str = "target_tail") -> DataFrame:
    """What guessing scores: AUC one half, average precision the positive rate."""
    rate = F.avg(F.col(label).cast("double"))
    return test.agg(F.lit(0.5).alias("roc_auc"), rate.alias("average_precision"))
