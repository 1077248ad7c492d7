"""Exact ranking metrics and classification reports on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import ordering, summaries
from tidewire.plans import tail_models as models
from tidewire.suite.registry import query, r6, rounded, table


def _sql_ranking(source: str, by: str = "") -> str:
    """Metrics per group from a relation with columns y, s and the group columns."""
    part = f"partition by {by} " if by else ""
    key = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""
counted as (select {key}s, sum(y)::double as pos, sum(1 - y)::double as neg from ({source}) group by {key}s),
running as (
  select *, sum(pos) over ({part}order by s desc) as tp, sum(neg) over ({part}order by s desc) as fp from counted
),
metrics as (
  select {key}cast(sum(pos) + sum(neg) as bigint) as n, cast(sum(pos) as bigint) as n_pos,
    1 - sum(pos * (fp - neg / 2)) / nullif(sum(pos) * sum(neg), 0) as roc_auc,
    sum(pos * tp / (tp + fp)) / nullif(sum(pos), 0) as average_precision
  from running {group}
)"""


_METRICS = f"n, n_pos, {r6('roc_auc', 'roc_auc')}, {r6('average_precision', 'average_precision')}"
_EVENTS = "select event_type, cast(event_type = 'purchase' as int) as y, value as s from events"


@query(f"with {_sql_ranking(_EVENTS)} select n, n_pos, {r6('roc_auc', 'roc_auc')} from metrics")
def roc_auc(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return rounded(ordering.ranking_metrics(events, "y", "value").drop("average_precision"))


@query(f"with {_sql_ranking(_EVENTS)} select {r6('average_precision', 'average_precision')} from metrics")
def average_precision(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return rounded(ordering.ranking_metrics(events, "y", "value").select("average_precision"))


@query(f"""
with {_sql_ranking("select l_linestatus, cast(l_returnflag = 'R' as int) as y, l_extendedprice as s from lineitem", "l_linestatus")}
select l_linestatus, {_METRICS} from metrics
""")
def metrics_by_group(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(ordering.ranking_metrics(items, "y", "l_extendedprice", ["l_linestatus"]))


_REGIMES = """
select regime, y, s from (
  select unnest(['early', 'late', 'all']) as regime, cast(event_type = 'signup' as int) as y, value as s, ts from events
) where (regime = 'early' and ts < timestamp '2024-01-10') or (regime = 'late' and ts >= timestamp '2024-01-20') or regime = 'all'
"""


@query(f"with {_sql_ranking(_REGIMES, 'regime')} select regime, {_METRICS} from metrics where n_pos > 0")
def regime_metrics(spark, sf_dir):
    day = F.col("ts").cast("date")
    events = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "signup").cast("int"))
    regimes = {
        "early": day < F.lit("2024-01-10").cast("date"),
        "late": day >= F.lit("2024-01-20").cast("date"),
        "all": F.lit(True),
        "none": F.lit(False),
    }
    return rounded(models.regime_metrics(events, "y", "value", regimes))


_SCORED = """
scored as (
  select quality as y, case when (n_chars % 128) / 128.0::double >= 0.5 then 1 else 0 end as yhat
  from documents join labels using (doc_id)
)
"""


def _scored(spark, sf_dir):
    predicted = ((F.col("n_chars") % 128) / F.lit(128.0) >= 0.5).cast("int")
    documents = table(spark, sf_dir, "documents").select("doc_id", predicted.alias("yhat"))
    return documents.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def _sql_class(k: int) -> str:
    hit = f"count(*) filter (where y = {k} and yhat = {k})"
    chosen = f"count(*) filter (where yhat = {k})"
    support = f"count(*) filter (where y = {k})"
    return f"""select {k} as class, {r6(f'coalesce({hit} / nullif({chosen}, 0), 0)', 'precision')},
  {r6(f'coalesce({hit} / nullif({support}, 0), 0)', 'recall')},
  {r6(f'coalesce(2 * {hit} / nullif({chosen} + {support}, 0), 0)', 'f1')},
  {support} as support, {r6('count(*) filter (where y = yhat) / count(*)', 'accuracy')} from scored"""


@query(f"with {_SCORED} {_sql_class(0)} union all {_sql_class(1)}")
def class_report(spark, sf_dir):
    return rounded(summaries.classification_report(_scored(spark, sf_dir), "y", "yhat"))


@query(f"""
with {_SCORED}
select y, count(*) filter (where yhat = 0) as yhat_0, count(*) filter (where yhat = 1) as yhat_1 from scored group by y
""")
def confusion(spark, sf_dir):
    return summaries.crosstab(_scored(spark, sf_dir), "y", "yhat")


_RUNS = """
select event_type as model, cast(user_id % 5 as int) as seed, cast(dayofweek(ts) in (0, 6) as int) as y, value as s from events
"""


def _runs(spark, sf_dir):
    weekend = F.dayofweek(F.col("ts").cast("date")).isin(1, 7).cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("seed"), weekend.alias("y"), "value"
    )
    return ordering.ranking_metrics(events, "y", "value", ["model", "seed"])


@query(f"""
with {_sql_ranking(_RUNS, 'model, seed')}
select model, count(*) as n_runs, {r6('avg(roc_auc)', 'roc_mean')}, {r6('stddev_pop(roc_auc)', 'roc_std')},
  {r6('max(roc_auc)', 'roc_best')}, {r6('avg(average_precision)', 'pr_mean')}, {r6('stddev_pop(average_precision)', 'pr_std')}
from metrics group by model
""")
def run_summary(spark, sf_dir):
    return rounded(models.run_summary(_runs(spark, sf_dir)))


_CONFIG = "select event_type as config, cast(dayofweek(ts) in (0, 6) as int) as y, value as s from events"


@query(f"""
with {_sql_ranking(_CONFIG, 'config')},
numbered as (select *, row_number() over (order by config) as config_no from metrics)
select config, config_no, {_METRICS},
  {r6('roc_auc - first_value(roc_auc) over (order by config_no)', 'delta_roc_auc')}
from numbered
""")
def metric_differences(spark, sf_dir):
    """Each model's AUC less the first model's."""
    order = ["click", "error", "purchase", "signup", "view"]
    number = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("event_type"))
    weekend = F.dayofweek(F.col("ts").cast("date")).isin(1, 7).cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), number.alias("config_no"), weekend.alias("y"), "value"
    )
    results = ordering.ranking_metrics(events, "y", "value", ["config_no", "config"])
    return rounded(models.with_first_difference(results))


@query(f"""
with {_sql_ranking(_CONFIG, 'config')}
select config, {_METRICS} from metrics order by metrics.roc_auc desc, config limit 1
""")
def best_config(spark, sf_dir):
    weekend = F.dayofweek(F.col("ts").cast("date")).isin(1, 7).cast("int")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("config"), F.col("event_type").alias("config_no"), weekend.alias("y"), "value"
    )
    results = ordering.ranking_metrics(events, "y", "value", ["config_no", "config"])
    return rounded(models.best_model(results).drop("config_no"))


@query(f"select 0.5::double as roc_auc, {r6('avg(cast(event_type = ' + chr(39) + 'purchase' + chr(39) + ' as int))', 'average_precision')} from events")
def random_baseline(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return rounded(models.random_baseline(events, "y"))
