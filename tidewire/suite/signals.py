"""Daily text signals, label counts, summaries, agreement with rule flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.operators import summaries
from tidewire.plans import text_signal as signal
from tidewire.sources.tables import require_columns, select_present
from tidewire.suite import inputs
from tidewire.suite.registry import query, r6, rounded, table, text_table

_FLAGS = fv.TOPIC_FLAGS

_DAILY = f"""
  cast(news_date as date) as news_date, count(text_clean) as n_articles,
  cast(sum(pred_label) as bigint) as n_pred_climate,
  {r6('avg(pred_label)', 'climate_share')},
  {r6('avg(prob)', 'climate_intensity_mean')}, {r6('sum(prob)', 'climate_intensity_sum')},
  {r6('ln(1 + count(text_clean))', 'log_n_articles')},
  {r6('ln(1 + sum(pred_label))', 'log_n_pred_climate')},
  {r6('ln(1 + sum(prob))', 'log_climate_intensity_sum')},
  {', '.join(r6(f'avg({c})', c) for c in _FLAGS)}
"""


@query(f"with {inputs.SCORED_CTE} select {_DAILY}, {r6('avg(tone_score)', 'avg_tone_score')} from scored group by 1")
def daily_signal_a(spark, sf_dir):
    return rounded(signal.daily_signal_a(inputs.scored_articles(spark, sf_dir)))


@query(f"with {inputs.SCORED_CTE} select {_DAILY}, {r6('avg(tone_score)', 'tone_score')} from scored group by 1")
def daily_signal_b(spark, sf_dir):
    return rounded(signal.daily_signal_b(inputs.scored_articles(spark, sf_dir)))


@query(f"""
with {inputs.SCORED_CTE}
select news_date, count(*) as n_articles, cast(sum(pred_label) as bigint) as n_climate_bert,
  {r6('avg(prob)', 'climate_prob_mean')}, {r6('max(prob)', 'climate_prob_max')},
  {r6('coalesce(stddev_samp(prob), 0)', 'climate_prob_std')},
  {', '.join(r6(f'avg({source})', name) for name, source in fv.FLAG_MEANS.items())},
  {r6('sum(pred_label) / count(*)', 'climate_share_bert')},
  {r6('ln(1 + count(*))', 'log_n_articles')}
from scored where length(text_clean) > 100 group by news_date
""")
def daily_signal_c(spark, sf_dir):
    scored = signal.usable_for_scoring(inputs.scored_articles(spark, sf_dir))
    return rounded(signal.daily_signal_c(scored, "pred_prob_climate", "pred_label"))


@query(f"""
with {inputs.SCORED_CTE}
select doc_id, {r6('prob', 'pred_prob_climate')}, pred_label,
  case pred_label when 1 then 'climate_yes' else 'climate_no' end as pred_label_name,
  prob >= 0.9 or prob <= 0.1 as high_conf
from scored
""")
def score_labels(spark, sf_dir):
    return rounded(
        inputs.scored_articles(spark, sf_dir).select(
            "doc_id", "pred_prob_climate", "pred_label", "pred_label_name", "high_conf"
        )
    )


LABELLED_CTE = """
labelled as (
  select d.doc_id, d.text,
    case when quality = 1 and toxic = 0 then 'climate_yes' when quality = 0 then 'climate_no' else 'other' end as suggested_label
  from documents d join labels l using (doc_id)
)
"""


def labelled(spark, sf_dir):
    quality, toxic = F.col("quality"), F.col("toxic")
    name = F.when((quality == 1) & (toxic == 0), fv.LABEL_YES).when(quality == 0, fv.LABEL_NO).otherwise("other")
    labels = table(spark, sf_dir, "labels").select("doc_id", name.alias("suggested_label"))
    documents = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.col("text").alias("text_clean"))
    return documents.join(labels, "doc_id")


@query(f"""
with {LABELLED_CTE}
select doc_id, suggested_label, case suggested_label when 'climate_yes' then 1 else 0 end as label,
  md5({inputs.sql_strip('text')}) as digest
from labelled where suggested_label in ('climate_yes', 'climate_no') and length({inputs.sql_strip('text')}) > 0
""")
def prepare_labels(spark, sf_dir):
    rows = signal.prepare_labels(labelled(spark, sf_dir))
    return rows.select("doc_id", "suggested_label", "label", F.md5("text_clean").alias("digest"))


@query(f"""
with {LABELLED_CTE}, n as (select suggested_label, count(*) as n from labelled group by 1)
select suggested_label, n, {r6('n / sum(n) over ()', 'share')} from n
""")
def label_counts(spark, sf_dir):
    return rounded(summaries.value_counts(labelled(spark, sf_dir), "suggested_label"))


@query("""
with n as (select source, count(*) as n from documents group by 1)
select source, n, round(n / sum(n) over (), 6) + 0.0::double as share from n order by n desc, source limit 20
""")
def source_counts_top(spark, sf_dir):
    return rounded(summaries.value_counts(table(spark, sf_dir, "documents"), "source", limit=20))


def _sql_describe(value: str) -> str:
    return f"""count({value}) as n, {r6(f'avg({value})', 'mean')}, {r6(f'stddev_samp({value})', 'std')},
  {r6(f'cast(min({value}) as double)', 'min')}, {r6(f'quantile_cont({value}, 0.25)', 'q25')},
  {r6(f'quantile_cont({value}, 0.5)', 'q50')}, {r6(f'quantile_cont({value}, 0.75)', 'q75')},
  {r6(f'cast(max({value}) as double)', 'max')}"""


@query(f"select {_sql_describe('length(text)')} from documents")
def length_summary(spark, sf_dir):
    lengths = table(spark, sf_dir, "documents").select(F.length("text").alias("size"))
    return rounded(summaries.describe(lengths, "size"))


@query(f"select {_sql_describe('l_extendedprice')} from lineitem")
def value_summary(spark, sf_dir):
    """Exact quartiles of a column with very many distinct values."""
    return rounded(summaries.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(f"""
with {inputs.ARTICLE_CTE}, days as (select news_date, count(*) as n from article_text group by 1)
select {_sql_describe('n')} from days
""")
def articles_per_day(spark, sf_dir):
    return rounded(summaries.describe_counts(inputs.article_text(spark, sf_dir), "news_date"))


@query(f"""
with {inputs.SCORED_CTE}
select pred_label, count(*) filter (where is_core_climate = 0) as is_core_climate_0,
  count(*) filter (where is_core_climate = 1) as is_core_climate_1
from scored group by pred_label
""")
def label_flag_crosstab(spark, sf_dir):
    return summaries.crosstab(inputs.scored_articles(spark, sf_dir), "pred_label", "is_core_climate")


@query(f"""
with {inputs.SCORED_CTE}
select count(*) filter (where pred_label = 1 and is_core_climate = 1) as n_both,
  count(*) filter (where pred_label = 1 or is_core_climate = 1) as n_either,
  {r6('count(*) filter (where pred_label = 1 and is_core_climate = 1) / nullif(count(*) filter (where pred_label = 1 or is_core_climate = 1), 0)', 'agreement')}
from scored
""")
def crosstab_agreement(spark, sf_dir):
    scored = inputs.scored_articles(spark, sf_dir)
    return rounded(summaries.agreement(scored, F.col("pred_label"), F.col("is_core_climate")))


@query(f"""
with {inputs.SCORED_CTE}
select doc_id, news_date, prob as pred_prob_climate, substr(text_clean, 1, 120) as head
from scored order by prob desc, doc_id limit 5
""")
def top_articles(spark, sf_dir):
    return signal.top_articles(inputs.scored_articles(spark, sf_dir), "pred_prob_climate", "doc_id")


@query(f"""
with {inputs.ARTICLE_CTE}
select source, count(*) as n, {r6('avg(extract_success::int)', 'success_rate')},
  {r6("avg((lang = 'en')::int)", 'english_rate')}, count(*) filter (where tone_score is null) as n_no_tone
from article_text group by source
""")
def rates_by_source(spark, sf_dir):
    return rounded(
        inputs.article_text(spark, sf_dir)
        .groupBy("source")
        .agg(
            F.count("*").alias("n"),
            summaries.rate(F.col("extract_success")).alias("success_rate"),
            summaries.rate(F.col("lang") == "en").alias("english_rate"),
            F.count_if(F.col("tone_score").isNull()).alias("n_no_tone"),
        )
    )


@query(f"with {inputs.ARTICLE_CTE} select doc_id as page, source, domain, news_date from article_text")
def optional_columns(spark, sf_dir):
    """Required columns checked while planning, optional ones selected if present."""
    rows = require_columns(inputs.article_text(spark, sf_dir), ["doc_id", "text"]).withColumnRenamed("doc_id", "page")
    return select_present(rows, ["page", "first_timestamp_utc", "source", "domain", "news_date", "priority_score"])
