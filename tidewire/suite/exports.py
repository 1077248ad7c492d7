"""Splits, reports and tables that leave the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.operators import split, summaries
from tidewire.plans import text_signal as signal
from tidewire.session import stage_path
from tidewire.sources import tables
from tidewire.suite import inputs
from tidewire.suite.registry import query, r6, rounded, table


@query("""
with tested as (
  select doc_id, quality, md5(concat(doc_id::varchar, '|43')) as next,
    row_number() over (partition by quality order by md5(concat(doc_id::varchar, '|42')))
      <= ceil(0.2 * count(*) over (partition by quality) - 1e-9) as is_test
  from labels
),
checked as (
  select *, row_number() over (partition by quality, is_test order by next)
    <= ceil(0.2 * count(*) over (partition by quality, is_test) - 1e-9) as is_second
  from tested
)
select doc_id, quality, case when is_test then 'test' when is_second then 'validation' else 'train' end as part from checked
""")
def three_way_split(spark, sf_dir):
    """A fifth for the test, a fifth of the rest for validation, per label: 64, 16 and 20 %."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return split.three_way_split(labels, "doc_id", "quality")


# columns that the given tables lack; the same text in both engines
_CONTRACT = {
    "year": "cast(substr(news_date, 1, 4) as int)",
    "event_timestamp": "concat(news_date, 'T00:00:00Z')",
    "n_active_buckets": " + ".join(fv.TOPIC_FLAGS),
    "priority_score": "abs(tone_score)",
    "text_len": "cast(length(text) as int)",
}


def _article_table(spark, sf_dir):
    rows = inputs.article_text(spark, sf_dir).withColumns({name: F.expr(made) for name, made in _CONTRACT.items()})
    return tables.require_columns(rows, fv.ARTICLE_TEXT_COLUMNS).select(*fv.ARTICLE_TEXT_COLUMNS)


_CONTRACT_SQL = ", ".join(
    "md5(text) as text" if c == "text" else r6(_CONTRACT.get(c, c), c) if c in ("tone_score", "priority_score") else f"{_CONTRACT.get(c, c)} as {c}"
    for c in fv.ARTICLE_TEXT_COLUMNS
)


@query(f"with {inputs.ARTICLE_CTE} select {_CONTRACT_SQL} from article_text")
def article_text_table(spark, sf_dir):
    """The table of extracted articles, all columns in the order of its contract."""
    return rounded(_article_table(spark, sf_dir).withColumn("text", F.md5("text")))


@query(f"""
with {inputs.ARTICLE_CTE}
select 'all' as output, domain, count(*) as n, cast(sum(length(text)) as bigint) as chars from article_text group by domain
union all select 'extracted', domain, count(*), cast(sum(length(text)) as bigint) from article_text where extract_success group by domain
union all select 'summary', domain, count(*), cast(sum(length(text)) as bigint) from article_text group by domain
""")
def three_outputs(spark, sf_dir):
    """All rows, a part of them and a summary from one computed parent, read back."""
    parent = _article_table(spark, sf_dir)
    path = stage_path(spark, "outputs")
    sums = (F.count("*").alias("n"), F.sum("text_len").alias("chars"))
    tables.write_outputs(
        parent,
        path,
        {
            "all": lambda rows: rows,
            "extracted": lambda rows: rows.filter("extract_success"),
            "summary": lambda rows: rows.groupBy("domain").agg(*sums),
        },
        as_csv=["summary"],
    )
    parts = [
        tables.read_parquet(spark, f"{path}/{name}", schema=parent.schema).groupBy("domain").agg(*sums).withColumn("output", F.lit(name))
        for name in ("all", "extracted")
    ]
    summary = tables.read_csv(spark, f"{path}/summary", "domain string, n bigint, chars bigint").withColumn("output", F.lit("summary"))
    return parts[0].unionByName(parts[1]).unionByName(summary)


@query(f"""
with {inputs.SCORED_CTE}
select cast(news_date as date) as news_date, count(*) as n_articles, {r6('avg(prob)', 'climate_intensity_mean')}
from scored group by 1 order by 1 limit 10
""")
def signal_head(spark, sf_dir):
    """The first ten days of the daily signal."""
    daily = signal.daily_signal_a(inputs.scored_articles(spark, sf_dir))
    return rounded(daily.orderBy("news_date").limit(10).select("news_date", "n_articles", "climate_intensity_mean"))


_SHARES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
_SPREAD = {"n": "count(prob)", "mean": "avg(prob)", "std": "stddev_samp(prob)", "min": "min(prob)", "max": "max(prob)"} | {
    name: f"quantile_cont(prob, {share})" for name, share in _SHARES.items()
}


@query(f"""
with {inputs.SCORED_CTE},
flagged as (select prob, pred_label, prob >= 0.9 or prob <= 0.1 as high_conf from scored)
{" union all ".join(f"select 'pred_prob_climate' as part, '{n}' as name, {r6(f'cast({e} as double)', 'value')} from flagged" for n, e in _SPREAD.items())}
union all select 'pred_label', cast(pred_label as varchar), cast(count(*) as double) from flagged group by pred_label
union all select 'high_conf', cast(high_conf as varchar), cast(count(*) as double) from flagged group by high_conf
""")
def score_report(spark, sf_dir):
    """Distribution of the scores, and how many rows have each label and each confidence."""
    scored = inputs.scored_articles(spark, sf_dir).select("pred_prob_climate", "pred_label", "high_conf")
    return rounded(summaries.score_report(scored, "pred_prob_climate", ["pred_label", "high_conf"]))
