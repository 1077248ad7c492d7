"""Daily news panel and its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.plans import news_panel
from tidewire.suite import inputs
from tidewire.suite.registry import query, r6, rounded

_COUNTED = ["climate", "carbon", "cleantech", "energy", "policy", "transition"]

_PANEL_SQL = f"""
with {inputs.EVENT_ARTICLES_CTE}
select news_date, count(*) as n_articles,
  {r6('avg(tone_score)', 'avg_tone')},
  {r6('avg(case when tone_score > 0 then tone_score end)', 'avg_positivity')},
  {r6('avg(case when tone_score < 0 then abs(tone_score) end)', 'avg_negativity')},
  {', '.join(f'cast(sum(is_{n}) as bigint) as n_{n}' for n in _COUNTED)},
  {', '.join(r6(f'sum(is_{n}) / count(*)', f'share_{n}') for n in _COUNTED)}
from flagged where is_relevant = 1 group by news_date
"""


@query(_PANEL_SQL)
def daily_news_panel(spark, sf_dir):
    return rounded(news_panel.daily_news_panel(inputs.gkg_articles(spark, sf_dir), *inputs.NEWS_SPAN))


@query(f"""
with {inputs.EVENT_ARTICLES_CTE}
select 'https://example.com/a/' || event_id as url, news_date, themes, tone_score,
  is_climate, is_carbon, is_cleantech, is_energy, is_policy, is_relevant, is_transition,
  case when tone_score > 0 then tone_score end as positive_tone_component,
  case when tone_score < 0 then abs(tone_score) end as negative_tone_component
from flagged
""")
def theme_flags(spark, sf_dir):
    articles = news_panel.scan_articles(inputs.gkg_articles(spark, sf_dir), *inputs.NEWS_SPAN)
    return news_panel.tag_articles(articles).drop("event_timestamp", "source")


@query(f"""
with {inputs.EVENT_ARTICLES_CTE}
select is_relevant, is_transition, cast(count(*) as bigint) as n,
  cast(count(*) filter (where tone_score > 0) as bigint) as n_positive,
  cast(count(*) filter (where tone_score < 0) as bigint) as n_negative
from flagged group by 1, 2
""")
def relevance_profile(spark, sf_dir):
    articles = news_panel.scan_articles(inputs.gkg_articles(spark, sf_dir), *inputs.NEWS_SPAN)
    return (
        news_panel.tag_articles(articles)
        .groupBy("is_relevant", "is_transition")
        .agg(
            F.count("*").alias("n"),
            F.count("positive_tone_component").alias("n_positive"),
            F.count("negative_tone_component").alias("n_negative"),
        )
    )
