"""The given tables in the shape of the analysis inputs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import themes, urls
from tidewire.plans import market_panel as market
from tidewire.suite.registry import table, text_table

# --- the daily price: mean order value per day, with one negative price per year
PRICE_SPAN = ("1995-01-01", "2001-12-31")
TRAIN_END = "1999-12-31"
SPLIT = "1999-01-01"
TEST_END = "2001-12-31"

PRICE_CTE = """
price_raw as (
  select cast(o_orderdate as date) as date,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as double) / (count(*) * 100) as mean_price
  from orders group by 1
),
prices as (
  select date, case when dayofyear(date) = 100 then -37.0::double else mean_price end as wti_price
  from price_raw where date between date '1995-01-01' and date '2001-12-31'
)
"""

SERIES_CTE = """
prices as (
  select p_type as series_id, cast(l_shipdate as date) as date,
         cast(sum(cast(round(l_extendedprice * 100) as bigint)) as double) / (count(*) * 100) as wti_price
  from lineitem join part on l_partkey = p_partkey
  where cast(l_shipdate as date) between date '1995-01-01' and date '2001-12-31'
  group by 1, 2
)
"""


def _mean_cents(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("bigint")).cast("double") / (F.count("*") * 100)


def price_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``observation_date, DCOILWTICO`` as text, as a price file has them."""
    day = F.col("o_orderdate").cast("date")
    daily = table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(_mean_cents("o_totalprice").alias("price"))
    price = F.when(F.dayofyear("day") == 100, F.lit(-37.0)).otherwise(F.col("price"))
    return daily.select(F.col("day").cast("string").alias("observation_date"), price.cast("string").alias("DCOILWTICO"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.load_prices(price_raw(spark, sf_dir), "observation_date", "DCOILWTICO", *PRICE_SPAN)


def series_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily price series per part type."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    daily = (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy("p_type", "day")
        .agg(_mean_cents("l_extendedprice").alias("price"))
    )
    return market.load_prices(daily, "day", "price", *PRICE_SPAN, series="p_type")


# --- article rows with themes and tone: one per event
NEWS_SPAN = ("2024-01-03", "2024-01-28")
EVENT_THEMES = {
    "click": "ENV_CLIMATECHANGE;TAX_CARBON_TAX;WB_WINDOW",
    "view": "WB_525_RENEWABLE_ENERGY;SOIL_EMISSIONS",
    "purchase": "ECON_OILPRICE;UNGP_CLIMATE_CHANGE_ACTION",
    "signup": "REGULATION;GENERAL_POLICY;GAS",
    "error": "BUSINESS_CLIMATE;CARBON",
}

_THEME_FLAGS_SQL = ",\n    ".join(
    f"cast(regexp_matches(themes, '{'|'.join(patterns)}') as int) as {name}" for name, patterns in fv.THEME_PATTERNS.items()
)


EVENT_ARTICLES_CTE = f"""
articles as (
  select cast(ts as date) as news_date, event_id, round(value * 4) / 4 - 50 as tone_score,
    lower(case event_type
      when 'click' then 'ENV_CLIMATECHANGE;TAX_CARBON_TAX;WB_WINDOW'
      when 'view' then 'WB_525_RENEWABLE_ENERGY;SOIL_EMISSIONS'
      when 'purchase' then 'ECON_OILPRICE;UNGP_CLIMATE_CHANGE_ACTION'
      when 'signup' then 'REGULATION;GENERAL_POLICY;GAS'
      when 'error' then 'BUSINESS_CLIMATE;CARBON' else '' end) as themes
  from events where cast(ts as date) between date '2024-01-03' and date '2024-01-28'
),
tagged as (
  select *,
    {_THEME_FLAGS_SQL}
  from articles where not regexp_matches(themes, '{fv.EXCLUDED_THEME}')
),
flagged as (
  select *,
    case when is_climate = 1 or (is_carbon = 1 and is_energy = 1) then 1 else 0 end as is_relevant,
    case when is_climate = 1 and is_energy = 1 then 1 else 0 end as is_transition
  from tagged
)
"""


def gkg_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article rows in the raw warehouse shape: integer time, delimited tone."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_THEMES.items() for x in pair])
    tone = F.round(F.col("value") * 4) / 4 - 50
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMddHHmmss").cast("bigint").alias("DATE"),
        F.concat(F.lit("https://example.com/a/"), F.col("event_id")).alias("DocumentIdentifier"),
        F.col("user_id").cast("string").alias("SourceCommonName"),
        F.try_element_at(names, "event_type").alias("V2Themes"),
        F.concat_ws(",", tone.cast("string"), F.lit("0.0"), F.lit("1")).alias("V2Tone"),
        F.col("ts").cast("date").alias("ingest_date"),
    )


# --- extracted articles: one per document
FLAG_WORDS = {
    "is_core_climate": ["the "],
    "is_policy_regulation": ["und", "der "],
    "is_physical_risk": ["les ", "eau"],
    "is_energy_geopolitics": ["that"],
    "is_cleantech": ["ing "],
    "is_activism_litigation": ["que", "with"],
}

ARTICLE_CTE = """
article_text as (
  select doc_id, source, lang, text, n_chars,
    strftime(date '2024-01-01' + cast(doc_id % 30 as integer), '%Y-%m-%d') as news_date,
    'https://www.' || source || '.example.com/'
      || case source when 'src3' then 'Topics' when 'src5' then 'tag' else 'story' end
      || '/' || n_chars || '/?ref=' || lang as url,
    'https://' || source || '.example.com/'
      || case source when 'src3' then 'Topics' when 'src5' then 'tag' else 'story' end
      || '/' || n_chars as url_norm,
    'www.' || source || '.example.com' as domain,
    source <> 'src11' as extract_success,
    case when source = 'src7' then 'Download_Failed' else 'primary_html' end as extract_method,
    (n_chars % 41 - 20) / 4.0::double as tone_score,
    cast(contains(lower(text), 'the ') as int) as is_core_climate,
    cast(regexp_matches(lower(text), 'und|der ') as int) as is_policy_regulation,
    cast(regexp_matches(lower(text), 'les |eau') as int) as is_physical_risk,
    cast(contains(lower(text), 'that') as int) as is_energy_geopolitics,
    cast(contains(lower(text), 'ing ') as int) as is_cleantech,
    cast(regexp_matches(lower(text), 'que|with') as int) as is_activism_litigation
  from documents
)
"""

# The whitespace set of the text functions, for RE2.
SQL_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_collapse(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_clean_article(expression: str) -> str:
    return sql_collapse(f"replace(replace({expression}, chr(65279), ' '), 'ï»¿', ' ')")


def sql_strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.when(F.col("source") == "src3", "Topics").when(F.col("source") == "src5", "tag").otherwise("story")
    url = F.concat(
        F.lit("https://www."), "source", F.lit(".example.com/"), section, F.lit("/"), "n_chars", F.lit("/?ref="), "lang"
    )
    lowered = F.lower("text")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return (
        text_table(spark, sf_dir, "documents", "doc_id")
        .withColumns(
            {
                "news_date": F.date_format(day, "yyyy-MM-dd"),
                "url": url,
                "extract_success": F.col("source") != "src11",
                "extract_method": F.when(F.col("source") == "src7", "Download_Failed").otherwise("primary_html"),
                "tone_score": (F.col("n_chars") % 41 - 20) / F.lit(4.0),
                **themes.theme_flags(lowered, FLAG_WORDS),
            }
        )
        .withColumns({"url_norm": urls.normalize_url(F.col("url")), "domain": urls.domain_of(F.col("url"))})
    )


# --- scored articles: a probability derived from the text length, with ties
SCORED_CTE = ARTICLE_CTE + f""",
scored as (
  select *, {sql_strip('text')} as text_clean, (n_chars % 128) / 128.0::double as prob,
    case when (n_chars % 128) / 128.0::double >= 0.5 then 1 else 0 end as pred_label
  from article_text where length({sql_strip('text')}) > 0
)
"""


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewire.plans.text_signal import drop_blank, with_predictions

    rows = article_text(spark, sf_dir).withColumnRenamed("text", "text_clean")
    return with_predictions(drop_blank(rows.withColumn("pred_prob_climate", (F.col("n_chars") % 128) / F.lit(128.0))))


# --- daily news with topic counts: one article per line item
NEWS_DAILY_CTE = """
item_flags as (
  select cast(l_shipdate as date) as day,
    cast(round((l_discount - 0.05) * 100) as double) as tone,
    cast(l_quantity >= 15 as int) as a,
    cast(l_returnflag = 'A' as int) as core,
    cast(l_linestatus = 'O' as int) as policy,
    cast(l_quantity < 10 as int) as physical,
    cast(l_quantity > 40 as int) as energy,
    cast(l_tax < 0.02 as int) as cleantech,
    cast(l_discount > 0.08 as int) as activism
  from lineitem
),
news_daily as (
  select day as news_day,
    sum(a) as n_articles_climate, sum(core) as n_core_climate, sum(policy) as n_policy_regulation,
    sum(physical) as n_physical_risk, sum(energy) as n_energy_geopolitics, sum(cleantech) as n_cleantech,
    sum(activism) as n_activism_litigation, ln(1 + sum(a)) as log_n_articles_climate,
    avg(tone) as avg_tone, avg(case when tone > 0 then tone end) as avg_positivity,
    avg(case when tone < 0 then abs(tone) end) as avg_negativity,
    sum(a) / count(*) as share_total_climate, sum(policy) / count(*) as share_policy,
    sum(physical) / count(*) as share_physical, sum(energy) / count(*) as share_energy,
    sum(cleantech) / count(*) as share_cleantech, sum(activism) / count(*) as share_activism
  from item_flags group by 1
)
"""


def news_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per shipping day, in the column contract of the modelling table."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"),
        F.round((F.col("l_discount") - 0.05) * 100).alias("tone"),
        (F.col("l_quantity") >= 15).cast("int").alias("a"),
        (F.col("l_returnflag") == "A").cast("int").alias("core"),
        (F.col("l_linestatus") == "O").cast("int").alias("policy"),
        (F.col("l_quantity") < 10).cast("int").alias("physical"),
        (F.col("l_quantity") > 40).cast("int").alias("energy"),
        (F.col("l_tax") < 0.02).cast("int").alias("cleantech"),
        (F.col("l_discount") > 0.08).cast("int").alias("activism"),
    )
    tone = F.col("tone")
    share_of = {"policy": "policy", "physical": "physical", "energy": "energy", "cleantech": "cleantech", "activism": "activism"}
    return (
        items.groupBy("day")
        .agg(
            F.count("*").alias("_all"),
            F.sum("a").alias("n_articles_climate"),
            F.sum("core").alias("n_core_climate"),
            F.sum("policy").alias("n_policy_regulation"),
            F.sum("physical").alias("n_physical_risk"),
            F.sum("energy").alias("n_energy_geopolitics"),
            F.sum("cleantech").alias("n_cleantech"),
            F.sum("activism").alias("n_activism_litigation"),
            F.avg(tone).alias("avg_tone"),
            F.avg(F.when(tone > 0, tone)).alias("avg_positivity"),
            F.avg(F.when(tone < 0, F.abs(tone))).alias("avg_negativity"),
            *[F.avg(F.col(c).cast("double")).alias(f"share_{name}") for name, c in share_of.items()],
        )
        .withColumns(
            {
                "news_date": F.date_format("day", "dd/MM/yyyy"),
                "log_n_articles_climate": F.log1p("n_articles_climate"),
                "share_total_climate": F.col("n_articles_climate") / F.col("_all"),
            }
        )
        .drop("day", "_all")
    )


# --- daily text signal with gaps: documents spread over the price days
TEXT_SIGNAL_CTE = """
text_signal as (
  select date '1995-01-01' + cast((doc_id * 7) % 2400 as integer) as day,
    avg((n_chars % 128) / 128.0::double) as climate_prob_mean,
    max((n_chars % 128) / 128.0::double) as climate_prob_max,
    coalesce(stddev_samp((n_chars % 128) / 128.0::double), 0) as climate_prob_std,
    avg(case when (n_chars % 128) / 128.0::double >= 0.5 then 1.0::double else 0 end) as climate_share_bert,
    ln(1 + count(*)) as log_n_articles
  from documents group by 1
)
"""


def text_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    prob = (F.col("n_chars") % 128) / F.lit(128.0)
    offset = ((F.col("doc_id") * 7) % 2400).cast("int")
    day = F.date_add(F.lit("1995-01-01").cast("date"), offset)
    return (
        table(spark, sf_dir, "documents")
        .select(day.alias("news_date"), prob.alias("p"))
        .groupBy("news_date")
        .agg(
            F.avg("p").alias("climate_prob_mean"),
            F.max("p").alias("climate_prob_max"),
            F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("climate_prob_std"),
            F.avg((F.col("p") >= 0.5).cast("double")).alias("climate_share_bert"),
            F.log1p(F.count("*")).alias("log_n_articles"),
        )
    )
