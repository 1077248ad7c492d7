"""The modelling table, imputation, scaling, splits, row windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import numeric
from tidewire.operators import scaling, split
from tidewire.operators.windows import SeriesOrder, row_sequences
from tidewire.plans import market_panel as market
from tidewire.plans import model_table as tables
from tidewire.session import stage_path
from tidewire.sources import models as stored
from tidewire.suite import inputs
from tidewire.suite.market import CURRENT_CTE
from tidewire.suite.registry import query, r6, rounded, table

_BUCKETS = fv.TOPIC_COUNTS
_TOTAL = " + ".join(_BUCKETS)
_ENTROPY = "-(" + " + ".join(
    f"coalesce(({b} / nullif({_TOTAL}, 0)) * ln({b} / nullif({_TOTAL}, 0) + 1e-10), 0)" for b in _BUCKETS
) + ")"
_NEWS = [*fv.NEWS_WITHIN_FEATURES, *fv.NEWS_GLOBAL_FEATURES]

_NEWS_CTE = f"""{inputs.NEWS_DAILY_CTE},
news_features as (
  select news_day as date, * exclude (news_day), {_ENTROPY} as narrative_entropy,
    {', '.join(f'{raw} / nullif(n_articles_climate, 0) as {name}' for name, raw in fv.WITHIN_SHARES.items())}
  from news_daily
)
"""


@query(f"with {_NEWS_CTE} select date, {', '.join(r6(c, c) for c in _NEWS)} from news_features")
def narrative_entropy(spark, sf_dir):
    return rounded(tables.news_features(inputs.news_daily(spark, sf_dir)))


TABLE_CTE = f"""{inputs.PRICE_CTE}, {CURRENT_CTE}, {_NEWS_CTE}, {inputs.TEXT_SIGNAL_CTE},
joined as (
  select m.*, n.* exclude (date), s.* exclude (day), s.climate_prob_mean is not null as has_text_signal
  from model_market m join news_features n on m.date = n.date left join text_signal s on m.date = s.day
  where rvol_22d is not null
),
medians as (
  select {', '.join(f'median({c}) as m_{c}' for c in fv.TEXT_SIGNAL)} from joined
),
model_table as (
  select j.* replace ({', '.join(f'coalesce({c}, m_{c}) as {c}' for c in fv.TEXT_SIGNAL)}) from joined j, medians
)
"""
_MODEL_COLUMNS = [*fv.MARKET_FEATURES, *_NEWS, *fv.TEXT_SIGNAL]


_tables: dict[tuple[str, str], object] = {}


def model_rows(spark, sf_dir, signal=None):
    """Market features with news and the filled text signal; the given tables' own is staged once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if signal is None and key in _tables:
        return _tables[key]
    features = market.model_features(inputs.prices(spark, sf_dir), inputs.SPLIT)
    news = tables.news_features(inputs.news_daily(spark, sf_dir))
    rows = tables.model_table(features, news, inputs.text_signal(spark, sf_dir) if signal is None else signal)
    if signal is None:
        _tables[key] = rows
    return rows


@query(f"""
with {TABLE_CTE}
select date, target_tail, has_text_signal, {', '.join(r6(c, c) for c in _MODEL_COLUMNS)} from model_table
""")
def model_table(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return rounded(rows.select("date", "target_tail", "has_text_signal", *_MODEL_COLUMNS))


@query(f"""
with {TABLE_CTE},
train_medians as (
  select {', '.join(f'median({c}) as m_{c}' for c in fv.TEXT_SIGNAL)} from joined where date < date '1999-01-01'
)
select date, has_text_signal, {', '.join(r6(f'coalesce({c}, m_{c})', c) for c in fv.TEXT_SIGNAL)}
from joined, train_medians
""")
def median_impute(spark, sf_dir):
    """Gaps filled by the median of the training period only."""
    features = market.model_features(inputs.prices(spark, sf_dir), inputs.SPLIT)
    news = tables.news_features(inputs.news_daily(spark, sf_dir))
    filled = tables.model_table(features, news, inputs.text_signal(spark, sf_dir), fit_on=f"date < date'{inputs.SPLIT}'")
    return rounded(filled.select("date", "has_text_signal", *fv.TEXT_SIGNAL))


@query(f"""
with {TABLE_CTE}
select count(*) as n, {r6('avg(has_text_signal::int)', 'coverage')}, {r6('avg(target_tail)', 'tail_rate')} from joined
""")
def signal_coverage(spark, sf_dir):
    return rounded(
        model_rows(spark, sf_dir).agg(
            F.count("*").alias("n"),
            F.avg(F.col("has_text_signal").cast("double")).alias("coverage"),
            F.avg(F.col("target_tail").cast("double")).alias("tail_rate"),
        )
    )


@query(f"""
with {inputs.PRICE_CTE}, {CURRENT_CTE}
select count(*) as n_dropped, min(date) as first, max(date) as last from model_market
where rvol_22d is not null and date not in (select cast(l_shipdate as date) from lineitem)
""")
def dropped_days(spark, sf_dir):
    features = market.model_features(inputs.prices(spark, sf_dir), inputs.SPLIT)
    return tables.dropped_days(features, tables.news_features(inputs.news_daily(spark, sf_dir)))


_SCALED = [*fv.MARKET_FEATURES, *fv.NEWS_GLOBAL_FEATURES]


def _sql_scaled(c: str) -> str:
    train = "filter (where date < date '1999-01-01') over ()"
    dev = f"stddev_pop({c}) {train}"
    return f"({c} - avg({c}) {train}) / case when {dev} = 0 then 1 else {dev} end as {c}"


_SCALED_CTE = f"""{TABLE_CTE},
scaled as (select date, target_tail, {', '.join(_sql_scaled(c) for c in _SCALED)} from model_table)
"""


def _scaled(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    train, _ = split.split_by_date(rows, "date", inputs.SPLIT, inputs.TEST_END)
    return scaling.standardize(rows, train, _SCALED).select("series_id", "date", "target_tail", *_SCALED)


@query(f"with {_SCALED_CTE} select date, target_tail, {', '.join(r6(c, c) for c in _SCALED)} from scaled")
def scaled_features(spark, sf_dir):
    return rounded(_scaled(spark, sf_dir).drop("series_id"))


@query(f"with {_SCALED_CTE} select date, target_tail, {', '.join(r6(c, c) for c in _SCALED)} from scaled")
def scaled_by_stored_statistics(spark, sf_dir):
    """The scaled features once more, by a scaler that was saved and loaded."""
    rows = model_rows(spark, sf_dir)
    train, _ = split.split_by_date(rows, "date", inputs.SPLIT, inputs.TEST_END)
    path = stage_path(spark, "scaler")
    stored.save_scaler(scaling.fit_scaler(train, _SCALED), rows, path, {"until": inputs.SPLIT})
    scaler = stored.load_scaler(spark, path, scored=rows)
    return rounded(scaler.apply(rows).select("date", "target_tail", *_SCALED))


@query(f"""
with {TABLE_CTE}
select case when date < date '1999-01-01' then 'train' else 'test' end as part, count(*) as n,
  min(date) as first, max(date) as last, {r6('avg(target_tail)', 'tail_rate')}
from model_table where date <= date '2001-06-30' group by 1
""")
def date_split(spark, sf_dir):
    train, test = split.split_by_date(model_rows(spark, sf_dir), "date", inputs.SPLIT, "2001-06-30")
    parts = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return rounded(
        parts.groupBy("part").agg(
            F.count("*").alias("n"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
            F.avg(F.col("target_tail").cast("double")).alias("tail_rate"),
        )
    )


@query(f"""
with {TABLE_CTE}
select count(*) filter (where target_tail = 0) as n0, count(*) filter (where target_tail = 1) as n1,
  {r6('count(*) / (2 * count(*) filter (where target_tail = 0))', 'weight0')},
  {r6('count(*) / (2 * count(*) filter (where target_tail = 1))', 'weight1')},
  {r6('count(*) filter (where target_tail = 0) / greatest(count(*) filter (where target_tail = 1), 1)', 'positive_weight')}
from model_table where date < date '1999-01-01'
""")
def class_weights(spark, sf_dir):
    train, _ = split.split_by_date(model_rows(spark, sf_dir), "date", inputs.SPLIT, inputs.TEST_END)
    return rounded(scaling.class_weights(train, "target_tail"))


_SEQUENCE = ["lag1_return", "rvol_5d", "share_policy"]


def _sql_sequences(k: int) -> str:
    return f"""
with {_SCALED_CTE},
cells as (
  select date, target_tail, [{', '.join(_SEQUENCE)}] as cell from scaled
  where {' and '.join(f'{c} is not null' for c in _SCALED)}
),
windows as (
  select date, target_tail, list(cell) over (order by date rows between {k} preceding and 1 preceding) as seq from cells
)
select date, target_tail, len(seq) as window_rows,
  {', '.join(r6(f'seq[{i}][{j}]', f's{i}_{j}') for i in (1, 5, k) for j in (1, 2, 3))},
  {r6('list_sum(flatten(seq))', 'total')}
from windows where len(seq) = {k}
"""


def _sequences(spark, sf_dir, k: int, chunk_rows: int | None = None):
    rows = _scaled(spark, sf_dir).na.drop(subset=_SCALED)
    samples = row_sequences(rows, SeriesOrder(("series_id",), ("date",)), _SEQUENCE, k, chunk_rows=chunk_rows)
    cell = {f"s{i}_{j}": F.col("sequence")[i - 1][j - 1] for i in (1, 5, k) for j in (1, 2, 3)}
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, x: a + x)
    return rounded(
        samples.select(
            "date",
            "target_tail",
            F.size("sequence").cast("bigint").alias("window_rows"),
            *[c.alias(n) for n, c in cell.items()],
            total.alias("total"),
        )
    )


@query(_sql_sequences(10))
def row_sequences_10(spark, sf_dir):
    return _sequences(spark, sf_dir, 10)


@query(_sql_sequences(22))
def row_sequences_22(spark, sf_dir):
    return _sequences(spark, sf_dir, 22)


@query(_sql_sequences(22))
def row_sequences_in_chunks(spark, sf_dir):
    """The same windows where no task holds a whole series."""
    return _sequences(spark, sf_dir, 22, chunk_rows=250)


@query(f"""
with scores as (select vec_id, embedding::double[] as e from embeddings),
shifted as (select vec_id, e, list_transform(e, lambda x: exp(x - list_max(e))) as p from scores)
select vec_id, cast(list_position(e, list_max(e)) - 1 as int) as best,
  {r6('p[1] / list_sum(p)', 'first_share')}, {r6('list_max(p) / list_sum(p)', 'top_share')},
  {r6('1 / (1 + exp(-e[1]))', 'first_sigmoid')}
from shifted
""")
def softmax_argmax(spark, sf_dir):
    scores = F.col("embedding").cast("array<double>")
    shares = numeric.softmax(scores)
    return rounded(
        table(spark, sf_dir, "embeddings").select(
            "vec_id",
            numeric.argmax(scores).alias("best"),
            F.get(shares, F.lit(0)).alias("first_share"),
            F.array_max(shares).alias("top_share"),
            numeric.sigmoid(F.get(scores, F.lit(0))).alias("first_sigmoid"),
        )
    )


@query("""
with draws as (
  select doc_id, quality, md5(concat(doc_id::varchar, '|', '42')) as draw from labels
)
select doc_id, quality,
  row_number() over (partition by quality order by draw) <= ceil(0.2 * count(*) over (partition by quality) - 1e-9) as is_test
from draws
""")
def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return split.stratified_split(labels, "doc_id", "quality", 0.2, seed=42)


@query("""
with draws as (
  select l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as item, l_returnflag,
    md5(concat((l_orderkey * 1000000 + l_partkey * 10 + l_linenumber)::varchar, '|7')) as draw
  from lineitem
),
marked as (
  select *, row_number() over (partition by l_returnflag order by draw) <= ceil(0.36 * count(*) over (partition by l_returnflag) - 1e-9) as is_test
  from draws
)
select l_returnflag, is_test, count(*) as n, cast(sum(item % 1000003) as bigint) as checksum from marked group by all
""")
def stratified_split_large(spark, sf_dir):
    """The same split where every label holds a third of all rows."""
    item = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(item.alias("item"), "l_returnflag")
    marked = split.stratified_split(rows, "item", "l_returnflag", 0.36, seed=7)
    return marked.groupBy("l_returnflag", "is_test").agg(
        F.count("*").alias("n"), F.sum(F.col("item") % 1000003).alias("checksum")
    )
