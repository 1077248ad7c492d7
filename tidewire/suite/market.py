"""Market panels for one series, many series and very long series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators.summaries import null_counts
from tidewire import fixed_values as fv
from tidewire.plans import market_panel as market
from tidewire.suite import inputs
from tidewire.suite.registry import query, r6, rounded, table

_PREDICTORS = fv.PREDICTORS


def _rolling(fn: str, k: int, name: str, last: str, window: str = "w") -> str:
    first = k if last == "1 preceding" else k - 1
    frame = f"({window} rows between {first} preceding and {last})"
    return f"case when count(log_return) over {frame} = {k} then {fn}(log_return) over {frame} end as {name}"


def _panel_cte(keys: str) -> str:
    part = f"partition by {keys} " if keys else ""
    key = f"{keys}, " if keys else ""
    past = "1 preceding"
    rolling = [_rolling("stddev_samp", k, f"rv_{k}", past) for k in (5, 10, 22)]
    rolling += [_rolling("avg", k, f"ret_mean_{k}", past) for k in (5, 10)]
    on = f"using ({keys})" if keys else "on true"
    group = f"group by {keys}" if keys else ""
    return f"""
logged as (
  select {key}date, wti_price, wti_price > 0 as price_valid_for_log,
    case when wti_price > 0 then ln(wti_price) end as log_price from prices
),
returns as (
  select *, log_price - lag(log_price) over ({part}order by date) as log_return from logged
),
features as (
  select *, lag(log_return) over w as ret_lag1, lag(abs(log_return)) over w as abs_ret_lag1,
    {', '.join(rolling)}, lead(log_return) over w as ret_t_plus_1
  from returns window w as ({part}order by date)
),
threshold as (
  select {key}quantile_cont(ret_t_plus_1, 0.1) as tail_threshold_train from features
  where date <= date '1999-12-31' {group}
),
panel as (
  select f.*, t.tail_threshold_train, strftime(f.date, '%Y-%m-%d') as day,
    case when f.ret_t_plus_1 < t.tail_threshold_train then 1 else 0 end as target_tail_t_plus_1,
    {' and '.join(f'f.{c} is not null' for c in _PREDICTORS)} as usable_for_model
  from features f left join threshold t {on}
)
"""


_ROUNDED = ["wti_price", "log_price", "log_return", *_PREDICTORS, "tail_threshold_train"]
_PANEL_COLUMNS = (
    "day, date, price_valid_for_log, target_tail_t_plus_1, usable_for_model, "
    + ", ".join(r6(c, c) for c in _ROUNDED)
)


@query(f"with {inputs.PRICE_CTE}, {_panel_cte('')} select {_PANEL_COLUMNS} from panel")
def market_panel(spark, sf_dir):
    panel = market.market_panel(inputs.prices(spark, sf_dir), inputs.TRAIN_END)
    return rounded(panel.drop("series_id"))


@query(f"with {inputs.SERIES_CTE}, {_panel_cte('series_id')} select series_id, {_PANEL_COLUMNS} from panel")
def market_panel_multi(spark, sf_dir):
    return rounded(market.market_panel(inputs.series_prices(spark, sf_dir), inputs.TRAIN_END))


_ITEM_WINDOW = "partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""
with returns as (
  select *, ln(l_extendedprice) - lag(ln(l_extendedprice)) over ({_ITEM_WINDOW}) as log_return from lineitem
)
select l_returnflag as series_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {r6('log_return', 'log_return')},
  {r6('lag(abs(log_return)) over w', 'abs_ret_lag1')},
  {r6("case when count(log_return) over (w rows between 22 preceding and 1 preceding) = 22 then stddev_samp(log_return) over (w rows between 22 preceding and 1 preceding) end", 'rv_22')},
  {r6("case when count(log_return) over (w rows between 10 preceding and 1 preceding) = 10 then avg(log_return) over (w rows between 10 preceding and 1 preceding) end", 'ret_mean_10')},
  {r6('lead(log_return) over w', 'ret_t_plus_1')}
from returns window w as ({_ITEM_WINDOW})
""")
def long_series_in_chunks(spark, sf_dir):
    """Three series that each hold a third of all line items, cut into chunks."""
    order = ("date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        *order[1:],
        F.col("l_extendedprice").alias("wti_price"),
    )
    chunks = market.Chunks(rows=4096)
    features = market.return_features(items, chunks=chunks, order=order)
    return rounded(
        features.select(
            "series_id", *order[1:], "log_return", "abs_ret_lag1", "rv_22", "ret_mean_10", "ret_t_plus_1"
        )
    )


def _current_cte() -> str:
    rolling = [_rolling("stddev_samp", k, f"rvol_{k}d", "current row") for k in (5, 10, 22)]
    rolling += [_rolling("avg", k, f"ret_mean_{k}d", "current row") for k in (5, 10)]
    return f"""
ratios as (
  select *, wti_price / nullif(lag(wti_price) over (order by date), 0) as ratio from prices
),
returns as (select date, wti_price, case when ratio > 0 then ln(ratio) end as log_return from ratios),
features as (
  select *, lag(log_return) over w as lag1_return, lag(abs(log_return)) over w as lag1_abs_return,
    {', '.join(rolling)}, lead(log_return) over w as next_return
  from returns window w as (order by date)
),
threshold as (select quantile_cont(log_return, 0.1) as thr from features where date < date '1999-01-01'),
model_market as (
  select f.* exclude (next_return), thr as tail_threshold_train,
    case when next_return < thr then 1 else 0 end as target_tail
  from features f, threshold
)
"""


CURRENT_CTE = _current_cte()
_CURRENT = ["wti_price", "log_return", "lag1_return", "lag1_abs_return", "rvol_5d", "rvol_10d", "rvol_22d",
            "ret_mean_5d", "ret_mean_10d", "tail_threshold_train"]


@query(f"""
with {inputs.PRICE_CTE}, {CURRENT_CTE}
select date, target_tail, {', '.join(r6(c, c) for c in _CURRENT)} from model_market
""")
def market_features_current(spark, sf_dir):
    return rounded(market.model_features(inputs.prices(spark, sf_dir), inputs.SPLIT).drop("series_id"))


@query(f"""
with {inputs.SERIES_CTE}, {_panel_cte('series_id')}
select series_id, {r6('tail_threshold_train', 'bounded')}, {r6('tail_threshold_train', 'unbounded')} from threshold
""")
def tail_threshold(spark, sf_dir):
    """The training quantile per series by both ways of computing it."""
    features = market.return_features(inputs.series_prices(spark, sf_dir)).select("series_id", "date", "ret_t_plus_1")
    one = market.tail_threshold(features, inputs.TRAIN_END, 0.1).withColumnRenamed("tail_threshold_train", "bounded")
    two = market.tail_threshold(features, inputs.TRAIN_END, 0.1, bounded=False)
    return rounded(one.join(two.withColumnRenamed("tail_threshold_train", "unbounded"), "series_id"))


_NULLS = [*_PREDICTORS, "target_tail_t_plus_1"]


@query(f"""
with {inputs.PRICE_CTE}, {_panel_cte('')}
select {', '.join(f'cast(count(*) filter (where {c} is null) as bigint) as {c}' for c in _NULLS)} from panel
""")
def panel_null_counts(spark, sf_dir):
    return null_counts(market.market_panel(inputs.prices(spark, sf_dir), inputs.TRAIN_END), _NULLS)


@query(f"""
with {inputs.SERIES_CTE}, {_panel_cte('series_id')}
select series_id, count(*) as n_rows, count(*) filter (where usable_for_model) as n_usable,
  count(*) filter (where wti_price <= 0) as n_non_positive,
  min(date) as first_date, max(date) as last_date,
  {r6('min(wti_price)', 'min_price')}, {r6('max(wti_price)', 'max_price')},
  {r6('min(tail_threshold_train)', 'tail_threshold')},
  {r6('avg(target_tail_t_plus_1)', 'tail_rate')}
from panel group by series_id
""")
def panel_profile(spark, sf_dir):
    return rounded(market.panel_profile(market.market_panel(inputs.series_prices(spark, sf_dir), inputs.TRAIN_END)))


@query(f"with {inputs.PRICE_CTE} select date, wti_price from prices where wti_price <= 0")
def non_positive_prices(spark, sf_dir):
    return inputs.prices(spark, sf_dir).filter(F.col("wti_price") <= 0).select("date", "wti_price")


@query(f"""
with {inputs.PRICE_CTE}, {_panel_cte('')}
select date, {r6('wti_price', 'wti_price')}, price_valid_for_log, {r6('log_price', 'log_price')},
  {r6('log_return', 'log_return')}, usable_for_model
from panel where date between date '1998-04-01' and date '1998-04-30'
""")
def panel_date_slice(spark, sf_dir):
    panel = market.market_panel(inputs.prices(spark, sf_dir), inputs.TRAIN_END)
    days = F.col("date").between(F.lit("1998-04-01").cast("date"), F.lit("1998-04-30").cast("date"))
    return rounded(
        panel.filter(days).select("date", "wti_price", "price_valid_for_log", "log_price", "log_return", "usable_for_model")
    )
