"""Readers and writers: partitioned folders, shards, CSV, resume, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.session import stage_path
from tidewire.sources import resume, tables
from tidewire.streaming.incremental import run_incremental
from tidewire.suite import inputs
from tidewire.suite.articles import _PAGES_CTE
from tidewire.suite.registry import query, r6, rounded, table, text_table


@query(f"""
with {inputs.EVENT_ARTICLES_CTE}
select news_date as ingest_date, count(*) as n,
  count(*) filter (where themes = 'business_climate;carbon') as n_excluded
from articles where news_date between date '2024-01-10' and date '2024-01-19' group by 1
""")
def partitioned_scan(spark, sf_dir):
    """Write by ingest day, read back a range of days: only their folders are opened."""
    path = stage_path(spark, "gkg")
    tables.write_parquet(inputs.gkg_articles(spark, sf_dir), path, ["ingest_date"])
    first, last = (F.lit(d).cast("date") for d in ("2024-01-10", "2024-01-19"))
    return (
        tables.read_parquet(spark, path, schema=tables.GKG_ARTICLES)
        .filter(F.col("ingest_date").between(first, last))
        .groupBy("ingest_date")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.lower("V2Themes") == "business_climate;carbon").alias("n_excluded"),
        )
    )


@query("""
select year(o_orderdate) as year, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum
from orders where year(o_orderdate) between 1996 and 1998 group by 1
""")
def year_shards(spark, sf_dir):
    """One folder per year; a year range reads only its folders."""
    path = stage_path(spark, "orders")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(F.col("o_orderdate").cast("date")).alias("year")
    )
    tables.write_parquet(orders, path, ["year"])
    return (
        tables.read_parquet(spark, path, schema="o_orderkey bigint, year int")
        .filter(F.col("year").between(1996, 1998))
        .groupBy("year")
        .agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))
    )


@query("select doc_id, md5(text) as digest, lang, source from documents")
def shard_union(spark, sf_dir):
    """Shards written apart and read as one table."""
    documents = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text", "lang", "source")
    base = stage_path(spark, "shards")
    blocks = {"p1": ["en"], "p2": ["fr"], "p3": ["de"]}
    known = [lang for langs in blocks.values() for lang in langs]
    parts = {name: F.col("lang").isin(langs) for name, langs in blocks.items()}
    parts["p4"] = ~F.coalesce(F.col("lang").isin(known), F.lit(False))
    for name, block in parts.items():
        tables.write_parquet(documents.filter(block), f"{base}/{name}")
    schema = "doc_id bigint, text string, lang string, source string"
    shards = tables.read_parquet(spark, *[f"{base}/{name}" for name in parts], schema=schema)
    return shards.select("doc_id", F.md5("text").alias("digest"), "lang", "source")


@query("""
select 'benchmark' as origin, item_id as id, md5(text) as digest from benchmark
union all select 'document', doc_id, md5(text) from documents
union all select 'turn', conv_id * 1000 + turn, md5(text) from conversations
""")
def union_by_name(spark, sf_dir):
    def part(name: str, origin: str, key):
        return table(spark, sf_dir, name).select(
            F.lit(origin).alias("origin"), key.alias("id"), F.md5("text").alias("digest")
        )

    turn_id = F.col("conv_id") * 1000 + F.col("turn")
    return (
        part("benchmark", "benchmark", F.col("item_id"))
        .unionByName(part("documents", "document", F.col("doc_id")))
        .unionByName(part("conversations", "turn", turn_id))
    )


@query(f"""
with {inputs.ARTICLE_CTE}
select doc_id, md5(text) as digest, url, news_date, {r6('tone_score', 'tone_score')}, is_core_climate, extract_success
from article_text
""")
def csv_roundtrip(spark, sf_dir):
    """Texts with quotes and line ends survive a CSV file."""
    rows = inputs.article_text(spark, sf_dir).select(
        "doc_id", "text", "url", "news_date", "tone_score", "is_core_climate", "extract_success"
    )
    path = stage_path(spark, "articles-csv")
    tables.write_csv(rows, path)
    back = tables.read_csv(spark, path, rows.schema)
    return rounded(back.withColumn("digest", F.md5("text")).drop("text"))


@query("""
select o_orderkey, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 as rejected,
  case when o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 then round(o_totalprice, 2) + 0.0::double end as price,
  case when o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as day
from orders
""")
def csv_rejects(spark, sf_dir):
    """All orders through CSV, some with a price or a day that is none: those records are set apart, whole and readable."""
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("double").cast("string"))
    day = F.when(key % 11 == 0, "no day").otherwise(F.col("o_orderdate").cast("date").cast("string"))
    path = stage_path(spark, "orders-csv")
    tables.write_csv(table(spark, sf_dir, "orders").select(key, price.alias("price"), day.alias("day")), path)
    good, rejected = tables.read_csv_checked(spark, path, "o_orderkey bigint, price double, day date")
    back = F.regexp_extract("line", r'^"(\d+)",', 1).cast("long")
    parts = good.withColumn("rejected", F.lit(False)).unionByName(
        rejected.select(back.alias("o_orderkey"), F.lit(True).alias("rejected")), allowMissingColumns=True
    )
    return rounded(parts.select("o_orderkey", "rejected", "price", "day"), 2)


_TODO_CTE = f"""{_PAGES_CTE},
todo as (
  select page_id, strftime(date '2024-01-01' + cast(page_id % 30 as integer), '%Y-%m-%d') as news_date, url_norm
  from pages_norm
)
"""


def _todo(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int"))
    return text_table(spark, sf_dir, "pages", "page_id").select(
        "page_id", F.date_format(day, "yyyy-MM-dd").alias("news_date"), urls.normalize_url(F.col("url")).alias("url_norm")
    )


@query(f"""
with {_TODO_CTE}, done as (select news_date, url_norm from todo where starts_with(url_norm, 'https'))
select page_id, news_date, url_norm from todo t
where not exists (select 1 from done d where d.news_date = t.news_date and d.url_norm = t.url_norm)
""")
def resume_antijoin(spark, sf_dir):
    todo = _todo(spark, sf_dir)
    return resume.remaining(todo, todo.filter(F.startswith("url_norm", F.lit("https"))))


@query(f"""
with {_TODO_CTE}
select news_date, url_norm, count(*) as n, min(page_id) as page_id from todo
group by news_date, url_norm
""")
def resumed_append(spark, sf_dir):
    """Three runs over overlapping lists: every key is written once."""
    path = stage_path(spark, "resumed")
    todo = _todo(spark, sf_dir)
    counted = todo.groupBy("news_date", "url_norm").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id"))
    for part in (counted.filter(F.startswith("url_norm", F.lit("https"))), counted, counted):
        resume.append_remaining(part, path)
    return tables.read_parquet(spark, path, schema=counted.schema)


@query(f"with {_TODO_CTE} select news_date, url_norm, min(page_id) as page_id from todo group by news_date, url_norm")
def incremental_append(spark, sf_dir):
    """Files that arrive one after the other, processed by a file stream."""
    source, target, progress = (stage_path(spark, label) for label in ("arriving", "collected", "progress"))
    todo = _todo(spark, sf_dir)
    early = F.col("news_date") < "2024-01-16"
    for part in (todo.filter(early), todo.filter(~early)):
        part.write.mode("append").parquet(source)
        stream = run_incremental(
            spark, source, todo.schema, target, progress,
            lambda batch: batch.groupBy("news_date", "url_norm").agg(F.min("page_id").alias("page_id")),
        )
        stream.awaitTermination()
    return tables.read_parquet(spark, target, schema="news_date string, url_norm string, page_id bigint")


@query(f"""
with {_PAGES_CTE}
select min(page_id) as page_id, cast(2024 as int) as year, news_date, url_norm, domain from (
  select *, strftime(date '2024-01-01' + cast(page_id % 30 as integer), '%Y-%m-%d') as news_date from pages_norm)
group by news_date, url_norm, domain
""")
def url_sample(spark, sf_dir):
    """The checked, normalised and de-duplicated URL list."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int"))
    pages = text_table(spark, sf_dir, "pages", "page_id").select(
        "page_id",
        F.lit(2024).alias("year"),
        F.date_format(day, "yyyy-MM-dd").alias("news_date"),
        F.concat(F.lit(" "), "url", F.lit(" ")).alias("url"),
        *[F.lit(None).cast("string").alias(c) for c in ("event_timestamp", "source")],
        *[F.lit(None).cast("double").alias(c) for c in ("tone_score", "priority_score")],
        *[F.lit(0).alias(c) for c in tables.fv.TOPIC_FLAGS],
        F.lit(0).alias("n_active_buckets"),
    )
    kept = tables.load_url_sample(pages, "page_id", 2024, 2024)
    return kept.select("page_id", "year", "news_date", "url_norm", "domain")


@query(f"""
with {_TODO_CTE}
select unnest(['rows', 'secure', 'rooted', 'early']) as counter, unnest([count(*), count(*) filter (where starts_with(url_norm, 'https')),
  count(*) filter (where ends_with(url_norm, '/')), count(*) filter (where news_date < '2024-01-16')]) as n
from todo
""")
def counted_write(spark, sf_dir):
    """Counters taken by the tasks that write the day folders."""
    url = F.col("url_norm")
    conditions = {"secure": url.startswith("https"), "rooted": url.endswith("/"), "early": F.col("news_date") < "2024-01-16"}
    found = tables.write_counted(_todo(spark, sf_dir), stage_path(spark, "counted"), conditions, ["news_date"])
    return spark.createDataFrame(list(found.items()), "counter string, n bigint")
