"""Table contracts, readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire import fixed_values as fv
from tidewire.functions import text, urls
from tidewire.operators.dedup import keep_first
from tidewire.session import staged

GKG_ARTICLES = (
    "DATE bigint, DocumentIdentifier string, SourceCommonName string, V2Themes string, V2Tone string, ingest_date date"
)
PRICE_RAW = "observation_date string, DCOILWTICO string"
URL_SAMPLE = (
    "year int, news_date string, event_timestamp string, url string, source string, tone_score double, "
    + ", ".join(f"{c} int" for c in fv.TOPIC_FLAGS)
    + ", n_active_buckets int, priority_score double"
)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail while planning, with all missing names at once."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    return df


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def select_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*present(df, columns))


def read_parquet(spark: SparkSession, *paths: str, schema: str | T.StructType | None = None, merge: bool = False) -> DataFrame:
    """One or many Parquet folders as one table."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mergeSchema", merge).parquet(*paths)


def spread(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """Deal a badly laid out file to ``tasks`` tasks; None leaves the scan's own splits.

    A file of one row group is one task however large the cluster is. That is for the
    caller to know: this costs a shuffle of the whole table, so it is never guessed
    from sizes.
    """
    return df.repartition(tasks, key) if tasks else df


_REJECTED = "_rejected_line"


def _csv_reader(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV with header; quoted fields may hold quotes and line ends.

    Such a file cannot be split, so it is one task: for exchange with other programs.
    Between stages use Parquet. Fields that do not fit the schema are null; see
    `read_csv_checked`.
    """
    return _csv_reader(spark).schema(schema).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and the others as they stand: ``source_file, line``.

    A record with too few or too many fields, or with a field of another type, is
    rejected whole. The files are parsed once and both parts written: which records fit
    must not depend on the columns that a later query happens to read.
    """
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*wanted.fields, T.StructField(_REJECTED, T.StringType())])
    reader = _csv_reader(spark).schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _REJECTED)
    parsed = staged(reader.csv(path).withColumn("source_file", F.input_file_name()), "csv-records")
    good = parsed.filter(F.col(_REJECTED).isNull()).drop(_REJECTED, "source_file")
    line = F.regexp_replace(_REJECTED, r"\r?\n$", "")
    return good, parsed.filter(F.col(_REJECTED).isNotNull()).select("source_file", line.alias("line"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write rows; with partition columns every folder gets its rows from few tasks.

    The rebalance lets adaptive execution split a folder that holds much of the
    table and merge small ones, instead of one task per folder value.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_counted(
    df: DataFrame, path: str, counts: Mapping[str, Column], partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> dict[str, int]:
    """Write rows as ``write_parquet`` does and return how many met each condition, without a second pass.

    The counters are observed in the very tasks that write, behind every shuffle, where
    Spark takes the first finished attempt of a task and no other. A condition that is
    null does not count. ``rows`` is the name of the counter of all rows.
    """
    if "rows" in counts:
        raise ValueError("rows is the name of the counter of all rows")
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(name) for name, c in counts.items())]
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.observe(seen, *measures).write.mode(mode).partitionBy(*partition_by).parquet(path)
    found = seen.get
    return {name: int(found.get(name) or 0) for name in ("rows", *counts)}


def write_outputs(parent: DataFrame, path: str, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], as_csv: Sequence[str] = ()) -> None:
    """Several tables from one parent, which is computed once: each goes to a folder of its name.

    Outputs named in ``as_csv`` are written as CSV, the others as Parquet.
    """
    once = staged(parent, "parent")
    for name, make in outputs.items():
        if name in as_csv:
            write_csv(make(once), f"{path}/{name}")
        else:
            write_parquet(make(once), f"{path}/{name}")


def load_url_sample(df: DataFrame, id_col: str, first_year: int, last_year: int) -> DataFrame:
    """The checked and normalised URL list, first row per day and URL."""
    require_columns(df, fv.URL_SAMPLE_COLUMNS)
    rows = (
        df.filter(F.col("year").between(first_year, last_year))
        .na.drop(subset=["url"])
        .withColumn("url", text.strip(F.col("url")))
    )
    if "url_norm" not in df.columns:
        rows = rows.withColumn("url_norm", urls.normalize_url(F.col("url")))
    kept = keep_first(rows, id_col, [{"date": F.col("news_date"), "url": F.col("url_norm")}])
    return kept.withColumn("domain", urls.domain_of(F.col("url")))
