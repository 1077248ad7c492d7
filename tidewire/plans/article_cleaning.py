"""Two cleaning passes over extracted article texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import fixed_values as fv
from tidewire.functions import text, urls
from tidewire.operators.dedup import distinct_counts, first_ids
from tidewire.session import staged
from tidewire.sources.tables import require_columns, select_present


def usable_extracts(df: DataFrame) -> DataFrame:
    """Rows with a text from a download that worked; each rule needs its column."""
    require_columns(df, ["text"])
    if "extract_success" in df.columns:
        df = df.filter(F.col("extract_success"))
    if "extract_method" in df.columns:
        failed = F.contains(F.lower(F.col("extract_method")), F.lit(fv.DOWNLOAD_FAILED))
        df = df.filter(~F.coalesce(failed, F.lit(False)))
    return df.filter(F.col("text").isNotNull())


def with_quality(df: DataFrame, column: str = "text_clean") -> DataFrame:
    """Length, letter, Latin and noise ratios, and the flag made from them."""
    value = F.col(column)
    measured = df.withColumns(
        {
            "text_len_clean": F.length(value),
            "alpha_ratio": text.alpha_ratio(value),
            "latin_ratio": text.latin_ratio(value),
            "weird_char_ratio": text.noise_ratio(value),
        }
    )
    return measured.withColumn("quality_flag", text.quality_flag(F.col("alpha_ratio"), F.col("weird_char_ratio")))


def clean_pass1(
    df: DataFrame,
    id_col: str,
    languages: Callable[[DataFrame], DataFrame] | None = None,
    min_chars: int = fv.MIN_CLEAN_CHARS,
    with_language: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Clean, drop short texts, keep first per URL and per text, measure, flag English.

    Winners are found on ids and digests; only their rows are cleaned and measured, once.
    ``languages`` maps the surviving rows to ``id_col, lang``, which are joined back;
    ``with_language`` sets ``lang`` in the rows themselves and moves no text. Without
    either the table must have a ``lang`` column. Tone is carried through when present.
    """
    usable = usable_extracts(df)
    cleaned = usable.withColumn("text_clean", text.clean_article(F.col("text")))
    steps: list[Mapping[str, Column]] = []
    url_key = next((c for c in ("url_norm", "url") if c in df.columns), None)
    if url_key:
        steps.append({"url": F.col(url_key)})
    steps.append({"text": text.text_digest(F.col("text_clean"))})
    winners = first_ids(cleaned, id_col, steps, F.length("text_clean") >= min_chars)
    survivors = usable.join(winners, id_col, "left_semi")
    # written once: languages and flags read the cleaned texts, and none of them cleans again
    rows = staged(with_quality(survivors.withColumn("text_clean", text.clean_article(F.col("text")))), "survivors")
    if with_language is not None:
        rows = with_language(rows.drop("lang"))
    elif languages is not None:
        rows = rows.drop("lang").join(languages(rows), id_col, "left")
        rows = rows.withColumn("lang", F.coalesce(F.col("lang"), F.lit("unknown")))
    english = text.is_english(F.col("lang"), F.col("latin_ratio"), F.col("quality_flag"))
    return select_present(rows.withColumn("is_english", english), [id_col, *fv.CLEAN_ARTICLE_COLUMNS])


def pass2_rule(
    blocked: Sequence[str] = fv.BLOCKED_DOMAINS,
    min_chars: int = fv.MIN_CLEAN_CHARS,
    max_chars: int = fv.MAX_CLEAN_CHARS,
    junk_words: Mapping[str, int] = fv.JUNK_WORDS,
    max_separators: int = fv.MAX_SEPARATORS,
) -> Column:
    """The first rule a repaired row breaks, or ``kept``."""
    value = F.col("text_clean")
    junk = text.has_junk(value, junk_words, max_separators=max_separators)
    return (
        F.when(urls.is_navigation(F.col("url")), "navigation_url")
        .when(F.coalesce(F.col("domain"), F.lit("")).isin(list(blocked)), "blocked_domain")
        .when(~F.coalesce(F.length(value).between(min_chars, max_chars), F.lit(False)), "length")
        .when(junk, "junk")
        .otherwise("kept")
    )


def repaired(df: DataFrame) -> DataFrame:
    return df.withColumn("text_clean", text.fix_encoding(F.col("text_clean")))


def clean_pass2(df: DataFrame, id_col: str, **limits) -> DataFrame:
    """Repair wrong decodings, drop rows that break a rule, keep first per text."""
    key = {"text": text.text_digest(F.col("text_clean"))}
    winners = first_ids(repaired(df), id_col, [key], pass2_rule(**limits) == "kept")
    return repaired(df.join(winners, id_col, "left_semi"))


def removed_by_rule(df: DataFrame, **limits) -> DataFrame:
    """Rows per first broken rule, plus duplicates and what is left, in one pass."""
    rows = repaired(df).withColumn("_rule", pass2_rule(**limits))
    key = F.when(F.col("_rule") == "kept", text.text_digest(F.col("text_clean")))
    counts = distinct_counts(rows, key, F.col("_rule"), "rule")
    kept = F.col("rule") == "kept"
    split = F.when(
        kept,
        F.array(
            F.struct(F.lit("kept").alias("rule"), F.col("n_distinct").alias("n")),
            F.struct(F.lit("duplicate").alias("rule"), (F.col("n_rows") - F.col("n_distinct")).alias("n")),
        ),
    ).otherwise(F.array(F.struct(F.col("rule").alias("rule"), F.col("n_rows").alias("n"))))
    return counts.select(F.explode(split).alias("r")).select("r.rule", "r.n").filter("n > 0")
