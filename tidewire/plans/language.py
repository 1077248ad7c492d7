"""Language of a text from word profiles fitted on labelled texts.

Two forms. A profile of all words is a table, and scoring is a join that moves the
words that are not frequent. A profile of slots is one row: words are hashed into a fixed
number of slots, a language has one array of weights, and a text is scored where it
lies, without a shuffle. Words that share a slot share its weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import staged


def words(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}+"), F.lit(0))


def fit_profiles(df: DataFrame, text_col: str, lang_col: str, languages: Sequence[str]) -> DataFrame:
    """Log weights per word and language, for all words: ``word`` and one column per language.

    Counts are taken in one pass and written once; the totals and the weights read them.
    """
    labelled = df.filter(F.col(lang_col).isin(list(languages))).withColumnRenamed(lang_col, "lang")
    counts = labelled.select("lang", F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(
        *[F.count_if(F.col("lang") == x).alias(x) for x in languages]
    )
    table = staged(counts, "profile-counts")
    totals = table.agg(F.struct(F.count("*").alias("_words"), *[F.sum(x).alias(x) for x in languages]).alias("t"))
    smoothed = table.withColumn("_t", totals.scalar())
    weighted = smoothed.select(
        "word", *[F.ln((F.col(x) + 1) / (F.col(f"_t.{x}") + F.col("_t._words"))).alias(x) for x in languages]
    )
    return weighted


#: A word counts as frequent if it makes up at least one in so many of what a language's weights share out.
FREQUENT = 1 << 16


def detect_language(df: DataFrame, id_col: str, text_col: str, profiles: DataFrame) -> DataFrame:
    """``id_col, lang`` for every row; ``unknown`` where no profile word occurs.

    Whole texts count. A profile has as many rows as there are words. Its frequent words,
    at most FREQUENT per language as shares add up to one, are broadcast, so most words are
    summed where their text lies and leave one row per text for the shuffle. Only the
    others are moved to the rest of the profile, a join left to adaptive execution.
    """
    languages = [c for c in profiles.columns if c != "word"]
    often = F.array_max(F.array(*languages)) >= -math.log(FREQUENT)
    frequent, rest = F.broadcast(profiles.filter(often)), profiles.filter(~often)
    found = df.select(id_col, F.explode(words(F.col(text_col))).alias("word"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(id_col).agg(*[F.sum(x).alias(x) for x in languages])

    others = found.join(frequent.select("word"), "word", "left_anti")
    parts = summed(found.join(frequent, "word")).unionByName(summed(others.join(rest, "word")))
    sums = parts.groupBy(id_col).agg(*[F.round(F.sum(x), 6).alias(x) for x in languages])
    scores = F.array(*[F.col(x) for x in languages])
    names = F.array(*[F.lit(x) for x in languages])
    best = F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    return df.select(id_col).join(sums.select(id_col, best.alias("lang")), id_col, "left").select(id_col, F.coalesce("lang", F.lit("unknown")).alias("lang"))


#: Slots of a profile; eight bytes each and language, so four languages are a row of 2 MB.
SLOTS = 1 << 16
#: Weights of slots are whole numbers of this many parts: sums are the same in every order.
PARTS = 1_000_000


def crc32_slot(word: Column, slots: Column) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), slots).cast("int")


def md5_slot(word: Column, slots: Column) -> Column:
    """A slot that other SQL engines can compute as well; dearer than crc32."""
    return F.pmod(F.conv(F.substr(F.md5(word), F.lit(1), F.lit(8)), 16, 10).cast("long"), slots).cast("int")


def fit_slots(
    df: DataFrame,
    text_col: str,
    lang_col: str,
    languages: Sequence[str],
    slots: int = SLOTS,
    slot_of: Callable[[Column, Column], Column] = crc32_slot,
) -> DataFrame:
    """One row, an array of log weights per language in the order of the slots.

    A weight is ln((n + 1) / (words of the language + slots in use)) in whole parts
    of `PARTS`; slots without a labelled word weigh 0 in all languages. Rows of other
    languages, and null texts, teach nothing. Partial aggregates leave at most
    ``slots`` rows per task for the shuffle, and the last task holds ``slots`` rows.
    """
    labelled = df.filter(F.col(lang_col).isin(list(languages))).withColumnRenamed(lang_col, "lang")
    found = labelled.select("lang", F.explode(words(F.col(text_col))).alias("word"))
    counts = found.groupBy(slot_of(F.col("word"), F.lit(slots)).alias("slot")).agg(
        *[F.count_if(F.col("lang") == x).alias(x) for x in languages]
    )
    table = staged(counts, "slot-counts")
    totals = table.agg(F.struct(F.count("*").alias("_used"), *[F.sum(x).alias(x) for x in languages]).alias("t"))
    weight = {x: F.round(F.ln((F.col(x) + 1) / (F.col(f"_t.{x}") + F.col("_t._used"))) * PARTS).cast("long") for x in languages}
    every = df.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    by_slot = every.join(table, "slot", "left").withColumn("_t", totals.scalar())
    cells = by_slot.select(F.struct("slot", *[F.coalesce(w, F.lit(0)).alias(x) for x, w in weight.items()]).alias("cell"))
    row = cells.agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return staged(row.select(*[F.col(f"cells.{x}").alias(x) for x in languages]), "slot-weights")


def language_in_row(
    df: DataFrame,
    text_col: str,
    profile: DataFrame,
    slot_of: Callable[[Column, Column], Column] = crc32_slot,
    name: str = "lang",
) -> DataFrame:
    """All rows and columns with the best language, the first of the profile on ties.

    ``unknown`` where the text is null or no word of it lies in a slot in use. The
    profile is one row of fixed size, so texts are not moved; ``slot_of`` must be that
    of the fit.
    """
    languages = profile.columns
    # the row comes to the driver, its size is fixed by the slots, and goes into the plan as constants:
    # a joined or scalar column would be copied into every row
    row = profile.select(*[F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in languages]).first()
    weights = {x: F.split(F.lit(row[x]), ",").cast("array<int>") for x in languages}
    slots = F.lit(row[languages[0]].count(",") + 1)
    hashed = df.withColumn("_slots", F.transform(words(F.col(text_col)), lambda w: slot_of(w, slots)))

    def total(x: str) -> Column:
        return F.aggregate("_slots", F.lit(0).cast("long"), lambda acc, i: acc + F.get(weights[x], i))

    scored = hashed.withColumn("_scores", F.array(*[total(x) for x in languages]))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.element_at(names, F.array_position("_scores", F.array_max("_scores")).cast("int"))
    # weights of slots in use are below 0, so a sum of 0 says that none was met
    known = F.array_max("_scores") < 0
    return scored.withColumn(name, F.when(known, best).otherwise("unknown")).drop("_slots", "_scores")
