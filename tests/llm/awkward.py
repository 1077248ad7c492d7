"""Small tables with everything that may go wrong in a row."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

EXTRA = {"id": "x", "h": 1, "line": 2, "doc": "d", "found": None, "score": 0.5, "rank": 3, "component": 4, "key": "k", "shard": 9, "bucket": 1, "band_0": 0, "label": 1, "n": 7, "size": 1}
_EXTRA_TYPES = "id string, h long, line int, doc string, found string, score double, rank int, component long, key string, shard int, bucket int, band_0 long, label int, n int, size int"


def sentence(rng: random.Random, words: int = 30) -> str:
    return " ".join("".join(rng.choice("aeioustnrl") for _ in range(rng.randint(3, 8))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    base = sentence(rng, 60)
    near = " ".join([*base.split(" ")[:-2], "other", "end"])
    return [
        (1, base),
        (2, near),
        (3, base),
        (4, base.upper()),
        (5, None),
        (6, ""),
        (7, "   \n\t "),
        (8, "ab"),
        (9, "\x1c.,;!"),
        (10, "日本語 ñandú ΑΣ İx é <|endoftext|> don't"),
        (11, sentence(rng, 20_000)),
        (12, "x" * 300_000),
        (None, base),
        (None, "loose row"),
        (13, "line one of five words here\n\nline two of five words here\nab"),
        (14, "zz\nline one of five words here\n\nline two of five words here"),
        (15, "same words in this line\nsame words in this line\nsame words in this line"),
        (16, sentence(rng)),
        (16, sentence(rng)),
        (1, base),
    ]


def documents(spark: SparkSession) -> DataFrame:
    """Null ids and texts, empty and very long texts, repeated rows, one id with two texts, and extra columns."""
    rows = [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else "src", None, *EXTRA.values()) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {_EXTRA_TYPES}").repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark).where("1 = 0")


def labels(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(rows if rows is not None else [(1, 1, 0), (2, 1, None), (None, 0, 1), (16, 0, 1), (16, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
