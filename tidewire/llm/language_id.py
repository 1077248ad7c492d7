"""Language of a text by its nearest centroid.

A text is a vector of hashed byte bigrams and trigrams of its lower-cased letters (each run of
other ASCII characters counts as a blank): logarithmic counts times inverse document frequency, of unit length. Document frequencies come from all
training documents. Each language has a few centroids, found by spherical k-means on a bounded
sample of its documents (SAMPLE, chosen by a hash of the id); a text gets the language of the
centroid with the highest cosine. It is accepted if it lies no farther from that centroid than
the centroid's own members do, up to DEVIATIONS standard deviations; otherwise it is marked as
rejected, the nearest language still being named.

Defined results: a null text or one without a letter is `und` with score 0 and not accepted, as
is every text when nothing could be learned; training rows without text, language or letters
teach nothing; repeated and null ids make no difference (a null id is never in the training fold);
all columns of the input are kept apart in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytescan
from tidewire.llm.sampling import attached, frequencies

DIMS = 8192
GRAMS = (2, 3)
CENTROIDS = 3
#: Documents per language that the centroids are found on.
SAMPLE = 1000
DEVIATIONS = 4.0
ROWS = 256

PREDICTED = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
)


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, high, source in bytescan.groups(pc.utf8_lower(column), rows=ROWS):
        yield low, high, bytescan.ngram_counts(bytescan.letters(source), GRAMS, DIMS)


def _presence(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, counts in _counts(column):
        yield np.append((counts > 0).sum(axis=0), len(counts))


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norms > 0, norms, 1)


def spherical_means(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to k unit centroids, each started far from the earlier ones, and the owner of each vector."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.stack(centres).T, axis=1)
        centres.append(vectors[int(np.argmin(nearest))])
    middle = np.stack(centres)
    for _ in range(rounds):
        owner = np.argmax(vectors @ middle.T, axis=1)
        middle = np.stack([vectors[owner == c].mean(axis=0) if (owner == c).any() else middle[c] for c in range(len(middle))])
        norms = np.linalg.norm(middle, axis=1, keepdims=True)
        middle = middle / np.where(norms > 0, norms, 1)
    return middle, np.argmax(vectors @ middle.T, axis=1)


def _centroids(idf: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        column = table["text"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        vectors = np.concatenate([weigh(c, idf) for _, _, c in _counts(column)])
        middle, owner = spherical_means(vectors, CENTROIDS)
        rows = []
        for c, centre in enumerate(middle):
            near = vectors[owner == c] @ centre
            if len(near):
                rows.append((table["lang"][0].as_py(), centre.astype(np.float32).tobytes(), float(near.mean() - DEVIATIONS * near.std())))
        return pa.table({"lang": [r[0] for r in rows], "centre": pa.array([r[1] for r in rows], pa.binary()), "floor": pa.array([r[2] for r in rows], pa.float64())})

    return run


def fit(training: DataFrame) -> tuple[np.ndarray, list[tuple[str, np.ndarray, float]]]:
    """Inverse document frequencies and (language, centroid, least accepted cosine), from training(doc_id, text, lang)."""
    rows = training.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null and text rlike '\\\\p{L}'")
    seen = frequencies(rows, _presence, DIMS + 1)
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])).astype(np.float32) + 1
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))  # one row per language
    share = F.least(F.lit(1.0), SAMPLE / F.col("n")) * float(1 << 40)
    sample = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64(F.lit(0x5EED), "doc_id"), F.lit(1 << 40)) < share).select("lang", "text")
    found = sample.groupBy("lang").applyInArrow(_centroids(idf), "lang string, centre binary, floor double").collect()
    centroids = [(r["lang"], np.frombuffer(r["centre"], dtype=np.float32), r["floor"]) for r in found]
    return idf, sorted(centroids, key=lambda c: (c[0], c[1].tobytes()))


def _predictor(shared):
    def start():
        idf, centroids = shared.value
        names = sorted({c[0] for c in centroids})
        matrix = np.stack([c[1] for c in centroids]).T if centroids else np.zeros((DIMS, 0), np.float32)
        floors = np.array([c[2] for c in centroids])
        language = np.array([names.index(c[0]) for c in centroids], dtype=int)

        def work(column: pa.Array):
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for low, high, counts in _counts(column):
                known = letters[low:high] & bool(names)
                cosines = weigh(counts, idf) @ matrix
                if names:
                    best = np.argmax(cosines, axis=1)
                    top = cosines[np.arange(len(best)), best].astype(np.float64)
                    others = np.where(language[None, :] == language[best][:, None], 0, cosines).max(axis=1, initial=0).astype(np.float64)
                    fine = top >= floors[best]
                    picked = [names[language[b]] for b in best]
                else:
                    top = others = np.zeros(high - low)
                    fine, picked = np.zeros(high - low, bool), ["und"] * (high - low)
                score = np.where(known & (top > 0), np.clip(top / np.where(top > 0, top + others, 1), 0, 1), 0.0)
                names_out = [p if k else "und" for p, k in zip(picked, known)]
                yield low, high, [pa.array(names_out, pa.string()), pa.array(score), pa.array(np.where(known, top, 0.0)), pa.array(known & fine)]

        return work

    return start


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """All columns of docs as struct `doc`, with lang_pred, score (0 to 1, against the best other language), cosine, accepted."""
    return attached(docs, _predictor(docs.sparkSession.sparkContext.broadcast(fit(training))), PREDICTED)
