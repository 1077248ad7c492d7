"""Quality of a text by a vote of its nearest labelled neighbours in a latent-semantic space.

A text is a vector of hashed byte bigrams and trigrams (logarithmic counts times inverse document
frequency, unit length) beside one-hot terms of its shape: how varied its words and lines are, how
long, how many capitals, signs, digits, repeats. Document frequencies come from all documents.
A bounded sample of labelled documents (SAMPLE, chosen by a hash of the id) gives the latent axes,
by a truncated singular value decomposition, and the labelled vectors, which are broadcast: their
size is fixed by SAMPLE and AXES. Every document is compared with all of them by blocked cosine
products; the NEIGHBOURS nearest vote, weighted by similarity.

Defined results: null and empty texts are scored like any other, as texts without n-grams; labels
that are null, or belong to a null id, teach nothing; of several labels of one id the lowest holds;
without any label every score is 0.5; rows that repeat an id are scored each; all columns of the
input are kept apart in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytescan
from tidewire.llm.sampling import attached, frequencies, thinned

DIMS = 4096
GRAMS = (2, 3)
#: Labelled documents whose vectors are fitted and broadcast.
SAMPLE = 3000
AXES = 64
NEIGHBOURS = 25
#: How fast a neighbour's weight falls with its distance.
SHARPNESS = 10.0
ROWS = 256

_STEPS = np.linspace(0.05, 0.95, 10)
_SHAPES = 9
SHAPE_DIMS = _SHAPES * (len(_STEPS) + 1)
ALL_DIMS = DIMS + SHAPE_DIMS

SCORED = T.StructType([T.StructField("score", T.DoubleType())])
_KIND = np.zeros(256, dtype=np.uint8)  # 1 capital, 2 digit, 3 sign, 4 blank, 0 other
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_LINES = bytescan.byte_class([b for b in range(256) if b != 10])


def _distinct(words: bytescan.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: number of units, and share of different ones."""
    count = np.diff(words.bounds)
    different = np.array([len(np.unique(words.hash[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:])])
    return count, different / np.maximum(count, 1)


def shapes(source: bytescan.Texts) -> np.ndarray:
    """One-hot terms of each text's shape."""
    words, lines = bytescan.words(source, bytescan.BETWEEN_SPACES), bytescan.words(source, _LINES)
    count, varied = _distinct(words)
    line_count, varied_lines = _distinct(lines)
    size = np.diff(source.offsets)
    kinds = np.stack([np.bincount(_KIND[source.data[a:b]], minlength=5) for a, b in zip(source.offsets[:-1], source.offsets[1:])])
    again = np.zeros(len(words.hash) + 1, dtype=np.int64)
    again[2:] = np.cumsum((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])) if len(words.hash) > 1 else 0
    repeats = again[np.maximum(words.bounds[1:], 0)] - again[words.bounds[:-1]] if len(words.hash) else np.zeros(len(source))
    inked = np.maximum(size - kinds[:, 4], 1)
    # a text of many words repeats some by nature: its variety is set against the square root of its length
    values = np.stack(
        [
            varied,
            np.minimum(1, varied * np.sqrt(np.maximum(count, 1)) / 20),
            varied_lines,
            repeats / np.maximum(count, 1),
            kinds[:, 1] / inked,
            kinds[:, 2] / inked,
            kinds[:, 3] / inked,
            np.minimum(1, inked / np.maximum(count, 1) / 20),
            np.minimum(1, np.log1p(size) / 14),
        ],
        axis=1,
    )
    out = np.zeros((len(source), _SHAPES, len(_STEPS) + 1), dtype=np.float32)
    place = (values[:, :, None] > _STEPS[None, None, :]).sum(axis=2)
    np.put_along_axis(out, place[:, :, None], 1, axis=2)
    return out.reshape(len(source), SHAPE_DIMS)


def _counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    for low, high, source in bytescan.groups(column, rows=ROWS):
        yield low, high, np.concatenate([bytescan.ngram_counts(source, GRAMS, DIMS), shapes(source)], axis=1)


def _presence(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, counts in _counts(column):
        yield np.append((counts > 0).sum(axis=0), len(counts))


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words and shape, each of unit length, weigh the same."""
    out = np.log1p(counts) * idf
    return np.concatenate([_unit(out[:, :DIMS]), _unit(out[:, DIMS:])], axis=1)


def truncated_axes(x: np.ndarray, axes: int, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors, one per column, by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(axes + 16, *x.shape))).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    return np.linalg.svd(basis.T @ x, full_matrices=False)[2][:axes].T.astype(np.float32)


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, counts in _counts(batch.column("text")):
                rows = pa.array([x.astype(np.float16).tobytes() for x in weigh(counts, idf)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in ("doc_id", "label")), rows], names=["doc_id", "label", "vector"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, label)."""
    seen = frequencies(docs, _presence, ALL_DIMS + 1)
    idf = np.log((1 + seen[ALL_DIMS]) / (1 + seen[:ALL_DIMS])).astype(np.float32) + 1
    known = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("label").cast("double").alias("label"))
    chosen = thinned(known, "doc_id", SAMPLE, known.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # about SAMPLE ids, so small enough to broadcast
    found = sorted(sample.mapInArrow(_vectors(idf), "doc_id long, label double, vector binary").collect(), key=lambda r: r["doc_id"])
    if not found:
        return Model(idf, np.zeros((ALL_DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r["vector"], dtype=np.float16) for r in found]).astype(np.float32)
    axes = truncated_axes(x, AXES)
    return Model(idf, axes, _unit(x @ axes), np.array([r["label"] for r in found]))


def vote(cosines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weighted share of label 1 among the nearest neighbours of each row."""
    if not len(labels):
        return np.full(len(cosines), 0.5)
    k = min(NEIGHBOURS, len(labels))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.exp(SHARPNESS * (np.take_along_axis(cosines, near, axis=1).astype(np.float64) - 1))
    return np.clip((weight * labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def _scorer(shared):
    def start():
        model = shared.value

        def work(column: pa.Array):
            for low, high, counts in _counts(column):
                cosines = _unit(weigh(counts, model.idf) @ model.axes) @ model.vectors.T
                yield low, high, [pa.array(vote(cosines, model.labels))]

        return work

    return start


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs as struct `doc`, and score: 0 to 1, higher where label 1 is likelier. Labels: doc_id, label."""
    return attached(docs, _scorer(docs.sparkSession.sparkContext.broadcast(fit(docs, labels))), SCORED)
