"""Toxicity by weak supervision.

Voters. From labelled texts (at most half of SAMPLE per class), whole words and word beginnings (4 to 8 bytes, for inflected
forms) are counted by class, copies of a text once; those whose share of toxic texts is high by a lower
confidence bound, however few of the toxic texts they are in, become lexicon voters, and a few patterns (shouting, runs of exclamation marks, direct address next to a lexicon
word, no lexicon word at all) vote beside them. A voter says toxic, clean or nothing.

Label model. All documents are read; those with equal votes and features are one pattern with its
number of documents, so that all documents without a feature are a single row however many they
are. The commonest patterns (half of SAMPLE) are all used, of the rest as many are drawn by a hash
of the pattern and weighted by their share; labels are unused. On these a generative model estimates by expectation maximisation how often each voter speaks on toxic and
on clean documents. Correlations of voters that remain within the classes are measured, and the
evidence of voters that nearly always speak together is divided by their number, so that nested
beginnings of one word do not count several times.

Classifier. The model's posteriors, not the labels, train a logistic regression on words and word
beginnings, which scores every document.

Counts are aggregated before the shuffle; what is broadcast or collected (VOTERS, FEATURES, SAMPLE) has a
fixed bound. Defined results: null and empty texts are scored as texts without words; null labels
and ids teach nothing; of several labels of one id the highest holds; without a toxic or a clean
label all scores are the share of toxic labels (0 without labels); rows that repeat an id are
scored each; all columns of the input are kept apart in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import bytescan
from tidewire.llm.batches import small_batches
from tidewire.llm.sampling import attached, thinned
from tidewire.session import staged

STEMS = (4, 5, 6, 7, 8)
#: Lexicon voters and classifier features at most: the strongest by their counts.
VOTERS = 500
FEATURES = 4000
#: Labelled texts that terms are counted in, half of each class, and patterns of documents that the models are fitted on, at most about.
SAMPLE = 20_000
#: Lower bounds (95 %, Wilson) of a term's share of toxic documents: to be a lexicon voter, to be a feature.
VOTER_SHARE = 0.65
FEATURE_SHARE = 0.5
#: Voters whose correlation within the classes is above this count as copies of one voter.
COPIES = 0.8

SCORED = T.StructType([T.StructField("score", T.DoubleType())])
_U64 = np.uint64


def terms(source: bytescan.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and their documents."""
    words = bytescan.words(source, bytescan.ALNUM)
    keys, docs = [words.hash], [words.doc]
    start, doc, size = words.start, words.doc, words.size
    value = np.zeros(len(start), dtype=_U64)
    for k in range(max(STEMS)):
        longer = size > k + 1  # a word of just k + 1 bytes has its own term already
        start, doc, size, value = start[longer], doc[longer], size[longer], value[longer]
        value = value * _U64(0x100000001B3) + source.data[start + k] + _U64(1)
        if k + 1 in STEMS:
            keys.append(bytescan.mix(value, 41 + k))
            docs.append(doc)
    return np.concatenate(keys), np.concatenate(docs)


class Lookup:
    """Which of a sorted list of terms each document has."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.first = np.zeros(1 << 16, dtype=bool)  # most terms fail on their first 16 bits already
        self.first[(wanted >> _U64(48)).astype(np.int64)] = True

    def pairs(self, keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, place in the list), in order."""
        if not len(self.wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = self.first[(keys >> _U64(48)).astype(np.int64)]
        keys, docs = keys[maybe], docs[maybe]
        at = np.searchsorted(self.wanted, keys)
        at[at == len(self.wanted)] = 0
        hit = self.wanted[at] == keys
        both = np.unique(docs[hit] * len(self.wanted) + at[hit])
        return both // len(self.wanted), both % len(self.wanted)


def _groups(column: pa.Array) -> Iterator[tuple[int, int, bytescan.Texts, bytescan.Texts]]:
    """Groups of rows: lower-cased and as they are."""
    column = column.fill_null("")
    lowered = pc.utf8_lower(column)
    for low, high, source in bytescan.groups(lowered, rows=1024):
        yield low, high, source, bytescan.texts(column.slice(low, high - low))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for low, high, source, _ in _groups(batch.column("text")):
            keys, docs = terms(source)
            order = np.lexsort((keys, docs))
            keys, docs = keys[order], docs[order]
            once = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])) if len(keys) else np.zeros(0, bool)
            key, place = np.unique(keys[once], return_inverse=True)
            bad = np.bincount(place, weights=toxic[low:high][docs[once]], minlength=len(key)).astype(np.int64)
            count = np.bincount(place, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bad), pa.array(count - bad)], names=["term", "bad", "good"])


def pattern_votes(source: bytescan.Texts, lexicon: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing, of the pattern voters; `lexicon`: how many lexicon voters speak."""
    out = np.zeros((len(source), 4), dtype=np.int8)
    for k, (a, b) in enumerate(zip(source.offsets[:-1], source.offsets[1:])):
        data = source.data[a:b]
        letters = np.count_nonzero((data | 0x20) - 97 < 26) if len(data) else 0
        capitals = np.count_nonzero(data - 65 < 26) if len(data) else 0
        loud = np.count_nonzero((data[1:] == 33) & (data[:-1] == 33)) if len(data) > 1 else 0
        out[k, 0] = 1 if letters > 20 and capitals > 0.7 * letters and lexicon[k] else 0
        out[k, 1] = 1 if loud and lexicon[k] else 0
        out[k, 2] = 1 if lexicon[k] >= 3 else 0
        out[k, 3] = -1 if not lexicon[k] else 0
    return out


class Model(NamedTuple):
    features: np.ndarray  # sorted term hashes
    weights: np.ndarray
    bias: float


def _votes(voters: np.ndarray, features: np.ndarray):
    """Per document: the voters that say toxic, the pattern votes, the features present."""

    def listed(pairs: tuple[np.ndarray, np.ndarray], count: int) -> pa.Array:
        cuts = np.searchsorted(pairs[0], np.arange(count + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(pairs[1].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speaking, showing = Lookup(voters), Lookup(features)
        for batch in batches:
            for _, _, source, raw in _groups(batch.column("text")):
                found = terms(source)
                said = speaking.pairs(*found)
                patterns = pattern_votes(raw, np.bincount(said[0], minlength=len(source)))
                arrays = [listed(said, len(source)), pa.array(list(patterns.astype(np.int32)), pa.list_(pa.int32())), listed(showing.pairs(*found), len(source))]
                yield pa.RecordBatch.from_arrays(arrays, names=["said", "patterns", "shown"])

    return run


def label_model(votes: np.ndarray, share: float, rounds: int = 25, weight: np.ndarray | None = None) -> np.ndarray:
    """Posterior of toxic per row from votes in {-1, 0, 1}, correlated voters counted once; `share`: the class balance; `weight`: documents per row."""
    weight = np.ones(len(votes)) if weight is None else weight
    prior = np.clip(share, 1e-3, 1 - 1e-3)
    speaks = np.concatenate([votes == 1, votes == -1], axis=1)
    speaks = speaks[:, speaks.any(axis=0)].astype(np.float32)
    points = (votes == 1).sum(axis=1) - (votes == -1).sum(axis=1)
    posterior = np.clip(share + 0.4 * np.sign(points), 0.02, 0.98)
    discount = np.ones(speaks.shape[1])
    for step in range(rounds):
        p = posterior.astype(np.float32)
        bad, good = weight * posterior, weight * (1 - posterior)
        here = (bad.astype(np.float32) @ speaks + 0.05) / (float(bad.sum()) + 0.1)  # how often a voter speaks on toxic and on clean documents
        there = (good.astype(np.float32) @ speaks + 0.05) / (float(good.sum()) + 0.1)
        if step == rounds // 2:  # correlations left within the classes, once the classes are settled
            rest = (speaks - (p[:, None] * here + (1 - p[:, None]) * there)) * np.sqrt(weight).astype(np.float32)[:, None]
            scale = np.sqrt((rest * rest).sum(axis=0)) + 1e-6
            alike = (rest.T @ rest) / scale[:, None] / scale[None, :]
            discount = 1 / (alike > COPIES).sum(axis=1).clip(min=1)
        evidence = speaks @ (discount * (np.log(here) - np.log(there)))
        # silence of a voter says little by itself and is left out, as abstaining is not a vote
        posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
    return posterior


def logistic(rows: list[np.ndarray], count: int, target: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 500, pace: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary sparse rows with soft targets; `weight`: documents per row; each coefficient has a pace of its own."""
    flat = np.concatenate(rows).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, past = np.zeros(count + 1), np.full(count + 1, 1e-8)  # the last one is the bias
    for _ in range(steps):
        margin = np.bincount(owner, weights=weights[flat], minlength=len(rows)) + weights[count]
        error = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        slope = np.append(np.bincount(flat, weights=error[owner], minlength=count) + ridge * weights[:count], error.sum())
        past += slope * slope
        weights = weights - pace * slope / np.sqrt(past)
    return weights[:count], float(weights[count])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of docs(doc_id, text) and labels(doc_id, toxic)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("bad")).first()
    share = counts["bad"] / counts["n"] if counts["n"] else 0.0
    if not 0 < share < 1:
        return Model(np.zeros(0, _U64), np.zeros(0), np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    # a text is one whatever the number of rows and ids that hold it, with the label of the least id
    texts = rows.select("doc_id", F.xxhash64("text").alias("copy")).join(known, "doc_id").groupBy("copy").agg(F.min(F.struct("doc_id", "toxic")).alias("first")).select("copy", "first.*")
    sizes = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0.0)).alias("bad")).first()
    n_bad, n_good = int(sizes["bad"]), int(sizes["n"] - sizes["bad"])
    # each class thinned to its half of the sample, so that rare toxic texts all count
    chosen = thinned(texts.where("toxic = 1"), "copy", SAMPLE // 2, n_bad).unionByName(thinned(texts.where("toxic = 0"), "copy", SAMPLE // 2, n_good))
    # about SAMPLE texts at most, so small enough to broadcast; rows that repeat one teach once
    taught = rows.withColumn("copy", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "copy"]).dropDuplicates(["copy"]).select("text", "toxic")
    counted = taught.mapInArrow(_class_counts, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # shares among all labelled texts: where clean texts were thinned more than toxic ones, each stands for several
    thinning = min(1, SAMPLE / 2 / max(n_bad, 1)) / min(1, SAMPLE / 2 / max(n_good, 1))
    ranked = counted.withColumn("n", F.col("bad") + F.col("good")).withColumn("share", F.col("bad") / (F.col("bad") + F.col("good") * thinning))
    z = 1.96
    ranked = ranked.withColumn(
        "bound", (F.col("share") + z * z / 2 / F.col("n") - z * F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("n") + z * z / 4 / F.col("n") ** 2)) / (1 + z * z / F.col("n"))
    )
    ranked = ranked.where(F.col("bound") >= FEATURE_SHARE).orderBy(F.desc(F.col("bound") * F.sqrt("bad")), "term").limit(FEATURES).collect()
    features = np.sort(np.array([r["term"] for r in ranked], dtype=np.int64).view(_U64))
    lexicon = [r["term"] for r in ranked if r["bound"] >= VOTER_SHARE][:VOTERS]
    voters = np.sort(np.array(lexicon, dtype=np.int64).view(_U64))
    # every document is read; documents that look alike to the model are one pattern, those without any feature among them
    read = rows.where("doc_id is not null").select("text").mapInArrow(_votes(voters, features), "said array<int>, patterns array<int>, shown array<int>")
    patterns = staged(read.groupBy("said", "patterns", "shown").agg(F.count("*").alias("n")).withColumn("pattern", F.xxhash64("said", "patterns", "shown")), "patterns")
    many = patterns.count()
    if not many:
        return Model(np.zeros(0, _U64), np.zeros(0), float(np.log(share / (1 - share))))
    # the commonest are all in; each one drawn from the rest stands for several
    common = patterns.orderBy(F.desc("n"), "pattern").limit(SAMPLE // 2).collect()
    last, rest = (common[-1]["n"], common[-1]["pattern"]), many - len(common)
    drawn = thinned(patterns.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("pattern") > last[1]))), "pattern", SAMPLE // 2, rest).collect() if rest else []
    sample = [*common, *drawn]
    weight = np.array([r["n"] for r in sample], dtype=float)
    if drawn:
        weight[len(common) :] *= rest / len(drawn)
    votes = np.zeros((len(sample), len(voters) + 4), dtype=np.int8)
    for k, row in enumerate(sample):
        votes[k, row["said"]] = 1
        votes[k, len(voters) :] = row["patterns"]
    posterior = label_model(votes, share, weight=weight)
    weights, bias = logistic([np.array(r["shown"], dtype=np.int64) for r in sample], len(features), posterior, weight)
    return Model(features, weights, bias)


def _scorer(shared):
    def start():
        model = shared.value
        lookup = Lookup(model.features)

        def work(column: pa.Array):
            for low, high, source, _ in _groups(column):
                docs, shown = lookup.pairs(*terms(source))
                margin = np.bincount(docs, weights=model.weights[shown], minlength=high - low) + model.bias
                yield low, high, [pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))]

        return work

    return start


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of docs as struct `doc`, and score: 0 to 1, higher where a text is likelier toxic. Labels: doc_id, toxic."""
    return attached(docs, _scorer(docs.sparkSession.sparkContext.broadcast(fit(docs, labels))), SCORED)
