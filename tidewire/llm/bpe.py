"""Byte-pair encoding and decoding with a public vocabulary file of the word-end kind.

The words of a group of documents that are not yet known go through merge rounds together:
their symbols lie in one flat numpy array, the pairs of all words are looked up by bisection in
the sorted pair keys of the merge list, and each round merges the pair of lowest rank of every
word, wherever it occurs in the word, until no word has a known pair. A merge never makes a
pair of lower rank than its own in these files (checked on loading), so merging all
occurrences at once gives what merging them one by one gives. Documents never leave their row.

The file fixes the rest: texts are put into composed form, white space separates, letters are
lower-cased one by one, the file's pattern cuts the words, and a word's last byte carries the
word-end mark. Special tokens are found in the raw text first. Ids are packed as little-endian
unsigned 32-bit integers. The file has no decoder, so a decoded text is the tokens with a blank
between them. A null or empty text has no ids and decodes to an empty text. Letters and
numbers are those of the regex module's Unicode tables.

Rows keep doc_id only; other columns, repeated or null ids make no difference.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import bytescan
from tidewire.llm.batches import small_batches

GROUP_BYTES = 2 << 20
#: Words whose ids a worker remembers at most; beyond that it starts anew.
REMEMBERED = 200_000
_NONE = np.iinfo(np.int64).max


class Model:
    """What encoding and decoding need of a vocabulary file; small enough to broadcast (a fixed file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["byte_fallback"] or given["decoder"]:
            raise ValueError("only byte-level BPE with word ends and without a decoder is supported")
        vocabulary, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        tokens = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        letters = byte_letters()
        self.byte_id = np.array([vocabulary[c] for c in letters], dtype=np.int64)
        self.end_id = np.array([vocabulary[c + "</w>"] for c in letters], dtype=np.int64)
        self.base = len(self.tokens)
        left, right = (np.array([vocabulary[m[k]] for m in merges], dtype=np.int64) for k in range(2))
        result = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        made = np.full(self.base, -1)
        made[result[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(made[left], made[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a token that only a later merge makes")
        order = np.argsort(left * self.base + right)
        self.keys, self.ranks, self.results = (left * self.base + right)[order], order, result[order]
        self.pattern = next(x["pattern"]["Regex"] for x in given["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


#: Below this code point lie Latin letters only: a plain pattern with short classes does for such texts.
LATIN_END = 0x370


def _latin(kind: str) -> str:
    return "".join(f"\\U{c:08x}" for c in range(LATIN_END) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    """Texts to packed ids; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.words = regex.compile(model.pattern)
        letters, numbers = _latin("L"), _latin("N")
        pattern = model.pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\t-\r \x85\xa0{letters}{numbers}]")
        self.latin_words = re.compile(pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]"))
        self.beyond = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")
        self.special = re.compile("|".join(re.escape(x) for x in sorted(model.special, key=len, reverse=True))) if model.special else None
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # each letter alone: no final sigma
        return (self.words if self.beyond.search(text) else self.latin_words).findall(text)

    def parts(self, text: str) -> list[str]:
        """Words and special tokens in order; special tokens are marked by a leading blank, which no word has."""
        if self.special is None or not self.special.search(text):
            return self.cut(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += [*self.cut(text[at : found.start()]), " " + found[0]]
            at = found.end()
        return out + self.cut(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        wanted = set().union(*parts)
        if len(self.known) + len(wanted) > REMEMBERED:
            self.known = {}
        new = [w for w in wanted if w not in self.known]
        special = [w for w in new if w[0] == " "]
        plain = [w for w in new if w[0] != " "]
        self.known.update((w, np.array([self.model.special[w[1:]]], dtype="<u4").tobytes()) for w in special)
        self.known.update(zip(plain, merge_rounds(self.model, plain)))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def merge_rounds(model: Model, words: list[str]) -> list[bytes]:
    """The packed ids of each word."""
    if not words:
        return []
    raw = [w.encode("utf-8") for w in words]
    length = np.array([len(x) for x in raw])
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    symbol, word = model.byte_id[flat], np.repeat(np.arange(len(words)), length)
    last = np.cumsum(length) - 1
    symbol[last] = model.end_id[flat[last]]
    rank, merged = np.empty_like(symbol), np.empty_like(symbol)  # of the pair that begins at each symbol
    stale = np.arange(len(symbol))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        behind = np.minimum(stale + 1, len(symbol) - 1)
        key = symbol[stale] * model.base + symbol[behind]
        at = np.searchsorted(model.keys, key)
        at[at == len(model.keys)] = 0
        known = (model.keys[at] == key) & (word[behind] == word[stale]) & (behind > stale)
        rank[stale], merged[stale] = np.where(known, model.ranks[at], _NONE), model.results[at]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
        live = lowest != _NONE
        if not live.all():
            done.append((word[~live], symbol[~live]))
            symbol, word, rank, merged, lowest = (x[live] for x in (symbol, word, rank, merged, lowest))
        spot = np.flatnonzero(rank == lowest)
        # of overlapping occurrences, as in a run of one symbol, every other one from the left
        run = np.flatnonzero(np.append(True, np.diff(spot) != 1)) if len(spot) else spot
        place = np.arange(len(spot)) - np.repeat(run, np.diff(np.append(run, len(spot))))
        spot = spot[place % 2 == 0]
        symbol[spot] = merged[spot]
        stay, touched = np.ones(len(symbol), dtype=bool), np.zeros(len(symbol), dtype=bool)
        stay[spot + 1] = False
        touched[spot] = True
        touched[np.maximum(spot - 1, 0)] = True
        symbol, word, rank, merged = (x[stay] for x in (symbol, word, rank, merged))
        stale = np.flatnonzero(touched[stay])
    word = np.concatenate([w for w, _ in done])
    order = np.argsort(word, kind="stable")
    packed = np.concatenate([s for _, s in done])[order].astype("<u4").tobytes()
    ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for low, high, _ in bytescan.groups(batch.column(1), GROUP_BYTES):
                rows = batch.slice(low, high - low)
                ids = encoder.encode([t or "" for t in rows.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return run


def _decoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.tokens.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            offsets = np.cumsum([0, *[len(x.as_buffer()) if x.is_valid else 0 for x in ids]])
            low = 0
            while low < len(ids):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + GROUP_BYTES, side="right")) - 1)
                rows = batch.slice(low, high - low)
                texts = [" ".join(map(token, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                low = high

    return run


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Model(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and packed ids of every whole text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encoder(_shared(docs, path)), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the decoded text to rows of doc_id and packed ids."""
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_decoder(_shared(encoded, path)), "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of ids and of the round trip, per document."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
