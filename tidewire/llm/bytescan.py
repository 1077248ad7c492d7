"""Whole texts as flat numpy arrays: words, their hashes, and byte n-grams.

Texts come from Arrow columns without a Python object per text or word. Documents are
taken in groups of a bounded number of bytes, so a batch of any size needs little memory;
a document longer than the bound is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(word_bytes: Iterator[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(word_bytes)] = True
    return table


#: Words of letters and digits: lower-case ASCII letters, digits, every non-ASCII character.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words between white space: all bytes but space and 09-0D.
BETWEEN_SPACES = byte_class([x for x in range(256) if x != 0x20 and not 0x09 <= x <= 0x0D])


class Texts(NamedTuple):
    """UTF-8 bytes of adjacent documents; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    """Words in text order: document index, first byte, bytes, hash; bounds[i]:bounds[i + 1] are those of document i."""

    doc: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def texts(column: pa.Array) -> Texts:
    """The bytes of an Arrow string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return Texts(np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds)


def groups(column: pa.Array, limit: int = GROUP_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int, Texts]]:
    """Runs of at most `rows` rows whose texts hold at most `limit` bytes together, or one row."""
    whole = texts(column)
    low, count = 0, len(whole)
    while low < count:
        high = int(np.searchsorted(whole.offsets, whole.offsets[low] + limit, side="right")) - 1
        high = min(count, low + rows, max(low + 1, high))
        start = whole.offsets[low]
        yield low, high, Texts(whole.data[start : whole.offsets[high]], whole.offsets[low : high + 1] - start)
        low = high


_NOT_LETTERS = np.arange(256, dtype=np.uint8)
_NOT_LETTERS[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def letters(source: Texts) -> Texts:
    """The texts with every run of ASCII bytes that are no letters as one blank."""
    data = _NOT_LETTERS[source.data]
    keep = data != 0x20
    keep[:-1] |= keep[1:]
    counts = [np.count_nonzero(keep[a:b]) for a, b in zip(source.offsets[:-1], source.offsets[1:])]
    return Texts(data[keep], np.cumsum([0, *counts]))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 17)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, dtype=np.uint64)


def _powers_to(length: int) -> np.ndarray:
    global _powers
    if len(_powers) < length:
        grown = np.full(max(length, 2 * len(_powers)), _STEP, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers


def _pieces(data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE_BYTES that end behind a byte outside words."""
    low = 0
    while low < len(data):
        high = min(len(data), low + PIECE_BYTES)
        while high < len(data) and table[data[high - 1]]:
            ahead = np.flatnonzero(~table[data[high : high + PIECE_BYTES]])
            high = high + int(ahead[0]) + 1 if len(ahead) else min(len(data), high + PIECE_BYTES)
        yield low, high
        low = high


def words(source: Texts, table: np.ndarray) -> Words:
    """All words of the documents, A-Z lower-cased. Words never cross from one document into the next."""
    starts, sizes, hashes = [], [], []
    edge = np.zeros(len(source.data) + 1, dtype=bool)
    edge[source.offsets] = True
    lower = _LOWER[source.data]
    for low, high in _pieces(lower, table):
        part = lower[low:high]
        inside = table[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[low + 1 : high]
        at = np.flatnonzero(inside)
        if not len(at):
            continue
        begin = np.flatnonzero(first)
        heads = np.searchsorted(at, begin)
        lengths = np.diff(np.append(heads, len(at)))
        place = at - np.repeat(begin, lengths)
        values = _BYTE_VALUES[part[at]] * _powers_to(int(lengths.max()))[place]
        starts.append(begin + low)
        sizes.append(lengths)
        hashes.append(mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64), 3))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, source.offsets)
    doc = np.repeat(np.arange(len(source)), np.diff(bounds))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return Words(doc, start, size, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), bounds)


def sequence_hash(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `length` neighbours, in their order."""
    count = len(hashes) - length + 1
    total = np.zeros(max(0, count), dtype=np.uint64)
    for k in range(length):
        total += hashes[k : k + count] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * seed) % 2**64 | 1)
        total ^= total >> np.uint64(29)
    return mix(total, 5 + length)


def ngram_counts(source: Texts, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of hashed byte n-grams of the given sizes, one row per document; dims is a power of two."""
    out = np.zeros(len(source) * dims, dtype=np.int64)
    for low in range(0, len(source.data), PIECE_BYTES):
        data = source.data[low : low + PIECE_BYTES + max(sizes) - 1].astype(np.uint32)
        key = np.zeros(len(data), dtype=np.uint32)
        for n in range(1, max(sizes) + 1):
            key = key[: len(data) - n + 1] * np.uint32(16777619) + data[n - 1 :] + np.uint32(1)
            count = min(len(key), PIECE_BYTES)
            if n not in sizes or count <= 0:
                continue
            slot = (key[:count] * np.uint32(2654435761)) >> np.uint32(33 - dims.bit_length())
            at = np.arange(low, low + count)
            doc = np.searchsorted(source.offsets, at, side="right") - 1
            whole = at + n <= source.offsets[1:][doc]
            out += np.bincount(doc[whole] * dims + slot[whole], minlength=len(out))
    return out.reshape(len(source), dims).astype(np.float32)
