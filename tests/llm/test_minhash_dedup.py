import random
import re

import numpy as np
import pytest

from tests.llm import awkward
from tidewire.llm import bytescan, minhash_dedup


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    """Component of each row index: least id over rows linked directly or through others."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            x, y = sets[a], sets[b]
            if rows[a][0] == rows[b][0] or (x and y and 100 * len(x & y) >= 80 * len(x | y)):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(rows))], [len(s) for s in sets]


def check(spark, rows, frame, width):
    component, sizes = brute(rows, width)
    expected = sorted(((i, n, c, i is None or i == c) for (i, _), n, c in zip(rows, sizes, component)), key=repr)
    got = sorted((tuple(r) for r in minhash_dedup.near_duplicates(frame, width).collect()), key=repr)
    assert got == expected


def test_awkward_rows(spark):
    check(spark, awkward.texts(), awkward.documents(spark), 4)


def test_empty(spark):
    assert minhash_dedup.near_duplicates(awkward.no_documents(spark)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_large_groups(spark, seed):
    """Groups whose members link with some and not with others: every component equals brute force."""
    rng = random.Random(seed)
    rows = []
    for group in range(6):
        words = awkward.sentence(rng, 80).split(" ")
        for _ in range(25):
            if rng.random() < 0.7:
                words = list(words)
                for _ in range(rng.randint(1, 3)):
                    words[rng.randrange(len(words))] = awkward.sentence(rng, 1)
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"), 4)


def test_cut_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "CELL_SHINGLES", 300)
    test_chains_and_large_groups(spark, 3)


def test_signatures_agree_with_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1600], np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))])
    signature = minhash_dedup.signatures([np.sort(a), np.sort(b)], 2000)
    assert abs((signature[0] == signature[1]).mean() - 1600 / 2400) < 0.04


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(bytescan, "PIECE_BYTES", 7)
    import pyarrow as pa

    rng = random.Random(1)
    given = [awkward.sentence(rng, 9), "", "a", "bb cc", "long" * 30]
    words = bytescan.words(bytescan.texts(pa.array(given)), bytescan.BETWEEN_SPACES)
    assert np.diff(words.bounds).tolist() == [len(t.split()) for t in given]
    monkeypatch.undo()
    whole = bytescan.words(bytescan.texts(pa.array(given)), bytescan.BETWEEN_SPACES)
    assert (whole.hash == words.hash).all()
