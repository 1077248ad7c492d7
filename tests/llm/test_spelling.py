import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm import awkward
from tidewire.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling._UPPER, spelling._LOWER)


def counted(rows, least=5):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def candidates(words):
    """The words that share all but one letter at some place, or that are the rest without it; very long words meet all."""
    shared, long = {}, [w for w in words if len(w) > 100]
    for w in words:
        for k in range(len(w) if len(w) <= 100 else 0):
            shared.setdefault((k, w[:k] + w[k + 1 :]), []).append(w)
            shared.setdefault((-1, w[:k] + w[k + 1 :]), []).append(w)
    for w in words:
        if len(w) > 100:
            yield w, set(words)
            continue
        rests = [w[:k] + w[k + 1 :] for k in range(len(w))]
        yield w, {*long, *shared.get((-1, w), ()), *(v for k, r in enumerate(rests) for v in shared[k, r]), *(r for r in rests if r in words)}


def brute(words):
    out = {}
    for w, some in candidates(words):
        n, around = words[w], [v for v in some if abs(len(v) - len(w)) <= 1 and near(w, v)]
        form = min(around, key=lambda v: (-words[v], v), default=None)
        out[w] = (form if form and words[form] >= 5 * n else None, n, len(around))
    rows = []
    for w, (form, n, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, words[form] if form else None))
    return sorted(rows)


def noisy(seed, words=60, docs=400):
    """Texts over a few words with edits of all kinds, anagrams among them."""
    rng = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(words)]
    base += ["".join(rng.sample(w, len(w))) for w in base[:10]]

    def spelled(w):
        k, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.75:
            return w
        c = rng.choice(letters)
        return w[:k] + c + w[k + 1 :] if kind < 0.85 else w[:k] + c + w[k:] if kind < 0.93 else w[:k] + w[k + 1 :]

    weights = [1 / (k + 1) for k in range(len(base))]
    return [(i, " ".join(spelled(w).upper() if rng.random() < 0.1 else spelled(w) for w in rng.choices(base, weights, k=80))) for i in range(docs)]


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("leaf", [40, spelling.LEAF])
def test_noisy_words(spark, leaf):
    rows = noisy(3)
    words = counted(rows)
    expected = brute(words)
    assert [r[4] for r in expected] == [sum(near(w, v) for v in words) for w in sorted(words)]
    assert collected(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf)) == expected
    assert len(expected) > 200 and sum(r[1] is not None for r in expected) > 50


def test_awkward_rows(spark):
    docs = awkward.documents(spark)
    five = docs.union(docs).union(docs).union(docs).union(docs)
    assert collected(spelling.variants(five)) == brute(counted(awkward.texts() * 5))


def test_chains_of_forms(spark):
    chain = {"aaaaaaaa": 5, "aaaaaaab": 25, "aaaaaabb": 125, "aaaaabbb": 625, "aaaabbbb": 3125, "zzzzzz": 5}
    words = spark.createDataFrame([*chain.items()], "word string, n long")
    near_words = {r["word"]: r for r in spelling.neighbours(words).collect()}
    assert near_words["aaaaaaab"]["n_near"] == 2 and near_words["zzzzzz"]["best"] is None
    forms = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("d", "e"), ("x", "y")}


def test_crowded_leaf_is_dealt_to_many_parts(spark):
    """Anagrams have one point, which no tree can split."""
    rng = random.Random(4)
    words = {"".join(rng.sample("aaabbbccdd", 10)): rng.randint(5, 400) for _ in range(300)}
    words |= {w[:-1] + "e": n for w, n in [*words.items()][:50]}
    got = spelling.neighbours(spark.createDataFrame([*words.items()], "word string, n long"), leaf=20)
    expected = {w: (n, sum(near(w, v) for v in words)) for w, n in words.items()}
    assert {r["word"]: (r["n"], r["n_near"]) for r in got.collect()} == expected


@given(st.lists(st.text("abé", min_size=3, max_size=6), min_size=1, max_size=60, unique=True), st.integers(1, 9))
def test_search_finds_all_near_words(words, most):
    raw = [w.encode("latin-1") for w in words]
    got = set()
    for length, at, points in spelling.by_length(raw):
        tree = spelling.grow(points.counts, np.arange(len(at)), most)
        for size, mine, wanted in spelling.by_length(raw):
            if abs(size - length) <= 1:
                i, j = spelling.search(tree, points, wanted, length - size)
                got |= {(words[mine[a]], words[at[b]]) for a, b in zip(i, j)}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


@given(st.lists(st.text("abc", min_size=4, max_size=4), min_size=1, max_size=40, unique=True), st.integers(1, 8))
def test_searches_reach_the_leaf_of_every_near_word(words, leaves):
    points = spelling.of_one_length([w.encode() for w in words])
    tree = spelling.deal(points.counts, leaves)
    leaf = spelling.leaf_of(tree, points.counts)
    met = set(zip(*(x.tolist() for x in spelling.leaves_met(tree, points.counts, 0))))
    assert all((i, leaf[j]) in met for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))


def test_empty(spark):
    assert spelling.variants(awkward.no_documents(spark)).collect() == []
