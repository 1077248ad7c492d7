import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tests.llm import awkward
from tidewire.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def test_query_digests(spark, library):
    got = sorted((tuple(r) for r in bpe.digests(awkward.documents(spark), PATH).collect()), key=repr)
    expected = []
    for i, t in awkward.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_fuzz(library):
    rng = random.Random(2)
    letters = "aaab'sS ΑΣσ'İ<|endoftext|>12é\u0301\n\t\x1cẞ!?''日本語😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>a<|startoftext|>", "<|endoftext", "a" * 999, "", "s" * 2000, "'re're'RE"]
    encoder = bpe.Encoder(bpe.Model(PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    rng = random.Random(3)
    texts = [awkward.sentence(rng, 40) for _ in range(20)]
    encoder = bpe.Encoder(bpe.Model(PATH))
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder.known) <= 50


def test_empty_and_unfit_file(spark, tmp_path):
    assert bpe.digests(awkward.no_documents(spark), PATH).collect() == []
    given = json.load(open(PATH, encoding="utf-8"))
    given["model"]["merges"].reverse()
    (tmp_path / "t.json").write_text(json.dumps(given), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.Model(str(tmp_path / "t.json"))
