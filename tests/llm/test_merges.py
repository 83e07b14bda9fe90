"""Words merged many at once against the tokenizers library."""

import random

import public_tokenizers
import pytest

from tessera.llm.token_ids import PieceEncoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def _words(n: int) -> list[str]:
    rng = random.Random(7)
    parts = ["th", "e", "ing", "tion", "à", "É", "ß", "aaaa", "Z", "ould", "ñ", "s", "qx", "Ÿ", "ø"]
    return ["a", "É", "a" * 48, "b" * 49, "é" * 24, "é" * 30, *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(n))]


@pytest.mark.parametrize("name", FILES)
def test_words_are_merged_as_the_library_does(name):
    encoder = PieceEncoder(public_tokenizers.path(name))
    words = {x for w in _words(5000) for x in ((w, " " + w) if encoder.word.fullmatch(" a") else (w,))}
    assert encoder._fresh(words) == dict(zip(words, encoder._library_ids(list(words))))


@pytest.mark.parametrize("name", FILES)
def test_plain_words_need_no_library(name, monkeypatch):
    encoder = PieceEncoder(public_tokenizers.path(name))
    asked = []
    ids = encoder._library_ids
    monkeypatch.setattr(encoder, "_library_ids", lambda texts: asked.extend(texts) or ids(texts))
    body = " ".join(w for w in _words(500) if len(w.encode()) < 47 and "Ÿ" not in w)
    assert encoder.encode([body]) == ids([body])
    assert not asked
