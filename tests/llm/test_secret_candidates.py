"""Held-out credentials and plain strings through find_secrets."""

import random

import pytest

from tessera.llm.secret_scan import DIGIT, FORMATS, LOWER, UPPER, default_automaton, find_secrets, labelled_credentials, plain_tokens


def missed(tokens):
    return sum(not find_secrets(f"key {t}, end", default_automaton())[1] for t in tokens) / len(tokens)


@pytest.mark.parametrize("length", [20, 24, 32, 40])
@pytest.mark.parametrize("alphabet, most", [(UPPER + LOWER + DIGIT, 0.01), (LOWER + DIGIT, 0.02), (UPPER + DIGIT, 0.02), (UPPER + LOWER + DIGIT + "+/", 0.03)], ids=["mixed", "lower", "upper", "base64"])
def test_unprefixed_credentials(alphabet, most, length):
    draw = random.Random(length)
    assert missed(["".join(draw.choices(alphabet, k=length)) for _ in range(400)]) <= most


def test_held_out_formats():
    held_out = labelled_credentials(seed=77)
    assert missed(held_out) <= 0.01
    assert len(held_out) == 60 * len(FORMATS)


def test_base64_keys_are_one_span():
    key = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYzq3kW8vT0a"
    for text in (f"key {key}== end", f"(https://host.example/{key})"):
        start = text.index(key)
        spans = find_secrets(text, default_automaton())[1]
        assert len(spans) == 1 and spans[0][0] <= start and spans[0][2] >= start + len(key)


def test_plain_strings_stay():
    plain = [
        "550e8400-e29b-41d4-a716-446655440000", "UPPER_SNAKE_CASE_CONSTANT_NAME", "getElementsByClassNameAndTag2", "=" * 30, "." * 30, "x" * 30, "/usr/lib/python3.13/site-packages/numpy/core/_multiarray.so",
        "www.example.com/articles/2024/05/some-long-title.html", "Donaudampfschifffahrtsgesellschaft", "org.apache.spark.sql.catalyst.expressions", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "npm_config_registry_url_setting",
    ]
    assert [x for x in plain if find_secrets(x, default_automaton())[1]] == []
    other = [x for x in plain_tokens(seed=99, count=2000) if len(x) >= 20]
    assert sum(any(k == 3 for _, k, _ in find_secrets(x, default_automaton())[1]) for x in other) <= 0.005 * len(other)
