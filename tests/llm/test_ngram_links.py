"""All links of the n-gram join against all pairs."""

import numpy as np
import pytest

from tessera.llm import ngram_join
from tessera.llm.ngram_join import ngram_components, trie_links
from tests.llm.helpers import BASE_TEXT, docs_frame, documents, edge_docs, lower, rows_of
from tests.llm.helpers import WORD


def plain_links(rows):
    sets = {}
    for d, t in rows:
        words = WORD.findall(lower(t or ""))
        sets[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    holders = {}
    for d, own in sets.items():
        for x in own:
            holders.setdefault(x, set()).add(d)
    met = {d: set().union(*(holders[x] for x in own)) - {d} if own else set() for d, own in sets.items()}
    return sorted(((d, sum(100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in met[d])) for d in sets), key=repr)


def clique(k):
    words = BASE_TEXT.split()
    return [(5000 + i, " ".join(words[:60] + [f"own{i}"])) for i in range(k)]


@pytest.mark.parametrize("rows", [edge_docs() + clique(7) + [(6000, clique(1)[0][1])], documents(), []], ids=["edge", "table", "empty"])
def test_numbers_of_links(spark, rows):
    assert rows_of(ngram_components(docs_frame(spark, rows), count_links=True), "doc_id", "n_links") == plain_links(rows)


def test_numbers_of_links_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_DOCS", 4)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rows = clique(25) + edge_docs()
    docs = docs_frame(spark, rows)
    assert rows_of(ngram_components(docs.union(docs), count_links=True).distinct(), "doc_id", "n_links") == plain_links(rows)


def test_every_link_of_the_walk():
    draw = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(40), draw.integers(40, 60, 4)])).astype(np.uint64) for _ in range(30)]
    linked = {(i, j) for i in range(30) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    found = trie_links(sets, every=True)
    assert len(found) == len(linked) > 30 and {(max(x), min(x)) for x in found} == linked
    assert len(trie_links(sets)) < 30
