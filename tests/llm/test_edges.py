"""Null and repeated ids, null, empty and very long texts, empty tables and clashing names, for every operator and stage."""

import random
import resource
import subprocess
import sys

import public_tokenizers
import pytest

import corpus_pipeline
from tessera.llm import quality_classifier as quality
from tessera.llm.bpe import bpe_digest
from tessera.llm.exact_dedup import drop_copies, exact_dedup
from tessera.llm.license_scan import license_scan, scan_words
from tessera.llm.ngram_join import drop_near_copies, ngram_components
from tessera.llm.packing import pack
from tessera.llm.quality_rules import keep_clean, quality_rules
from tessera.llm.secret_scan import default_automaton, find_secrets, redact, secret_scan
from tessera.llm.token_store import read_tokens, token_folder, write_tokens
from tessera.llm.url_filter import url_filter

WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
_draw = random.Random(1)
LONG = "\n".join(" ".join(f"w{_draw.randrange(9000)}" for _ in range(30)) + ". All rights reserved, token = abcdefghijkl0123." for _ in range(5000))
ROWS = [(None, None), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (7, "other words here"), (8, ""), (9, LONG), (10, LONG + " end"), (11, "Ü\x00 ｆｕｌｌ 漢字")]


def frame(spark, rows=ROWS, more=()):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in more)
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), *more) for d, t in rows], schema)


def scores(docs):
    labels = docs.sparkSession.createDataFrame([(7, 1), (7, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    return quality.quality_scores(docs, quality.train_on(docs, labels))


def stored(docs):
    return read_tokens(write_tokens(docs, WORD_BPE, token_folder(docs), end_id=2))


@pytest.mark.parametrize("operator", [license_scan, secret_scan, lambda d: bpe_digest(d, WORD_BPE), quality_rules, scores, exact_dedup, ngram_components, stored], ids=["license", "secret", "bpe", "rules", "quality", "dedup", "ngram", "store"])
def test_a_row_for_each_row(spark, operator):
    found = operator(frame(spark)).collect()
    assert sorted((r.doc_id for r in found), key=repr) == sorted((d for d, _ in ROWS), key=repr)
    assert operator(frame(spark).limit(0)).count() == 0


def test_equal_rows_are_scanned_alike(spark):
    for operator, column in ((license_scan, "n_words"), (secret_scan, "base_sha256"), (lambda d: bpe_digest(d, WORD_BPE), "ids_sha256"), (quality_rules, "n_words")):
        seven = sorted(str(r[column]) for r in operator(frame(spark)).filter("doc_id = 7").collect())
        assert len(seven) == 3 and len(set(seven)) == (1 if operator is secret_scan else 2)


def test_long_texts_are_whole(spark):
    found = {r.doc_id: r for r in license_scan(frame(spark)).filter("doc_id >= 9").collect()}
    assert len(LONG) > 900_000 and found[9].n_base == 5000 and found[9].last_word > 170_000
    assert {r.doc_id: r.n_assign for r in secret_scan(frame(spark)).filter("doc_id >= 9").collect()} == {9: 5000, 10: 5000, 11: 0}
    joined = {r.doc_id: r.component_id for r in ngram_components(frame(spark)).filter("doc_id >= 9").collect()}
    assert joined == {9: 9, 10: 9, 11: 11}


def test_pack_takes_null_and_repeated_ids(spark):
    pieces = pack(frame(spark), BYTE_BPE, 1, length=128, shard_tokens=4096).collect()
    assert {r.doc_id for r in pieces} == {None, 7, 8, 9, 10, 11}
    # two documents with a null id, three with the id 7
    assert sum(r.start == 0 for r in pieces if r.doc_id is None) == 2 and sum(r.start == 0 for r in pieces if r.doc_id == 7) == 3
    assert pack(frame(spark).limit(0), BYTE_BPE, 1).count() == 0


def test_urls_with_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.net/fr/" + "x" * 500_000), (1, "http://a.net/fr/"), (None, "http://www.example.com/en/")], "page_id long, url string")
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in url_filter(pages).collect()) == [("1", "net/fr/", "block"), ("1", "net/fr/", "block"), ("None", "None", "allow"), ("None", "www.example.com/en/", "allow")]


CLASHING = ("_gone", "gone", "a.b", "_text", "row", "kept", "shard", "deal", "class", "c0", "_id", "_sha", "component_id", "ids")


@pytest.mark.parametrize("stage", [keep_clean, drop_copies, drop_near_copies, redact], ids=["rules", "copies", "near", "redact"])
def test_stages_keep_all_columns(spark, stage):
    long_enough = " ".join(f"word{i}" for i in range(60)) + "."
    docs = frame(spark, [*ROWS, (20, long_enough), (21, long_enough + " token=abcdefghijklmn")], CLASHING)
    found = stage(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = found.collect()
    assert {r.doc_id for r in rows} >= {9, 20} and all(r["a.b"] == "a.b" and r["_gone"] == "_gone" for r in rows)
    assert stage(docs.limit(0)).count() == 0


def test_an_empty_table_and_edges_through_all_stages(spark, tmp_path):
    for name, docs in (("edges", frame(spark, ROWS, CLASHING)), ("empty", frame(spark).limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} == ({9} if name == "edges" else set())


def test_credentials_leave_nothing_and_names_stay(spark):
    token = "ghp_Zx9Q0123456789abcdefKqLmNoPqRsTuVwXyZ012"
    found = redact(frame(spark, [(1, f"use {token} here"), (2, f"key={token}0123456789abcdef.")])).collect()
    assert [r.text for r in sorted(found)] == ["use [SECRET] here", "key=[SECRET]."]
    for plain in ("getUserProfileByIdAndRegion2024V1AbC3", "XMLHttpRequestFactoryBuilder20241122", "ThisIsAVeryLongCamelCaseIdentifier12345"):
        assert find_secrets(f"call {plain}()", default_automaton()) == ([], [])
    base, every = find_secrets(token, default_automaton())
    assert base == [(8, 2, 24)] and base[0] in every and (0, 3, len(token)) in every


def test_detections_are_the_widest_of_their_priority():
    text = b"licensed under the gnu general public license version 3 or later and the mit license; gnu general public license"
    base, found = scan_words(text)
    assert [at for at, _ in base] == [4, 16] and [(s, e, r.label) for s, e, r in found][0] == (0, 9, "gpl")
    assert not any(a is not b and a[0] <= b[0] and b[1] <= a[1] and a[2].priority >= b[2].priority and (a[0], a[1]) != (b[0], b[1]) for a in found for b in found)


def test_a_large_block_is_walked_in_little_memory():
    """2,500 near copies of 400 shingles."""
    code = (
        "import resource, numpy as np; from tessera.llm.ngram_join import trie_walk\n"
        "g = np.random.default_rng(1); base = g.integers(0, 1 << 63, 400).astype(np.uint64); sets = []\n"
        "for k in range(2500):\n    x = base.copy(); x[g.integers(0, 400, 12)] = g.integers(0, 1 << 63, 12); sets.append(np.unique(x))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nn = sum(len(l) for _, l, _ in trie_walk(sets, every=True))\n"
        "assert n == 2500 * 2499 // 2, n\nassert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000"
    )
    assert resource.RUSAGE_SELF == 0
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
