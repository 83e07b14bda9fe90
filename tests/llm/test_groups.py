"""Joins, files, packing and the pipeline against plain versions."""

import io
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from tessera.llm import ngram_join
from tessera.llm.common import lookup, totals_before
from tessera.llm.components import connected_components
from tessera.llm.ngram_join import drop_near_copies, ngram_components, trie_links
from tessera.llm.packing import pack
from tessera.llm.token_ids import PieceEncoder
from tessera.llm.token_store import TokenReader, TokenWriter, read_tokens, token_folder, write_tokens
from tests.llm.helpers import DATA, WORD, docs_frame, documents, edge_docs, lower, rows_of

WORD_BPE, BYTE_BPE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    own = {d: d for d in sets}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                own[max(x, y)] = min(x, y)
    return sorted(((d, len(sets[d]), find(d)) for d in sets), key=repr)


def chained_rows():
    """Chains of near copies in which the ends aren't linked, short texts and copies."""
    words = [f"t{i}" for i in range(120)]
    rows = [(10 + k, " ".join(words[4 * k : 60 + 4 * k])) for k in range(14)]
    return rows + [(100 + i, "a b c") for i in range(3)] + [(200, "A  B\tc"), (201, "a b"), (202, "a b c d e"), (203, "A b c d E")]


@pytest.mark.parametrize("rows", [edge_docs(), chained_rows(), documents(), []], ids=["edge", "chain", "table", "empty"])
def test_ngram_components(spark, rows):
    assert rows_of(ngram_components(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_ngram_components_in_slices(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SLICE_DOCS", 4)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rows = chained_rows() + edge_docs()
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert rows_of(ngram_components(docs_frame(spark, rows)), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_ngram_nulls_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (2, text + " x"), (None, None)]
    assert rows_of(ngram_components(docs_frame(spark, rows)), "doc_id", "component_id") == [(2, 2), (4, 2), (4, 2), (None, None), (None, None)]


def test_trie_links_equal_all_pairs():
    draw = np.random.default_rng(5)
    for _ in range(30):
        base = draw.integers(0, 60, 30).astype(np.uint64)
        sets = [np.unique(np.where(draw.random(30) < 0.1, draw.integers(0, 60, 30), base)).astype(np.uint64) for _ in range(int(draw.integers(2, 14)))]
        own = list(range(len(sets)))
        wanted = list(range(len(sets)))

        def join(label, a, b):
            low, high = sorted((label[a], label[b]))
            return [low if x == high else x for x in label]

        for a, b in trie_links(sets):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert 180 * both >= 80 * (len(sets[a]) + len(sets[b]))
            own = join(own, a, b)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 180 * both >= 80 * (len(sets[a]) + len(sets[b])):
                    wanted = join(wanted, a, b)
        assert own == wanted


def test_drop_near_copies(spark):
    rows = chained_rows()
    docs = docs_frame(spark, rows)
    found = drop_near_copies(docs)
    assert found.columns == docs.columns
    assert rows_of(found, "doc_id") == sorted({(c,) for _, _, c in plain_components(rows)}, key=repr)


def test_connected_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2200)]
    own = {x: x for e in edges for x in e}
    for _ in range(len(own)):
        before = dict(own)
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
        if own == before:
            break
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(found, "node", "component") == sorted(((k, v) for k, v in own.items() if k not in loops), key=repr)


def test_lookup_and_totals(spark):
    left = spark.createDataFrame([(str(i % 7) if i % 2 else "hot", i) for i in range(4000)], "key string, v long")
    right = left.groupBy("key").count()
    assert rows_of(lookup(left, right, "key", "count", 4000), "key", "v", "count") == rows_of(left.join(right, "key"), "key", "v", "count")
    rows = [(i, i % 3 if i % 5 else None, i * i) for i in range(100)]
    found = totals_before(spark.createDataFrame(rows, "o long, k long, v long"), "o", ["v"], ["k"], block=8)
    assert rows_of(found, "o", "before_v") == [(o, sum(w for p, m, w in rows if m == k and p < o)) for o, k, v in sorted(rows, key=lambda r: repr((r[0],)))]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_piece_encoder_equals_library(path):
    library, own = Tokenizer.from_file(path), PieceEncoder(path)
    texts = [t or "" for _, t in edge_docs() + documents()[:40]] + ["a  b \n\n c\t ", " x", "x ", "don't I'LL", "  <|endoftext|> a", "é\u0301 \x1c\x85\u3000漢", "word, word. Word!"]
    for _ in range(2):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_piece_encoder_beyond_its_table(monkeypatch):
    monkeypatch.setattr("tessera.llm.token_ids.MAX_KEPT", 3)
    library, own = Tokenizer.from_file(BYTE_BPE), PieceEncoder(BYTE_BPE)
    texts = ["one two, three.", "four five two six", "one, one. two"]
    for _ in range(2):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


class _Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_token_file_reads_only_wanted_frames(monkeypatch):
    monkeypatch.setattr("tessera.llm.token_store.FRAME_BYTES", 64)
    docs = [(None, [9]), (1, list(range(50))), (2, []), (2, [7, 8]), (5, [1] * 100)]
    out = _Source()
    writer = TokenWriter(out, np.dtype("<u2"))
    for d, ids in docs:
        writer.add(d, np.asarray(ids, "<u2").tobytes())
    writer.close()
    reader = TokenReader(out)
    assert [(d, x.tolist()) for d, x in reader] == docs
    assert [x.tolist() for x in reader.get(2)] == [[], [7, 8]] and reader.get(3) == []
    assert len(reader.frames) > 1
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [x for _, ids in docs for x in ids]
    broken = bytearray(out.getvalue())
    broken[int(reader.starts[0]) + 12] ^= 255
    with pytest.raises(Exception):
        list(TokenReader(_Source(bytes(broken))))


@pytest.mark.parametrize("rows", [edge_docs(), []], ids=["edge", "empty"])
def test_token_store_round_trip(spark, rows):
    library = Tokenizer.from_file(WORD_BPE)
    docs = docs_frame(spark, rows)
    found = rows_of(read_tokens(write_tokens(docs, WORD_BPE, token_folder(docs), end_id=2)), "doc_id", "start", "n_tokens", "ids")
    wanted, at = [], 0
    for d, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((d, at, len(ids), bytearray(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == sorted(wanted, key=repr)


def check_packing(found, rows, length, shards):
    library = Tokenizer.from_file(BYTE_BPE)
    coded = {d: np.asarray(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for d, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        own = coded[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert zlib.crc32(r.ids) == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for group, size in ((pieces, {d: len(x) for d, x in coded.items()}), (sequences, None)):
        for key, own in group.items():
            at = 0
            for start, n in sorted(own):
                assert start == at
                at += n
            assert size is None and at <= length or size is not None and at == size[key]
    assert set(pieces) == set(coded) and sorted(sequences) == list(range(len(sequences)))
    assert len(sequences) <= sum(map(len, coded.values())) / length + shards + 1


def test_packing(spark):
    rows = edge_docs() + [(1000 + d, t) for d, t in documents()[:50]]
    found = pack(docs_frame(spark, rows), BYTE_BPE, 1, length=64, shard_tokens=5000, least=8).collect()
    check_packing(found, rows, 64, 20)


def test_packing_holds_the_mixture(spark):
    rows = [(i, " ".join(f"x{j}" for j in range(40))) for i in range(400)]
    docs = spark.createDataFrame([(d, t, "a" if d % 4 else "b") for d, t in rows], "doc_id long, text string, source string")
    found = pack(docs, BYTE_BPE, 1, length=256, shard_tokens=1 << 14, least=16)
    per = defaultdict(lambda: [0, 0])
    for r in found.collect():
        per[r.sequence_id][0] += r.length * (r.source == "b")
        per[r.sequence_id][1] += r.length
    shares = [b / n for b, n in per.values() if n == 256]
    assert abs(np.mean(shares) - 0.25) < 0.02
    assert np.mean([abs(s - 0.25) < 0.1 for s in shares]) > 0.9


def test_packing_holds_a_mixture_unlike_the_corpus(spark):
    """0.8 to 0.2 over a corpus of 0.5 to 0.5: while both last, then one source alone; a source without a target comes last."""
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=draw.randrange(5, 120)))) for i in range(4000)]
    docs = spark.createDataFrame([(d, t, "ab"[d % 2] if d % 21 else "c") for d, t in rows], "doc_id long, text string, source string")
    shares = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "source string, share double")
    found = pack(docs, BYTE_BPE, 1, length=256, shares=shares, shard_tokens=1 << 14, least=16).collect()
    check_packing(found, rows, 256, 60)
    windows = defaultdict(Counter)
    for r in found:
        windows[r.sequence_id][r.source] += r.length
    ordered = [windows[k] for k in sorted(windows)]
    last_of = {s: max(k for k, w in enumerate(ordered) if w[s]) for s in "abc"}
    assert last_of["a"] < last_of["b"] and min(k for k, w in enumerate(ordered) if w["c"]) >= last_of["b"] - 2
    both = ordered[: last_of["a"] - 2]
    assert len(both) > 500 and sum(w["a"] for w in both) / sum(w.total() for w in both) == pytest.approx(0.8, abs=0.01)
    assert all(sum(w["a"] for w in both[k : k + 8]) / sum(w.total() for w in both[k : k + 8]) == pytest.approx(0.8, abs=0.05) for k in range(len(both) - 8))
    with pytest.raises(ValueError):
        pack(docs, BYTE_BPE, 1, shares=shares.union(shares))


def test_packing_empty(spark):
    assert pack(docs_frame(spark, edge_docs()).limit(0), BYTE_BPE, 1).count() == 0


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline as p
    from tessera.llm.quality_rules import quality_rules

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = dict(documents())
    one, two, three, four, _ = (f for _, f in p.STAGES)
    good = one(spark, docs, DATA)
    assert good.columns == docs.columns
    kept = {d for (d,) in rows_of(quality_rules(docs).filter("kept"), "doc_id")}
    assert {r.doc_id for r in good.collect()} == kept
    last = {}
    for d in sorted(kept):
        last[texts[d]] = d
    single = two(spark, good, DATA)
    assert {r.doc_id for r in single.collect()} == set(last.values()) and single.columns == docs.columns
    ids = {c for _, _, c in plain_components([(d, texts[d]) for d in last.values()])}
    near = three(spark, single, DATA)
    assert {r.doc_id for r in near.collect()} == ids and near.columns == docs.columns
    clean = four(spark, near, DATA)
    assert clean.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    check_packing(p.run(spark, DATA).collect(), rows, 2048, 3)
