"""N-gram Jaccard self-join by prefix trees, and the components of its links.

A document's set is its distinct word shingles, as 64-bit hashes. All documents share one order of shingles:
rarer ones first, by a count over the whole corpus, then by hash. Two sets of the wanted similarity must meet
in the first shingles of that order (the prefix), so documents that meet nowhere else are left out at once.
Documents that meet in prefixes, directly or in a chain, form a block; blocks are found as connected
components. Within a block the sets, in the same order from its common end, are kept as a prefix tree that is walked once with
the overlaps of the path and every document of the block, which all sets below a node share; a subtree is left as
soon as no document can reach the wanted overlap with the shingles that remain, or all that could are linked already.

Equal sets are one set to all of this, so copies cost nothing. Shingles that many documents hold come last
in the order, so they put documents in one block only if little else is in them. Blocks above a size
are split into pairs of slices, whose links are joined by another pass of connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, lookup, materialize, release_memory, utf8_of
from tessera.llm.components import connected_components

SHINGLE_WORDS = 5
#: Linked if PERCENT_OF * intersection >= PERCENT * union.
PERCENT, PERCENT_OF = 80, 100
#: A shingle slot in so many documents' sets or more counts as common. At most MAX_COMMON common slots are
#: put in order by count; they only order shingles, so the bound on this broadcast changes no result.
COMMON, MAX_COMMON = 8, 1_000_000
#: Shingles that one task counts or matches, and shingles or documents of a block in one slice.
TASK_SHINGLES = 2_000_000
BYTES_PER_SHINGLE = 6
POSTINGS, BUNDLE_SHINGLES = 300_000, 400_000
SLICE_SHINGLES, SLICE_DOCS = 1_000_000, 8_000
#: Bytes of text that are shingled at once; a longer text is on its own.
CHUNK_BYTES = 1 << 19
#: Documents whose overlaps one step of the walk changes, with repeats.
STEP = 200_000
#: Most rows of three numbers that are broadcast.
MAX_BROADCAST_ROWS = 500_000

_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _inverse_base() -> np.uint64:
    return np.uint64(pow(int(_BASE), -1, 1 << 64))


def _power_tables(n: int) -> list[np.ndarray]:
    """The base's powers and its inverse's, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _inverse_base())):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and text number of every word of the texts in `flat`, A-Z lower-cased."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[flat]
    edge = np.zeros(len(flat), bool)
    edge[offsets[:-1][offsets[:-1] < len(flat)]] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | np.concatenate([edge[1:], [True]]))) + 1
    up, down = _power_tables(len(flat) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[flat] + np.uint64(1)) * up[: len(flat)])])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX_2)
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and text numbers, in order of both; a text with fewer words has one of all its words."""
    own, doc = word_hashes(flat, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= words, counts - words + 1, 0)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        h = _mix(h * _BASE + own[at + k] + np.uint64(k + 1))
    docs = np.repeat(np.arange(n_docs), n)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        tails = []
        for d in short:
            x = np.zeros(1, np.uint64)
            for w in own[first[d] : first[d] + counts[d]]:
                x = _mix(x * _MIX_1 + w + np.uint64(counts[d]))
            tails.append(x[0])
        h, docs = np.concatenate([h, np.asarray(tails, np.uint64)]), np.concatenate([docs, short])
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
    return h[new], docs[new]


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, row numbers from the first) of runs of rows with CHUNK_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
        h, doc = shingle_sets(*utf8_of(column[start:end]), words)
        yield start, end, h, doc
        start = end


def _sums(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two sums of mixed hashes of each set, which with its size identify it."""
    sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)]) for x in (h, _mix(h ^ _BASE)))
    return [(x[ends[1:]] - x[ends[:-1]]).view(np.int64) for x in sums]


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit numbers as compressed gaps, byte plane by byte plane."""
    gaps = np.diff(x, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _bucket_of(slots: np.ndarray, buckets: int) -> np.ndarray:
    return ((slots.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _scan(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """Two kinds of rows. With a doc_id: its set's size and two sums that identify it. With a bucket: packed slots of many sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def slots() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint32)
            held.clear()
            cuts = np.searchsorted(_bucket_of(every, buckets), np.arange(buckets + 1))
            rows = [(b, _pack_numbers(every[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=names)

        for batch in batches:
            for i, j, h, doc in sets_of(batch.column(1), words):
                n = np.bincount(doc, minlength=j - i)
                sums = _sums(h, np.concatenate([[0], np.cumsum(n)]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), *map(pa.array, sums), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.binary())], names=names)
                held.append(_slot(h))
                if sum(map(len, held)) >= TASK_SHINGLES:
                    yield slots()
        if held:
            yield slots()
        release_memory()

    names = ["doc_id", "n", "s1", "s2", "bucket", "packed"]
    return docs.mapInArrow(scan, "doc_id long, n long, s1 long, s2 long, bucket long, packed binary")


def _common_slots(packed: DataFrame) -> DataFrame:
    """(slot, count) of the slots that COMMON or more sets hold."""

    def count(table: pa.Table) -> pa.Table:
        slots = np.sort(np.concatenate([_unpack_numbers(x) for x in table.column("packed").to_pylist()]))
        starts = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        counts = np.diff(np.append(starts, len(slots)))
        keep = counts >= COMMON
        return pa.table({"slot": pa.array(slots[starts][keep].astype(np.int64)), "count": pa.array(counts[keep].astype(np.int64))})

    return packed.groupBy("bucket").applyInArrow(count, "slot long, count long")


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles a set of n must share one of, with any set it is linked with."""
    return n - (percent * n + PERCENT_OF - 1) // PERCENT_OF + 1


class _Order:
    """Places shingles in the corpus-wide order."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        self.slots, self.counts = slots, counts

    def count(self, h: np.ndarray) -> np.ndarray:
        """The count of each hash's slot, 0 if it isn't common."""
        if not len(self.slots):
            return np.zeros(len(h), np.int64)
        slot = _slot(h)
        at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.where(self.slots[at] == slot, self.counts[at], 0)


def _postings(docs: DataFrame, order, buckets: int, words: int, percent: int) -> DataFrame:
    """Packed (shingle, size, doc_id, number of common shingles in the prefix) of the prefixes, by bucket. Of equal sets in one task only the first counts."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen, held, size = order.value, set(), [], 0

        def packed() -> pa.RecordBatch:
            nonlocal size
            h, n, d, c = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = 0
            by = np.argsort(h, kind="stable")
            h, n, d, c = h[by], n[by], d[by], c[by]
            ids, place = np.unique(d, return_inverse=True)
            sizes, common = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            sizes[place], common[place] = n, c
            cuts = np.searchsorted(_bucket_of(_slot(h), buckets), np.arange(buckets + 1))
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = []
            for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
                if j > i:
                    own, at = np.unique(place[i:j], return_inverse=True)
                    rows.append((b, h[i:j].tobytes(), pack(at.astype("<u4").tobytes()), pack(np.diff(ids[own], prepend=0).astype("<i8").tobytes()), pack(sizes[own].astype("<i8").tobytes()), pack(common[own].astype("<i8").tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 5)], names=names)

        for batch in batches:
            for i, j, h, doc in sets_of(batch.column(1), words):
                n = np.bincount(doc, minlength=j - i)
                ends = np.concatenate([[0], np.cumsum(n)])
                fresh = np.zeros(j - i, bool)
                for k, key in enumerate(zip(*(x.tolist() for x in _sums(h, ends)))):
                    if n[k] and key not in seen:
                        fresh[k] = True
                        seen.add(key)
                counts = rank.count(h)
                by = np.lexsort((h, counts, doc))
                place = np.arange(len(h)) - ends[doc]
                first = place < _prefix_length(n, percent)[doc]
                common = np.bincount(doc[first & (counts[by] > 0)], minlength=j - i)
                keep = fresh[doc] & first
                ids = batch.column(0)[i:j].to_numpy(zero_copy_only=False)
                held.append((h[by][keep], n[doc][keep], ids[doc][keep], common[doc][keep]))
                size += len(held[-1][0])
                if size >= POSTINGS:
                    yield packed()
        if size:
            yield packed()
        seen.clear()
        release_memory()

    names = ["bucket", "h", "at", "ids", "sizes", "common"]
    return docs.mapInArrow(post, "bucket long, h binary, at binary, ids binary, sizes binary, common binary")


def _meetings(postings: DataFrame, percent: int, common: int) -> DataFrame:
    """(a, b) of documents that may be linked, directly or through others.

    A shingle in fewer than `common` prefixes gives all pairs of its documents, of which each is one shared
    prefix shingle. Linked sets share more than their prefixes must: what lies beyond the shorter-reaching prefix can add
    no more than its rest, so the prefixes share at least the wanted overlap less the larger rest. Shingles of more
    prefixes are common ones, counted for each set, and may all be shared. Pairs that can't reach this are out.
    A common shingle gives each document with the first of its run: documents in order of size, a run ending
    where the next size is too large for a link.
    """

    def meet(table: pa.Table) -> pa.Table:
        take = zstandard.ZstdDecompressor().decompress
        parts = []
        for row in table.to_pylist():
            at = np.frombuffer(take(row["at"]), "<u4")
            ids, sizes, own = np.cumsum(np.frombuffer(take(row["ids"]), "<i8")), np.frombuffer(take(row["sizes"]), "<i8"), np.frombuffer(take(row["common"]), "<i8")
            parts.append((np.frombuffer(row["h"], np.uint64), ids[at], sizes[at], own[at]))
        h, d, n, c = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(h, kind="stable")
        h, d, n, c = h[by], d[by], n[by], c[by]
        same = h[1:] == h[:-1]
        several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, d, n, c = h[several], d[several], n[several], c[several]
        by = np.lexsort((d, n, h))
        h, d, n, c = h[by], d[by], n[by], c[by]
        lists = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        place = np.cumsum(lists) - 1
        large = np.bincount(place)[place] >= common if len(h) else lists
        runs = lists.copy()
        runs[1:] |= PERCENT_OF * n[:-1] < percent * n[1:]
        first = np.maximum.accumulate(np.where(runs, np.arange(len(h)), 0))
        i, j = first[large], np.flatnonzero(large)
        found = [(d[i], d[j], np.zeros(len(i), np.int64))]
        for step in range(1, common):
            i = np.flatnonzero(~large[: len(h) - step] & (h[: len(h) - step] == h[step:]) & (PERCENT_OF * n[: len(h) - step] >= percent * n[step:])) if step < len(h) else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + step
            rest = np.maximum(n[i] - _prefix_length(n[i], percent), n[j] - _prefix_length(n[j], percent))
            need = -(-percent * (n[i] + n[j]) // (PERCENT_OF + percent))
            found.append((d[i], d[j], need - rest - np.minimum(c[i], c[j])))
        a, b, wanted = (np.concatenate(x) for x in zip(*found))
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b, wanted = a[a != b], b[a != b], wanted[a != b]
        by = np.lexsort((wanted, b, a))
        a, b, wanted = a[by], b[by], wanted[by]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        shared = np.diff(np.append(new, len(a)))
        return pa.table({"a": pa.array(a[new].astype(np.int64)), "b": pa.array(b[new].astype(np.int64)), "shared": pa.array(shared.astype(np.int64)), "wanted": pa.array(wanted[new].astype(np.int64))})

    met = postings.groupBy("bucket").applyInArrow(meet, "a long, b long, shared long, wanted long")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("wanted").alias("wanted")).filter("shared >= wanted").select("a", "b")


def trie_links(sets: list[np.ndarray], percent: int = PERCENT, split: int | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links (i, j) between sets of hashes that join all that are linked, directly or in a chain; with `every`, all links."""
    return [(i, int(j)) for i, linked, joining in trie_walk(sets, percent, split, every) for j in (linked if every else joining)]


def trie_walk(sets: list[np.ndarray], percent: int = PERCENT, split: int | None = None, every: bool = False, count: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(i, sets linked with i, those of them that weren't joined with i before) for sets of hashes.

    Sets already joined with i are left out of the walk, unless `every` link is wanted, which then comes once.
    With `split`, links among the sets before that number, or among those after it, aren't needed. `count` gives the
    corpus-wide counts of hashes. The sets' paths follow the corpus-wide order from its common end, so that sets share
    long paths. A walk over their prefix tree adds each edge's shingles to the overlaps of all sets and takes them off
    again on the way back. A subtree is left where no set can reach the overlap that its smallest set would want
    with the shingles that remain to its longest.
    """
    n = np.array([len(s) for s in sets], np.int64)
    g = len(sets)
    if g < 2:
        return
    different, token, holding = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g, dtype=np.int32), n)
    shared = holding[token] > 1  # a shingle of one set adds to no overlap
    place = np.empty(len(different), np.int32)
    place[np.lexsort((different, -count(different)) if count else (different,))] = np.arange(len(different), dtype=np.int32)
    token, owner = place[token[shared]], owner[shared]
    by = np.lexsort((owner, token))
    holders, placed = owner[by], token[by]
    bounds = np.searchsorted(placed, np.arange(len(different) + 1))
    by = np.lexsort((token, owner))
    ends, placed = np.searchsorted(owner[by], np.arange(g + 1)), token[by]
    paths = [placed[ends[i] : ends[i + 1]] for i in range(g)]
    rank = np.array(sorted(range(g), key=lambda i: paths[i].astype(">u4").tobytes()), np.int64)
    length = ends[1:] - ends[:-1]
    common = np.zeros(g, np.int64)  # how many first shingles a path shares with the one before it in this order
    for k in range(1, g):
        a, b = paths[rank[k - 1]], paths[rank[k]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[k] = int(differ[0]) if len(differ) else m
    overlap, number, label = np.zeros(g, np.int64), np.arange(g), np.arange(g)
    waiting = np.ones(g, bool)

    def step(tokens: np.ndarray, sign: int) -> None:
        low, size = bounds[tokens], bounds[tokens + 1] - bounds[tokens]
        total = np.cumsum(size)
        start = 0
        while start < len(tokens):  # as many tokens at once as STEP holders allow
            done = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, done + STEP, "right")))
            own = size[start:end]
            at = np.repeat(low[start:end] - (total[start:end] - own - done), own) + np.arange(int(own.sum()))
            overlap[:] += sign * np.bincount(holders[at], minlength=g)
            start = end

    def wanted(members: np.ndarray) -> np.ndarray:
        """The sets that a member may be linked with, by what is known before the walk."""
        least, most = n[members].min(), n[members].max()
        found = (PERCENT_OF * n >= percent * least) & (percent * n <= PERCENT_OF * most)
        if every:
            found &= waiting
        elif (label[members] == label[members[0]]).all():
            found &= label != label[members[0]]
        if split is not None and ((members < split) == (members[0] < split)).all():
            found &= (number < split) != (members[0] < split)
        return found

    def walk(members: np.ndarray, path: np.ndarray, at: int, end: int) -> tuple[int, bool]:
        """Where the walk along a path came to, and whether a member may still reach a link."""
        own = wanted(members)
        need = -(-percent * (n + n[members].min()) // (PERCENT_OF + percent))  # least overlap of a link
        longest = int(length[members].max())
        while (own & (overlap + (longest - at) >= need)).any():
            if at == end:
                return at, True
            to = min(end, at + max(32, at))
            step(path[at:to], 1)
            at = to
        return at, False

    def leaf(i: int) -> tuple[int, np.ndarray, list[int]] | None:
        """The links of a set whose whole path is in the overlaps."""
        one = np.array([i])
        waiting[i] = False
        linked = np.flatnonzero(wanted(one) & (overlap >= -(-percent * (n + n[i]) // (PERCENT_OF + percent))))
        linked = linked[linked != i]
        joining = []
        for j in linked[label[linked] != label[i]].tolist():
            if label[j] != label[i]:
                joining.append(j)
                label[label == label[j]] = label[i]
        return (i, linked, joining) if len(linked) else None

    todo: list[tuple] = [(0, g, 0)]
    while todo:
        low, *rest = todo.pop()
        if len(rest) == 1:  # the way back
            step(low[rest[0] :], -1)
            continue
        high, start = rest
        members = rank[low:high]
        path = paths[members[0]]
        end = int(common[low + 1 : high].min()) if high - low > 1 else len(path)
        at, alive = walk(members, path, start, end)
        if at > start:
            todo.append((path[:at], start))
        if not alive:
            waiting[members] = False
            continue
        cuts = [low, *(low + 1 + np.flatnonzero(common[low + 1 : high] == end)).tolist(), high]
        below = []
        for i, j in zip(cuts, cuts[1:]):
            if j - i == 1 and length[rank[i]] == end:
                if (found := leaf(int(rank[i]))) is not None:
                    yield found
            else:
                below.append((i, j, end))
        todo += below[::-1]


def ngram_components(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: the smallest doc_id that links reach, its own included.

    With `count_links` also n_links, the number of other documents that one is linked with, copies included.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Null text counts as
    empty; a text without words has an empty set and no link, one with fewer words than a shingle has one
    shingle of all. doc_id is a non-negative integer, unique but for repeated rows, which come out repeated; a
    null doc_id links with nothing and has a null component. Other columns are ignored; an empty table
    gives an empty one. Shingles are compared by 64-bit hash, so a very long text costs 8 bytes a word.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4, size // (BYTES_PER_SHINGLE * TASK_SHINGLES))
    scanned = materialize(_scan(own, buckets, words), "ngram-scan")
    sized = scanned.filter("bucket IS NULL").select("doc_id", "n", "s1", "s2")
    common = materialize(_common_slots(scanned.filter("bucket IS NOT NULL").select("bucket", "packed")), "ngram-common")
    least = COMMON
    while common.filter(F.col("count") >= least).count() > MAX_COMMON:
        least *= 2
    rows = common.filter(F.col("count") >= least).toArrow().to_pandas().sort_values("slot")
    order = docs.sparkSession.sparkContext.broadcast(_Order(rows["slot"].to_numpy().astype(np.uint32), rows["count"].to_numpy().astype(np.int64)))
    meetings = materialize(_meetings(_postings(own.filter("doc_id IS NOT NULL"), order, buckets, words, percent), percent, least), "ngram-meetings")

    # one row for each different set that a document has; its smallest doc_id stands for all
    filled = sized.filter("n > 0 AND doc_id IS NOT NULL").withColumn("key", F.struct("s1", "s2", "n"))
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *([F.count_distinct("doc_id").alias("docs")] if count_links else [F.lit(1).cast("long").alias("docs")]))
    total = sized.count()
    met = meetings.select("a").union(meetings.select("b")).distinct()
    met_reps = materialize(met.join(filled, F.col("a") == F.col("doc_id")).select("a", "key").join(classes, "key").select("a", "rep", F.col("key.n").alias("n"), "docs").distinct(), "ngram-met")
    reps = met_reps.select("a", "rep")
    edges = meetings.join(reps.withColumnRenamed("rep", "x"), "a").join(reps.select(F.col("a").alias("b"), F.col("rep").alias("y")), "b")
    blocks = connected_components(edges.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    members = blocks.join(met_reps.select(F.col("rep").alias("node"), "n", "docs").distinct(), "node")
    links = _block_links(own, materialize(members, "ngram-blocks"), order, words, percent, count_links)
    joined = connected_components(links.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("rep"), "component")
    classes = classes.join(joined, "rep", "left")
    if count_links:
        classes = classes.join(links.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links")), "rep", "left")
    more = [(F.coalesce("n_links", F.lit(0)) + F.col("docs") - 1).alias("n_links")] if count_links else []
    classes = classes.select("key", "copies", F.coalesce("component", "rep").alias("component_id"), *more)
    sure = materialize(filled.select("doc_id", "key"), "ngram-keys")
    linked = lookup(sure, classes, "key", "copies", total).select("doc_id", F.col("key.n").alias("n_shingles"), "component_id", *(["n_links"] if count_links else []))
    rest = sized.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if count_links else []))
    return linked.unionByName(rest)


def _block_links(own: DataFrame, members: DataFrame, order, words: int, percent: int, count_links: bool = False) -> DataFrame:
    """(a, b, null) links that join all linked documents of each block; with count_links also (a, null, n_links), to be added up by a.

    members: node, component (its block), n, docs (how many have this set). A block that fits goes to one task. A larger one is cut by set size into
    slices, and each pair of slices whose sizes allow a link goes to a task.
    """
    totals = members.groupBy("component").agg(F.sum("n").alias("_shingles"), F.count(F.lit(1)).alias("_docs"))
    slices = F.greatest(F.ceil(F.col("_shingles") / SLICE_SHINGLES), F.ceil(F.col("_docs") / SLICE_DOCS))
    large = materialize(totals.withColumn("slices", slices).filter("slices > 1").select("component", "slices"), "ngram-large")
    bundles = max(1, (members.agg(F.sum("n")).first()[0] or 0) // BUNDLE_SHINGLES)
    bundle = F.pmod(F.xxhash64("component"), F.lit(bundles))
    placed = members.join(large, "component", "left_anti").select("node", "docs", "component", bundle.alias("bundle"), F.lit(0).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"), F.lit(True).alias("left"))
    if not large.isEmpty():
        placed = placed.unionByName(_slice_pairs(members.join(large, "component"), percent))
    placed = materialize(placed.withColumnRenamed("node", "doc_id"), "ngram-places")
    # a few bytes for each document in a block: broadcast while that is small, else the texts are shuffled
    shipped = own.join(F.broadcast(placed) if placed.count() <= MAX_BROADCAST_ROWS else placed, "doc_id")

    def link(table: pa.Table) -> pa.Table:
        found, numbers = [], []
        blocks = table.column("component").to_numpy()
        for block in np.unique(blocks):
            own_rows = table.filter(pa.array(blocks == block))
            ids, first = np.unique(own_rows.column("doc_id").to_numpy(), return_index=True)
            own_rows = own_rows.take(pa.array(first))
            sets = []
            for i, j, h, doc in sets_of(pa.chunked_array(own_rows.column("text")).combine_chunks(), words):
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                sets += [h[cuts[k] : cuts[k + 1]] for k in range(j - i)]
            left = own_rows.column("left").to_numpy(zero_copy_only=False)
            by = np.argsort(~left, kind="stable")
            docs, n_links = own_rows.column("docs").to_numpy()[by], np.zeros(len(by), np.int64)
            for x, linked, joining in trie_walk([sets[k] for k in by], percent, None if left.all() else int(left.sum()), count_links, order.value.count):
                n_links[x] += docs[linked].sum()
                n_links[linked] += docs[x]
                found += [(int(ids[by[x]]), int(ids[by[y]]), None) for y in joining]
            if count_links:
                numbers += [(int(ids[by[k]]), None, int(n_links[k])) for k in np.flatnonzero(n_links)]
        a, b, n = zip(*found, *numbers) if found or numbers else ((), (), ())
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array(n, pa.int64())})

    return materialize(shipped.groupBy("bundle", "i", "j").applyInArrow(link, "a long, b long, n_links long"), "ngram-links")


def _slice_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Rows of _block_links for large blocks: each document once for every pair of slices its slice is in.

    Slices follow the set sizes by quantile; of a size that fills several, documents are spread by hash.
    """
    edges = members.groupBy("component").agg(F.first("slices").alias("slices"), F.expr("percentile_approx(n, array(0.05,0.1,0.15,0.2,0.25,0.3,0.35,0.4,0.45,0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95))").alias("cuts"))
    band = F.size(F.filter("cuts", lambda c: c < F.col("n")))
    within = F.ceil(F.col("slices") / 10).cast("long")
    sliced = members.drop("slices").join(edges, "component").withColumn("slice", band * within + F.pmod(F.xxhash64("node"), within))
    sliced = materialize(sliced.select("node", "docs", "component", "n", F.col("slice").cast("long").alias("slice")), "ngram-slices")
    sizes = sliced.groupBy("component", "slice").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one, two = sizes.alias("one"), sizes.alias("two")
    near = (F.col("one.slice") <= F.col("two.slice")) & (F.col("one.high") * PERCENT_OF >= F.col("two.low") * percent) & (F.col("two.high") * PERCENT_OF >= F.col("one.low") * percent)
    pairs = materialize(one.join(two, (F.col("one.component") == F.col("two.component")) & near).select(F.col("one.component").alias("component"), F.col("one.slice").alias("i"), F.col("two.slice").alias("j")), "ngram-slice-pairs")
    as_left = sliced.join(pairs, (sliced["component"] == pairs["component"]) & (F.col("slice") == F.col("i"))).select("node", "docs", pairs["component"], pairs["component"].alias("bundle"), "i", "j", F.lit(True).alias("left"))
    as_right = sliced.join(pairs.filter("i <> j"), (sliced["component"] == pairs["component"]) & (F.col("slice") == F.col("j"))).select("node", "docs", pairs["component"], pairs["component"].alias("bundle"), "i", "j", F.lit(False).alias("left"))
    return as_left.unionByName(as_right)


def drop_near_copies(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of its component, or null.

    Null and empty texts link with nothing and stay; of repeated rows, which share a doc_id, all stay or all go;
    an empty table gives an empty one; a text may have any length, as it is shingled by its words' hashes.
    """
    found = ngram_components(docs, words, percent, doc_id, text)
    key = free_name(docs, "gone")
    gone = materialize(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    return docs.join(gone, F.col(f"`{doc_id}`") == F.col(key), "left_anti")
