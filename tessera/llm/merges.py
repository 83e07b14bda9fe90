"""Byte-pair merges of many words at once.

In each round every word makes one merge, that of the lowest rank and of these the leftmost, as the tokenizers library
does word by word. Words are the columns of a matrix and lose a symbol a round, until they are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.bpe import byte_characters

#: Words of up to so many bytes make a matrix together; the last is the longest word that is merged here.
WIDTHS = (0, 4, 7, 10, 14, 20, 32, 48)
LONGEST = WIDTHS[-1]
#: Bits of a pair's place beside its rank, the rank of pairs that don't merge, and no symbol.
PLACE_BITS, NO_RANK, NONE = 6, 1 << 24, -2
NO_ORDER = NO_RANK << PLACE_BITS
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordMerger:
    """Merges of a tokenizer file's BPE model over all bytes, with or without a mark at a word's end."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.final = np.array([vocab[c + end] for c in byte_characters()], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # an open hash table of pairs, at most a quarter full; a pair that is given twice has its last rank, as in the library
        self.bits = max(10, (4 * len(pairs)).bit_length())
        keys = self._key(np.array([vocab[a] for a, _ in pairs], np.int32), np.array([vocab[b] for _, b in pairs], np.int32))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_RANK, np.int32)
        last, slots = {}, {}
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            if key not in last:
                while at in slots:
                    at = (at + 1) % (1 << self.bits)
                slots[at], last[key] = key, at
            self.keys[last[key]], self.ranks[last[key]] = key, rank

    @staticmethod
    def fits(model: dict) -> bool:
        """Whether the model merges by rank only and knows all bytes."""
        vocab, end = model.get("vocab", {}), model.get("end_of_word_suffix") or ""
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        return plain and len(model["merges"]) < NO_RANK and all(c in vocab and c + end in vocab for c in byte_characters())

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).view(np.int64)

    def _order(self, left: np.ndarray, right: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """The rank of each pair and its place, as one number; NO_ORDER and more if it doesn't merge."""
        keys = self._key(left, right)
        at = self._slot(keys)
        there = self.keys[at]
        found = np.where(there == keys, self.ranks[at], np.int32(NO_RANK))
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) % (1 << self.bits)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return (found << PLACE_BITS) + place

    def _merged(self, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Columns of a matrix that holds one word's bytes each, with their sizes, and the columns' ids above NONE, as words are done."""
        width, at = len(data), np.arange(data.shape[1])
        # a row of NONE above and below
        symbols = np.full((width + 2, len(at)), NONE, np.int32)
        np.copyto(symbols[1:-1], self.inner[data], where=np.arange(width)[:, None] < sizes)
        symbols[sizes, at] = self.final[data[sizes - 1, at]]
        order = np.full((width + 1, len(at)), NO_ORDER, np.int32)
        for k in range(1, width):
            order[k] = self._order(symbols[k], symbols[k + 1], k)
        columns = at
        while True:
            best = order.min(axis=0)
            alive = best < NO_ORDER - (1 << PLACE_BITS)
            if not alive.all():
                done, going = np.flatnonzero(~alive), np.flatnonzero(alive)
                yield columns[done], symbols[1:-1].take(done, axis=1)
                if not going.size:
                    return
                columns, best, at = columns[going], best[going], np.arange(going.size)
                symbols, order = symbols.take(going, axis=1), order.take(going, axis=1)
            place, new = best & ((1 << PLACE_BITS) - 1), self.made[best >> PLACE_BITS]
            for k in range(2, len(symbols) - 1):
                moved = place < k
                np.copyto(symbols[k], symbols[k + 1], where=moved)
                if k < len(order) - 1:
                    np.copyto(order[k], order[k + 1] - 1, where=moved)
            symbols, order = symbols[:-1], order[:-1]
            symbols[place, at] = new
            order[place, at] = self._order(new, symbols[place + 1, at], place)
            order[place - 1, at] = self._order(symbols[place - 1, at], new, place - 1)

    def encode(self, words: list[str], dtype: np.dtype) -> dict[str, bytes]:
        """The ids of each word, which has no line end, as little-endian integers. Words of more than LONGEST bytes, and empty ones, are left out."""
        if not words:
            return {}
        data = np.frombuffer(("\n".join(words) + "\n" * (LONGEST + 1)).encode(), np.uint8)
        ends = np.flatnonzero(data[: len(data) - LONGEST] == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        by_size = np.argsort(sizes, kind="stable")
        cuts = np.searchsorted(sizes[by_size], [x + 1 for x in WIDTHS]).tolist()
        found: dict[str, bytes] = {}
        for width, start, end in zip(WIDTHS[1:], cuts, cuts[1:]):
            own = by_size[start:end]
            if not own.size:
                continue
            starts = ends[own] - sizes[own]
            for columns, ids in self._merged(data[starts + np.arange(width)[:, None]], sizes[own]):
                ids = ids.T
                real = ids != NONE
                stops = (real.sum(axis=1).cumsum() * dtype.itemsize).tolist()
                flat = ids[real].astype(dtype).tobytes()
                found.update(zip([words[i] for i in own[columns].tolist()], [flat[i:j] for i, j in zip([0, *stops], stops)]))
        return found
