"""Token ids as the tokenizers library gives them, with the ids of recurring pieces of text kept in a bounded table."""

from __future__ import annotations

import json
import os
import re
import threading
import time
from functools import lru_cache
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.common import release_memory
from tessera.llm.merges import WordMerger

#: Most pieces whose ids a worker keeps; further ones are encoded once for each run of texts.
MAX_KEPT = 250_000
#: Seconds without a text after which a worker, which Spark keeps for other work, drops its kept pieces.
IDLE_SECONDS = 20.0
#: Characters of text whose pieces are held at once; a longer text is on its own.
CHUNK = 1 << 21
#: Unicode white space, as a character class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that both libraries know, and ASCII marks without the apostrophe, which starts contractions. Either
#: pattern parts a run of the former from one of the latter, which are pieces of their own if nothing else follows.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"


class _Kept(dict):
    """Pieces that are kept; others come from the table of the texts at hand."""

    rest: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.rest[piece]


class PieceEncoder:
    """Encodes texts piece by piece where the tokenizer's own rules let no word reach over a piece's end.

    A pattern that drops white space never joins what blanks or line ends part. The byte-level pattern joins one
    blank to the word after it and splits other white space off, so there a piece is such a word or space.
    With any other rules, or a special token in a byte-level text, the library encodes the whole text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        before = spec["pre_tokenizer"] or {}
        inner = before.get("pretokenizers", [before])
        kinds = [x.get("type") for x in inner]
        names = [x["content"] for x in spec["added_tokens"]]
        self.pieces, self.whole, self.word = None, re.compile("(?!)"), re.compile("(?!)")
        merged, self.lower = WordMerger.fits(spec["model"]), False
        if kinds == ["Split", "ByteLevel"] and inner[0].get("behavior") == "Removed" and inner[0].get("invert") and r"[^\s\p{L}\p{N}]+" in inner[0]["pattern"].get("Regex", "") and not any(" " in n or "\n" in n for n in names):
            self.pieces = re.compile(rf"[{LETTERS}]++(?![^ \n{MARKS}])|[{MARKS}]++(?![^ \n])|[^ \n]+")
            self.word = re.compile(f"[{LETTERS}]+")
            # these letters are composed, and none is white space
            normal = spec["normalizer"] or {"normalizers": []}
            steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [normal])]
            self.lower = ("Lowercase", None, None) in steps
            merged &= all(x[0] in ("NFC", "Lowercase") or x == ("Replace", {"Regex": r"\s+"}, " ") for x in steps)
        elif kinds == ["ByteLevel"] and inner[0].get("use_regex") and not inner[0].get("add_prefix_space") and not spec["normalizer"]:
            self.pieces = re.compile(rf" ?[{LETTERS}]++(?![^{SPACE}{MARKS}])|[{MARKS}]++(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
            self.word = re.compile(f" ?[{LETTERS}]+")
            self.whole = re.compile("|".join(map(re.escape, names)) or "(?!)")
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.merger = WordMerger(spec["model"]) if merged else None
        self.kept = _Kept()
        self._lock, self._used, self._watched = threading.Lock(), 0.0, False

    def _drop_when_idle(self) -> None:
        while True:
            time.sleep(IDLE_SECONDS / 4)
            with self._lock:
                if time.monotonic() - self._used >= IDLE_SECONDS:
                    self.kept, self._watched = _Kept(), False
                    break
        release_memory()

    def _fresh(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of new pieces. Those that the pattern takes for one word each are merged many at once."""
        found: dict[str, bytes] = {}
        if self.merger is not None:
            words = [p for p in pieces if self.word.fullmatch(p)]
            if self.lower:
                lowered = [w.lower() for w in words]
                own = self.merger.encode(list(set(lowered)), self.dtype)
                found = {w: own[x] for w, x in zip(words, lowered) if x in own}
            else:
                found = self.merger.encode(words, self.dtype)
        others = list(pieces.difference(found))
        found.update(zip(others, self._library_ids(others)))
        return found

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, self.dtype).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.dtype."""
        found, start = [], 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= CHUNK:
                size += len(texts[end])
                end += 1
            with self._lock:
                self._used = time.monotonic()
                if not self._watched:
                    self._watched = True
                    threading.Thread(target=self._drop_when_idle, daemon=True).start()
                found += self._encode_chunk(texts[start:end])
                self._used = time.monotonic()
            start = end
        return found

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.pieces is None or self.whole.search(t) else self.pieces.findall(t) for t in texts]
        kept = self.kept
        new = set().union(*filter(None, cut)).difference(kept)
        fresh = self._fresh(new)
        kept.update(islice(fresh.items(), max(0, MAX_KEPT - len(kept))))
        kept.rest = fresh
        get = kept.__getitem__
        found = [self._library_ids([t])[0] if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]
        kept.rest = {}
        return found


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """A worker's encoder for a tokenizer file, which outlives its tasks."""
    return PieceEncoder(path)
