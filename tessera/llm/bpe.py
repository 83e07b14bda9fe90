"""BPE encoding and decoding with forced boundaries.

A merge can only join symbols that stand side by side inside some vocabulary token. So where two adjacent
symbols of a word stand so in no token, every encoding has a cut. Words are split there, the fragments are
encoded on their own, and their ids are concatenated. Fragments recur far more often than words or texts,
so each is merged once and kept in a bounded table.

Texts are cut at blanks first, which the tokenizer drops, and the ids of each piece are kept likewise.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import texts_of

#: Most fragments, words and pieces each whose ids a worker keeps; further ones are encoded each time they occur.
MAX_KEPT = 250_000


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is a printable Latin-1 character, else the next one from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for a tokenizer file: NFC, lower case, words by a pattern, byte-level BPE with a word-end mark.

    Other normalizers, pre-tokenizers or decoders raise ValueError rather than give other ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
        if not known or spec["decoder"] or spec["post_processor"] or model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't a tokenizer of the known kind")
        self.path = path
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(merges)}
        pattern = cuts[0]["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        # the same pattern over ASCII after lower-casing, for the faster library
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\x09-\x0d a-z0-9]").replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
        self._ascii_words = None if "\\p" in plain or "\\s" in plain else re.compile(plain)
        self._bytes = byte_characters()
        self.inside = self._pairs_inside()
        self._tokenizer: Tokenizer | None = None
        self._kept_words: dict[str, list[int]] = {}
        self._fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def _symbols(self, word: str) -> list[str]:
        """The characters of a byte-level word, the last with the word-end mark."""
        return [*word[:-1], word[-1] + self.end]

    def _pairs_inside(self) -> set[tuple[str, str]]:
        """Pairs of first-level symbols that stand side by side in a token."""
        found = set()
        for token in self.vocab:
            ends = token.endswith(self.end) and len(token) > len(self.end)
            symbols = self._symbols(token[: -len(self.end)]) if ends else list(token)
            found.update(zip(symbols, symbols[1:]))
        return found

    def fragments(self, symbols: list[str]) -> Iterator[tuple[str, ...]]:
        """The symbols of a word, cut between all pairs that no token holds."""
        start = 0
        for at in range(1, len(symbols)):
            if (symbols[at - 1], symbols[at]) not in self.inside:
                yield tuple(symbols[start:at])
                start = at
        yield tuple(symbols[start:])

    def _merged(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Merge the leftmost pair of lowest rank until no pair has one; symbols without an id are dropped."""
        parts, ranks, none = list(symbols), self.ranks, len(self.ranks)
        order = [ranks.get(p, none) for p in zip(parts, parts[1:])]
        while order and (best := min(order)) < none:
            at = order.index(best)
            parts[at] += parts.pop(at + 1)
            order.pop(at)
            if at:
                order[at - 1] = ranks.get((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = ranks.get((parts[at], parts[at + 1]), none)
        return tuple([self.vocab[p] for p in parts if p in self.vocab])

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given byte by byte as characters."""
        kept = self._kept_words.get(word)
        if kept is None:
            kept = self._encode_word(word)
            if len(self._kept_words) < MAX_KEPT:
                self._kept_words[word] = kept
        return kept

    def _encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        for fragment in self.fragments(self._symbols(word)):
            own = self._fragments.get(fragment)
            if own is None:
                own = self._merged(fragment)
                if len(self._fragments) < MAX_KEPT:
                    self._fragments[fragment] = own
            ids.extend(own)
        return ids

    def normalize(self, text: str) -> str:
        """NFC, then each character in lower case; blanks are dropped later, so they needn't be unified."""
        if text.isascii():
            return text.lower()
        return "".join(map(str.lower, unicodedata.normalize("NFC", text)))

    def words(self, text: str) -> list[str]:
        """The pattern's words of a text, byte by byte as characters.

        Newer characters are letters in one library's tables and unknown in another's, so for any beyond the
        Latin blocks the tokenizers library normalizes and splits.
        """
        if text.isascii() and self._ascii_words:
            return [w if w.isalnum() else "".join([self._bytes[b] for b in w.encode()]) for w in self._ascii_words.findall(text.lower())]
        if max(text, default="") < "\u0250":
            return ["".join([self._bytes[b] for b in w.encode()]) for w in self._words.findall(self.normalize(text))]
        library = self._library()
        return [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]

    def _library(self) -> Tokenizer:
        if self._tokenizer is None:
            self._tokenizer = Tokenizer.from_file(self.path)
        return self._tokenizer

    def _encode_plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.words(text):
            ids += self.encode_word(word)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of special tokens in it become those tokens."""
        ids, at = [], 0
        for m in self._special.finditer(text):
            ids += self._encode_plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._encode_plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """The tokens with one blank between them: the file has no decoder of its own."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


class PieceTable:
    """For each blank-free piece of text: its number of ids, the ids and the tokens as text, in a bounded table.

    Words never reach over a blank or a line end, nor does NFC compose over one, so a text's ids are those
    of its pieces. Special tokens hold no blank.
    """

    def __init__(self, bpe: ForcedBoundaryBpe):
        self.bpe = bpe
        self.kept: dict[str, tuple[int, str, str]] = {}

    def _of(self, piece: str) -> tuple[int, str, str]:
        ids = self.bpe.encode(piece)
        own = (len(ids), " ".join(map(str, ids)), self.bpe.decode(ids))
        if len(self.kept) < MAX_KEPT:
            self.kept[piece] = own
        return own

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids with one blank between them, SHA-256 of the decoded text."""
        get, of = self.kept.get, self._of
        found = [x for p in text.replace("\n", " ").split(" ") if p and (x := get(p) or of(p))[0]]
        ids, decoded = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=2)
def pieces_of(path: str) -> PieceTable:
    """A worker's table for a tokenizer file, which outlives its tasks."""
    return PieceTable(ForcedBoundaryBpe(path))


def bpe_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs, encoded with the tokenizer file at `path`.

    The file has to be at that path on every executor. Null text counts as empty and has no ids; repeated
    rows and null or repeated ids are encoded alike; an empty table gives an empty one; other columns are ignored. The
    ids of one text are in memory at once, so a long text costs some ten times its size.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(path)
        for batch in batches:
            rows = [table.digest(body) for body in texts_of(batch.column(1))]
            columns = list(zip(*rows)) if rows else [()] * 3
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(digest, f"doc_id {dict(own.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
