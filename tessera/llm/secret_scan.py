"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

The automaton starts as the prefix tree of the labelled credentials. States whose outgoing and ending
frequencies agree by the Hoeffding bound are merged, children with them, which leaves a small automaton
with loops. Every run of credential characters is then scored: its likelihood under the automaton against that
under a background model of plain words, names and paths. No other filter decides.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, texts_of

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A greedy run of a class is leftmost and maximal, so asking for its least length finds the same spans.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

#: Strings that are scored: parts of runs of these characters, CANDIDATE_LENGTH or longer, that begin and end with a letter or digit.
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.-]{20,}")
CANDIDATE_LENGTH = 20
SEPARATORS = "_-+/=."
_PREFIXED = re.compile(r"[A-Za-z0-9_-]{20,}")
_PIECE = re.compile(r"[A-Za-z0-9]+")
_RUNS = bytes(ord("x") if chr(i).isascii() and (chr(i).isalnum() or chr(i) in SEPARATORS) else 32 for i in range(256))
_HEX_RUNS = bytes(ord("x") if chr(i) in "0123456789abcdef" else 32 for i in range(256))

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Public credential formats as prefix, alphabet and length after the prefix.
FORMATS = (
    ("AKIA", UPPER + DIGIT, 16),
    ("ASIA", UPPER + DIGIT, 16),
    ("AIza", UPPER + LOWER + DIGIT + "_-", 35),
    ("ghp_", UPPER + LOWER + DIGIT, 36),
    ("gho_", UPPER + LOWER + DIGIT, 36),
    ("ghs_", UPPER + LOWER + DIGIT, 36),
    ("glpat-", UPPER + LOWER + DIGIT + "_-", 20),
    ("hf_", UPPER + LOWER + DIGIT, 34),
    ("npm_", UPPER + LOWER + DIGIT, 36),
    ("sk_live_", UPPER + LOWER + DIGIT, 24),
    ("rk_live_", UPPER + LOWER + DIGIT, 24),
    ("xoxb-", DIGIT + "-", 24),
    ("dop_v1_", DIGIT + "abcdef", 64),
    ("", UPPER + LOWER + DIGIT, 40),
    ("", UPPER + LOWER + DIGIT + "+/", 40),
)
EXAMPLES, SEED = 60, 11
#: A candidate counts if the automaton makes it so many times (as a logarithm) likelier than the background does.
LEAST_RATIO = 5.0
#: Logarithm of a symbol that a state of the automaton never read.
UNSEEN = -7.0
_CLASS_SIZES = {"U": 26, "L": 26, "D": 10}
#: Plain strings that the background is trained on, and the shares of its parts: three characters, two, one, a repeat or successor of the last.
PLAIN_TOKENS, PLAIN_SHARES = 60_000, (0.7, 0.17, 0.06, 0.07)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Confidence of the merging test, and the share of labelled credentials that may score below the threshold.
ALPHA, MISSED = 0.05, 0.01


def labelled_credentials(formats=FORMATS, examples: int = EXAMPLES, seed: int = SEED) -> list[str]:
    """Example credentials, drawn from the formats by a seeded generator."""
    draw = random.Random(seed)
    return [prefix + "".join(draw.choices(alphabet, k=length)) for prefix, alphabet, length in formats for _ in range(examples)]


def plain_tokens(seed: int = SEED, count: int = PLAIN_TOKENS) -> list[str]:
    """Names, paths and numbers as they stand in plain text: words of public vocabularies, joined and cased by a seeded generator."""
    draw = random.Random(seed)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        known = {base64.b64decode(line.split()[0]).strip().lower() for line in lines if line.strip()}
    words = sorted(w.decode() for w in known if re.fullmatch(rb"[a-z]{2,}", w))
    cases = (str, str, str, str.title, str.upper)
    marks = (lambda: draw.choice(LOWER) + str(draw.randrange(10)), lambda: draw.choice(LOWER) + draw.choice(LOWER), lambda: "v" + str(draw.randrange(1, 30)))
    numbers = (lambda: str(draw.randrange(1900, 2100)), lambda: str(draw.randrange(100)), lambda: str(draw.randrange(10**6)), lambda: f"{draw.randrange(1990, 2040)}-{draw.randrange(1, 13):02}-{draw.randrange(1, 32):02}", lambda: str(draw.randrange(10**12)))
    found = []
    for _ in range(count):
        joint, case = draw.choice(("", "", "-", "-", "_", "_", "/", "/", ".", "+", "=", "camel")), draw.choice(cases)
        parts = [draw.choice(numbers)() if draw.random() < 0.15 else draw.choice(marks)() if draw.random() < 0.03 else draw.choice(words) for _ in range(draw.randrange(2, 7))]
        parts = [parts[0], *map(str.title, parts[1:])] if joint == "camel" else list(map(case, parts))
        found.append(joint.replace("camel", "").join(parts))
    return found


class Background:
    """How likely plain text makes a character after the two before it; digits are alike, and case follows the last character's."""

    SYMBOLS = LOWER + "0" + SEPARATORS

    def __init__(self, tokens: list[str]):
        n = len(self.SYMBOLS) + 1  # 0 is what stands before a token
        self.places = {c: self.SYMBOLS.index("0" if c in DIGIT else c.lower()) + 1 for c in UPPER + LOWER + DIGIT + SEPARATORS}
        one, two, three = [1] * n, [1] * n**2, [0] * n**3
        cases = [[1, 1] for _ in range(3)]
        for token in tokens:
            a = b = 0
            before = ""
            for x in token:
                c = self.places[x]
                one[c] += 1
                two[b * n + c] += 1
                three[(a * n + b) * n + c] += 1
                if x.isalpha():
                    cases[self._case(before)][x.isupper()] += 1
                a, b, before = b, c, x
        one[0] = 0
        sums = [sum(two[b * n : b * n + n]) for b in range(n)]
        whole, self.size, self.logs = sum(one), n, []
        for at in range(n * n):
            b, seen = at % n, sum(three[at * n : at * n + n])
            shares = PLAIN_SHARES
            for c in range(n):
                p2 = shares[1] * two[b * n + c] / sums[b] + shares[2] * one[c] / whole
                p3 = shares[0] * three[at * n + c] / seen if seen else p2 * shares[0] / (shares[1] + shares[2])
                self.logs.append(math.log(p2 + p3 + shares[3] / 2 * (c == b) + shares[3] / 2 * (c == b + 1) + 1e-6) - math.log(10) * (c == self.places["0"]))
        self.case_logs = [[math.log(x / sum(row)) for x in row] for row in cases]

    @staticmethod
    def _case(before: str) -> int:
        return 2 if before.isupper() else 1 if before.islower() else 0

    def each(self, text: str) -> list[float]:
        """Logarithms of the likelihoods of a text's characters."""
        found, a, b, before = [], 0, 0, ""
        for x in text:
            c = self.places[x]
            found.append(self.logs[(a * self.size + b) * self.size + c] + (self.case_logs[self._case(before)][x.isupper()] if x.isalpha() else 0.0))
            a, b, before = b, c, x
        for m in _UUID.finditer(text):
            found[m.start() : m.end()] = [max(p, -math.log(16)) for p in found[m.start() : m.end()]]
        return found


class Automaton:
    """A probabilistic deterministic automaton over character classes, after a learned literal prefix."""

    def __init__(self, examples: list[str], prefixes: tuple[str, ...], alpha: float = ALPHA, background: Background | None = None):
        self.background = background or Background(plain_tokens())
        self.prefixes = tuple(sorted({p for p in prefixes if p}, key=lambda p: (-len(p), p)))
        self.total, self.ends, self.moves = [0], [0], [{}]
        for text in sorted(examples):
            self._add(self.symbols(text))
        self._merge_states(alpha)
        scores = sorted(self.score(x) for x in examples)
        self.threshold = scores[int(MISSED * len(scores))] if scores else 0.0

    def symbols(self, text: str) -> list[str]:
        prefix = next((p for p in self.prefixes if text.startswith(p)), "")
        return [prefix] + ["U" if c.isupper() else "L" if c.islower() else "D" if c.isdigit() else c for c in text[len(prefix) :]]

    def _add(self, symbols: list[str]) -> None:
        at = 0
        self.total[0] += 1
        for s in symbols:
            if s not in self.moves[at]:
                self.moves[at][s] = [len(self.total), 0]
                self.total.append(0)
                self.ends.append(0)
                self.moves.append({})
            move = self.moves[at][s]
            move[1] += 1
            at = move[0]
            self.total[at] += 1
        self.ends[at] += 1

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return bool(n and m) and abs(x / n - y / m) > self._bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for s in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(s), self.moves[b].get(s)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree below b to the states it reaches from a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.ends[a] += self.ends[b]
            for s, (child, count) in self.moves[b].items():
                if s in self.moves[a]:
                    self.moves[a][s][1] += count
                    todo.append((self.moves[a][s][0], child))
                else:
                    self.moves[a][s] = [child, count]

    def _merge_states(self, alpha: float) -> None:
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        settled, frontier = [0], [(0, s) for s in sorted(self.moves[0])]
        while frontier:
            parent, s = frontier.pop(0)
            state = self.moves[parent][s][0]
            if state in settled:
                continue
            # the start state reads prefixes, not classes, so nothing merges with it
            match = next((r for r in settled[1:] if self._compatible(r, state)), None)
            if match is None:
                settled.append(state)
                frontier += [(state, t) for t in sorted(self.moves[state])]
            else:
                self.moves[parent][s][0] = match
                self._fold(match, state)
                frontier = [(p, t) for p in settled for t in sorted(self.moves[p]) if self.moves[p][t][0] not in settled]
        self.states = settled

    def score(self, text: str) -> float:
        """Mean probability, as a geometric mean, of the string's symbols and its end; 0 where the automaton has no move."""
        at, total, symbols = 0, 0.0, self.symbols(text)
        for s in symbols:
            move = self.moves[at].get(s)
            if move is None:
                return 0.0
            total += math.log(move[1] / self.total[at])
            at = move[0]
        if not self.ends[at]:
            return 0.0
        return math.exp((total + math.log(self.ends[at] / self.total[at])) / (len(symbols) + 1))


    def ratios(self, run: str) -> list[tuple[int, int, float]]:
        """(start, end, log likelihood ratio) of a run's pieces, which are letters and digits, a known prefix or what separates them."""
        plain, found, at, state = self.background.each(run), [], 0, self.moves[0][""][0] if "" in self.moves[0] else 0
        first = state
        while at < len(run):
            prefix = next((p for p in self.prefixes if run.startswith(p, at) and p in self.moves[0]), "")
            if prefix:
                state, count = self.moves[0][prefix]
                found.append((at, at + len(prefix), math.log(count / self.total[0]) - sum(plain[at : at + len(prefix)])))
                at += len(prefix)
            piece = _PIECE.match(run, at)
            end = piece.end() if piece else at + (at < len(run))
            ratio = 0.0
            for k in range(at, end):
                symbol = self.symbols(run[k])[-1]
                move = self.moves[state].get(symbol) or self.moves[first].get(symbol)
                ratio += (math.log(move[1] / self.total[state if symbol in self.moves[state] else first]) - math.log(_CLASS_SIZES.get(symbol, 1)) if move else UNSEEN) - plain[k]
                state = move[0] if move else first
            if end > at:
                found.append((at, end, ratio))
            at = end
        return found

    def accepts(self, token: str) -> bool:
        """Whether a string with a known prefix is as likely as the labelled ones, or likelier than plain text."""
        return self.score(token) >= self.threshold or sum(r for _, _, r in self.ratios(token)) >= LEAST_RATIO

    def likely(self, run: str) -> list[tuple[int, int]]:
        """The parts of a run with the highest ratios, of LEAST_RATIO or more; a part ends where its ratio has fallen by as much."""
        pieces, found, first = self.ratios(run), [], 0
        while first < len(pieces):
            total = best = 0.0
            last = first - 1
            for k in range(first, len(pieces)):
                total += pieces[k][2]
                if total > best:
                    best, last = total, k
                if total < max(0.0, best - LEAST_RATIO) or (last < first):
                    break
            if last < first:
                first += 1
                continue
            start, end = pieces[first][0], pieces[last][1]
            while end > start and run[end - 1] in SEPARATORS:
                end -= 1
            # what is left at a run's edge belongs to the part unless it is clearly plain or a dot or equals sign parts it
            if not found and not set(".=") & set(run[:start]) and sum(r for _, e, r in pieces if e <= start) > -LEAST_RATIO:
                start = 0
            if not set(".=") & set(run[end:].rstrip("=")) and sum(r for b, _, r in pieces if b >= end and run[b] != "=") > -LEAST_RATIO:
                end = len(run.rstrip("="))
            if best >= LEAST_RATIO and end - start >= CANDIDATE_LENGTH:
                while end < len(run) and run[end] == "=":
                    end += 1
                found.append((start, end))
            first = last + 1
        return found


@lru_cache(maxsize=1)
def default_automaton() -> Automaton:
    return Automaton(labelled_credentials(), tuple(p for p, _, _ in FORMATS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kind as its place in KINDS, sorted."""
    found = []
    lowered = ascii_lower(text)
    if any(k in lowered for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if b"x" * 16 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUNS):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def format_spans(text: str, automaton: Automaton) -> list[tuple[int, int, int]]:
    """Strings with a known prefix as likely as the labelled ones, and parts of runs that the automaton makes likelier than the background."""
    if b"x" * CANDIDATE_LENGTH not in text.encode("utf-8", "surrogatepass").translate(_RUNS):
        return []
    found = [(m.start(), m.end()) for m in _PREFIXED.finditer(text) if m[0].startswith(automaton.prefixes) and automaton.accepts(m[0])]
    found += [(m.start() + start, m.start() + end) for m in _CANDIDATE.finditer(text) for start, end in automaton.likely(m[0])]
    joined: list[list[int]] = []
    for start, end in sorted(found):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    return [(start, 3, end) for start, end in joined]


def find_secrets(text: str, automaton: Automaton) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and those with the automaton's, both sorted. Spans of different kinds may overlap."""
    base = base_spans(text)
    return base, sorted(base + format_spans(text, automaton))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", automaton: Automaton | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; the automaton's are added to the
    base ones and may overlap them. Null text counts as empty and has none; repeated rows and null or repeated ids
    are scanned alike; an empty table gives an empty one; other columns are ignored. Each row is scanned on its own
    in one pass over its text, however long, so nothing is shuffled.
    """
    automaton = automaton or default_automaton()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in texts_of(batch.column(1)):
                base, spans = find_secrets(body, automaton)
                rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays = [batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(scan, f"doc_id {dict(own.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", automaton: Automaton | None = None) -> DataFrame:
    """docs with every span of find_secrets in `text` replaced by `mark`, spans that overlap by one; other columns as they are.

    Null stays null and empty stays empty; repeated rows are changed alike; a table may be empty, a text long, and
    columns may have any names.
    """
    automaton = automaton or default_automaton()
    place = docs.columns.index(text)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for body in batch.column(place).to_pylist():
                spans = find_secrets(body, automaton)[1] if body else []
                parts, at = [], 0
                for start, _, end in spans:
                    if start >= at:
                        parts += [body[at:start], mark]
                    at = max(at, end)
                bodies.append("".join(parts) + body[at:] if spans else body)
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(cover, plain.schema).toDF(*docs.columns)
