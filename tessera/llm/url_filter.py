"""URL filter: domain rules first, gradient-boosted trees on lexical features for the rest.

The rules of a site's domain and language say nothing about a URL's shape, so the trees learn nothing from them. They are
trained on labelled URLs whose shape varies with the label: by default those of `seeds`, a seeded generator of plain and of
spam-like URLs over the same domains and languages, else labelled URLs of the user's. The trees see the URL's
shape and smoothed label rates of its suffixes and host words, which for training come from other hosts' labels.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: (host, path prefix, verdict); a rule fits its host and all subdomains, the longest one wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Most URLs that rule_labels returns, chosen by hash, so the choice doesn't depend on order.
MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, RATE, BINS, SMOOTHING, FOLDS = 60, 4, 0.2, 32, 8.0, 4

#: Host words of the seed set, and the domains and languages that both labels share or only one has.
BLOCKED_WORDS = ("casino", "bets", "pills", "viagra", "loans", "porn", "ads", "track", "cheap", "free", "spam", "farm", "win", "sex", "bonus", "deals")
ALLOWED_WORDS = ("library", "news", "docs", "school", "wiki", "museum", "garden", "recipes", "weather", "science", "travel", "health", "music", "forum", "sports", "history")
SHARED_SUFFIXES, BLOCKED_SUFFIXES, ALLOWED_SUFFIXES = ("com", "net", "org", "de", "fr"), ("xyz", "top", "click", "loan", "icu"), ("edu", "gov", "info", "eu", "io")
SEED_LANGUAGES = ("en", "de", "fr", "es")
SEED_URLS, SEED = 8_000, 7

_HOST = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "https", "top_suffix", "second_suffix", "extension", "host_word")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    found = _HOST.search(url or "")
    return (ascii_lower(found[1]), found[2]) if found else ("", "")


class RuleSet:
    """Rules by host; looks up a URL's host and its parents, so the cost doesn't grow with the rules."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of rules of one length, the one with more host."""
        best = None
        parts = host.split(".") if host else []
        for i in range(len(parts)):
            own = ".".join(parts[i:])
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start) and (best is None or len(own) + len(start) > len(best[0])):
                    best = (own + start, verdict)
        return best


def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    """Top-level and second-level suffix of the host, and the path's extension."""
    labels, last = host.split("."), path.rpartition("/")[2]
    return labels[-1], ".".join(labels[-2:]), last.rpartition(".")[2] if "." in last else ""


def _host_words(host: str) -> set[str]:
    """Words of a host's labels, without its top-level label."""
    return set(re.split(r"[.-]", host.rpartition(".")[0])) - {""}


def seeds(count: int = SEED_URLS, seed: int = SEED) -> tuple[list[str], list[bool]]:
    """Labelled URLs of a seeded generator, half of them blocked.

    Blocked URLs have a word of that kind in their host, or a spam-like shape: long random names, hyphens and digits, deep
    paths of random numbers and many parameters; the rest of them is as in the others, which vary too.
    """
    draw = random.Random(seed)
    syllables = [c + v for c in "bcdfghklmnprstvw" for v in "aeiou"]

    def name() -> str:
        return "".join(draw.choices(syllables, k=draw.randrange(2, 5)))

    def code(n: int) -> str:
        return "".join(draw.choices("0123456789abcdef0123456789", k=n))

    urls, labels = [], []
    for _ in range(count):
        blocked = draw.random() < 0.5
        shaped = blocked and draw.random() < 0.5
        words = [draw.choice(BLOCKED_WORDS if blocked else ALLOWED_WORDS)] if (blocked and not shaped) or draw.random() < 0.3 and not shaped else []
        words += [name() for _ in range(draw.randrange(0 if words else 1, 3))]
        draw.shuffle(words)
        host = draw.choice(("-", "-", "")).join(words)
        if shaped and draw.random() < 0.7:
            host = draw.choice((code(draw.randrange(8, 20)), f"{host}-{name()}-{name()}{draw.randrange(10, 10000)}", f"{code(6)}.{code(8)}.{host}"))
        ending = draw.choice(SHARED_SUFFIXES if draw.random() < 0.7 else BLOCKED_SUFFIXES if blocked else ALLOWED_SUFFIXES)
        host = draw.choice(("", "", "www.", "m.", "blog.")) + host + draw.choice((".example", "", "")) + "." + ending
        path = draw.choice(("", f"/{draw.choice(SEED_LANGUAGES)}"))
        if shaped:
            path += "".join("/" + draw.choice((code(draw.randrange(4, 16)), str(draw.randrange(10**6)), name())) for _ in range(draw.randrange(2, 8)))
            query = [f"{draw.choice(('id', 'sid', 'ref', 'click', 'aff', 'q', name()))}={code(draw.randrange(2, 20))}" for _ in range(draw.randrange(0, 9))]
        else:
            path += "".join("/" + draw.choice((str(draw.randrange(1000)), "-".join(name() for _ in range(draw.randrange(1, 6))), str(draw.randrange(1995, 2030)))) for _ in range(draw.randrange(0, 4)))
            path += draw.choice(("", "", "/", ".html", ".pdf" if not blocked else ".php"))
            query = draw.choice(([], [], [], ["page=2", "ref=x"], ["utm_source=feed"], [f"id={draw.randrange(10**5)}"]))
        urls.append(f"{draw.choice(('http', 'https', 'https'))}://{host}{path}" + ("?" + "&".join(query) if query else "") + draw.choice(("", "", "", "#top")))
        labels.append(blocked)
    return urls, labels


def _shape(url: str, host: str, path: str) -> list[float]:
    n = max(1, len(url))
    counts = np.unique(np.frombuffer(url.encode("utf-8", "surrogatepass") or b"\0", np.uint8), return_counts=True)[1] / max(1, len(url.encode("utf-8", "surrogatepass")))
    query = url.partition("?")[2].partition("#")[0]
    return [
        len(url), len(host), len(path), path.count("/"), sum(map(url.count, "0123456789")) / n, float(-(counts * np.log2(counts)).sum()),
        query.count("&") + bool(query), url.count("-"), host.count(".") + bool(host), url.startswith("https:"),
    ]


class _Rates:
    """Smoothed blocking rates of each kind of suffix and of host words."""

    def __init__(self, places: list[tuple[str, str]], blocked: np.ndarray, base: float):
        kinds: list[dict[str, list[float]]] = [{} for _ in range(4)]
        for at, target in zip(places, blocked):
            for kind, s in zip(kinds, _suffixes(*at)):
                kind.setdefault(s, []).append(target)
            for word in _host_words(at[0]):
                kinds[3].setdefault(word, []).append(target)
        self.base = base
        *self.suffixes, self.words = [{s: (sum(v) + SMOOTHING * base) / (len(v) + SMOOTHING) for s, v in kind.items()} for kind in kinds]

    def of(self, host: str, path: str) -> list[float]:
        """The rate of each suffix, and of the host word with the highest."""
        return [rates.get(s, self.base) for rates, s in zip(self.suffixes, _suffixes(host, path))] + [max((self.words.get(w, self.base) for w in _host_words(host)), default=self.base)]


def _features(urls: list[str], places: list[tuple[str, str]], rates: _Rates) -> np.ndarray:
    rows = [_shape(u, *at) + rates.of(*at) for u, at in zip(urls, places)]
    return np.asarray(rows, float).reshape(len(rows), len(FEATURES))


@dataclass
class UrlModel:
    """Trees over binned features, and smoothed blocking rates for each kind of suffix and for host words."""

    rates: "_Rates"
    base_rate: float
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    prior: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, urls: list[str], places: list[tuple[str, str]]) -> np.ndarray:
        """Probability that each URL is to be blocked."""
        x = self.binned(_features(urls, places, self.rates))
        total = np.full(len(x), self.prior)
        for columns, cuts, leaves in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), columns[at]] > cuts[at])
            total += leaves[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def train(urls: list[str], blocked: list[bool]) -> UrlModel:
    """Fit boosted trees by logistic loss with histogram splits. No labelled URL, or labels of one kind, give a constant."""
    y = np.asarray(blocked, float)
    places = [split_url(u) for u in urls]
    base = float(y.mean()) if len(y) else 0.0
    model = UrlModel(_Rates(places, y, base), base)
    model.prior = float(np.log((base + 1e-3) / (1 - base + 1e-3)))
    if base in (0.0, 1.0):
        return model
    # a URL's own label and its host's aren't in the rates that it is trained with
    fold = np.array([zlib.crc32(host.encode("utf-8", "surrogatepass")) % FOLDS for host, _ in places])
    raw = np.zeros((len(urls), len(FEATURES)))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        raw[own] = _features([urls[i] for i in own], [places[i] for i in own], _Rates([places[i] for i in rest], y[rest], base))
    model.edges = [np.unique(np.quantile(raw[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(raw.shape[1])]
    x = model.binned(raw)
    total = np.full(len(y), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        size = 2**DEPTH - 1
        columns, cuts = np.zeros(size, int), np.full(size, BINS + 1)
        at = np.zeros(len(y), int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            for k in range(x.shape[1]):
                g = np.bincount(x[rows, k], grad[rows], BINS + 1).cumsum()[:-1]
                h = np.bincount(x[rows, k], hess[rows], BINS + 1).cumsum()[:-1]
                all_g, all_h = grad[rows].sum(), hess[rows].sum()
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                if gain.max() > best:
                    best, columns[node], cuts[node] = gain.max(), k, gain.argmax()
            at[rows] = 2 * node + 1 + (x[rows, columns[node]] > cuts[node])
        leaf = at - size
        leaves = RATE * np.bincount(leaf, grad, size + 1) / (np.bincount(leaf, hess, size + 1) + 1)
        model.trees.append((columns, cuts, leaves))
        total += leaves[leaf]
    return model


def rule_labels(pages: DataFrame, url: str = "url", rules=RULES, most: int = MAX_TRAINING_ROWS) -> tuple[list[str], list[bool]]:
    """Labels for `train` from rules that do stand for a URL's kind, such as lists of known bad hosts.

    Of the distinct URLs that a rule decides the `most` with the smallest hashes, or all, and whether it blocks them."""
    found = RuleSet(rules)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(u, hit[1] == "block") for u in batch.column(0).to_pylist() if (hit := found.find(*split_url(u)))]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in own], pa.string()), pa.array([b for _, b in own], pa.bool_())], names=["url", "blocked"])

    labelled = pages.select(F.col(url).alias("url")).mapInArrow(decided, "url string, blocked boolean")
    hashed = labelled.withColumn("h", F.xxhash64("url"))
    total = hashed.select("h").distinct().count()
    share = 1.5 * most / total if total > 2 * most else 1.0
    while True:  # the smallest hashes only: else each task would send the driver its own smallest `most`
        own = hashed.filter(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else hashed
        rows = own.distinct().orderBy("h", "url").limit(most).collect()
        if share >= 1 or len(rows) == most:
            break
        share *= 2
    return [r.url for r in rows], [r.blocked for r in rows]


def url_filter(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of pages.

    The longest rule that fits decides; otherwise the trees do, blocking at a score of `threshold` or more.
    A null URL or one without `://` has an empty host and path, which no rule fits and the model allows: it
    names no site. Repeated rows and null or repeated ids are judged alike; other columns are ignored; an empty table gives an
    empty one; a URL may have any length. Without `model`, the trees are trained on the seeds.
    """
    model = model or train(*seeds())
    found = RuleSet(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [u or "" for u in batch.column(1).to_pylist()]
            places = [split_url(u) for u in urls]
            hits = [found.find(*at) for at in places]
            scores = model.score(urls, places) if model.trees else np.full(len(urls), model.base_rate)
            scores = np.where([bool(host) for host, _ in places], scores, 0.0)
            verdicts = [hit[1] if hit else "block" if s >= threshold else "allow" for hit, s in zip(hits, scores)]
            columns = [batch.column(0), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array([hit and hit[0] for hit in hits], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "score"])

    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return own.mapInArrow(judge, f"page_id {dict(own.dtypes)['page_id']}, host string, path string, rule string, verdict string, score double")
