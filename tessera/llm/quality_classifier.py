"""Hierarchical empirical Bayes quality: a document classifier's evidence with site and path posteriors.

A logistic model over hashed word and shape features, trained on labelled documents, gives each document the log-odds of
good quality. The probabilities are pooled by path and by site, in grouped sums that are all that moves
between tasks. Each site's rate is a Beta posterior whose prior is the corpus's, each path's has its site's
posterior as prior, and prior strengths are estimated from the spread between groups by the method of moments.
So a site of few documents stays near the corpus, a large one near its own rate. A document's score adds the
log-odds by which its path differs from the corpus, by the other documents there, to its own evidence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, lookup, materialize, texts_of

#: Most labelled documents that training reads: those with the smallest hash of their id. Each is sent to the driver
#: as at most SHAPE + BUCKETS numbers, however long its text is.
MAX_TRAINING_ROWS = 4_000
BUCKETS, STEPS, RATE, PENALTY = 1 << 12, 300, 0.5, 1e-3
#: How far a site's or path's log-odds may move a document's, and the least and most prior strength in documents.
SITE_WEIGHT, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 5.0, 1e6

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = 12
#: Most words whose bucket a worker keeps.
MAX_WORDS = 300_000


#: Classes of bytes: other, upper case, lower case or part of a longer character, digit, symbol, bar, exclamation mark.
_CLASS = np.zeros(256, np.int64)
for _k, _own in enumerate((b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(97, 123)) + bytes(range(128, 256)), b"0123456789", b"#*$%&<>", b"|", b"!")):
    _CLASS[list(_own)] = _k


def _shape(text: str, words: list[str]) -> list[float]:
    """Shares that don't depend on the language or the length of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    _, upper, lower, digits, symbols, bars, calls = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7).tolist()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ends = sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / max(1, len(lines))
    return [
        1.0, min(1.0, np.log1p(n) / 10), min(2.0, symbols / n), min(2.0, bars / n), min(2.0, calls / n), upper / max(1, upper + lower),
        digits / max(1, len(raw)), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, ends, 1 - len(set(lines)) / max(1, len(lines)), min(2.0, len(raw) / n / 10),
    ]


class _Buckets(dict):
    """Word -> bucket; words are kept up to a bound."""

    def __missing__(self, word: str) -> int:
        bucket = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < MAX_WORDS:
            self[word] = bucket
        return bucket


_buckets = _Buckets()


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Dense shape features, and hashed word features as (row, bucket, value) of unit length each row."""
    shape, rows, buckets, values = np.zeros((len(texts), SHAPE)), [], [], []
    for i, text in enumerate(texts):
        words = _WORD.findall(ascii_lower(text))
        shape[i] = _shape(text, words)
        if words:
            counts = np.bincount([_buckets[w] for w in set(words)], minlength=BUCKETS)
            own = np.flatnonzero(counts)
            rows.append(np.full(len(own), i))
            buckets.append(own)
            values.append(counts[own] / np.sqrt((counts[own] ** 2).sum()))
    if not rows:
        return shape, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return shape, np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


class QualityModel:
    """Logistic regression by full-batch gradient steps."""

    def __init__(self, features: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], good: list[bool]):
        y = np.asarray(good, float)
        self.dense, self.hashed = np.zeros(SHAPE), np.zeros(BUCKETS)
        self.base = float(y.mean()) if len(y) else 0.5
        if not len(y) or self.base in (0.0, 1.0):
            return
        shape, rows, buckets, values = features
        weight = np.where(y > 0, 0.5 / self.base, 0.5 / (1 - self.base))
        fast = np.zeros(SHAPE), np.zeros(BUCKETS)
        for _ in range(STEPS):
            odds = shape @ self.dense + np.bincount(rows, values * self.hashed[buckets], len(y))
            miss = weight * (y - 1 / (1 + np.exp(-odds))) / len(y)
            steps = shape.T @ miss - PENALTY * self.dense, np.bincount(buckets, values * miss[rows], BUCKETS) - PENALTY * self.hashed
            for own, step, sums in zip((self.dense, self.hashed), steps, fast):
                sums += step**2
                own += RATE * step / np.sqrt(sums + 1e-8)

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Log-odds that each text is good, at even prior odds."""
        shape, rows, buckets, values = _features(texts)
        return np.clip(shape @ self.dense + np.bincount(rows, values * self.hashed[buckets], len(texts)), -12, 12)


def train_on(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """A model of at most `most` documents with a label 0 or 1.

    A document with several labels is good if all of them are 1; of several texts with one id, that with the
    smallest features counts; null ids and other labels don't. Tasks make the features, so no text comes to the driver.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.col(label) == 1).alias("good"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shape, rows, buckets, values = _features(texts_of(batch.column(2)))
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (buckets.astype(np.int32), values)]
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SHAPE), pa.array(shape.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), shapes, *lists], names=["doc_id", "good", "shape", "buckets", "values"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "good", "text")
    found = own.mapInArrow(measure, f"doc_id {dict(own.dtypes)['doc_id']}, good boolean, shape array<double>, buckets array<int>, values array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("good", "shape", "buckets", "values")).alias("own")).select("doc_id", "own.*").toArrow().sort_by("doc_id")
    parts = [found.column(c).combine_chunks() for c in ("shape", "buckets", "values")]
    sizes = pc.list_value_length(parts[1]).to_numpy(zero_copy_only=False).astype(np.int64)
    shape, buckets, values = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in parts)
    return QualityModel((shape.reshape(-1, SHAPE), np.repeat(np.arange(len(sizes)), sizes), buckets.astype(np.int64), values), found.column("good").to_pylist())


def _strength(groups: DataFrame, mean: str, prior: str) -> float:
    """Documents' worth of a prior, from the spread of group means around it: large if groups differ little."""
    d = F.col(mean) - F.col(prior)
    row = groups.agg(F.sum(d * d * F.col("n")), F.sum(F.col(prior) * (1 - F.col(prior))), F.sum(F.col("n")), F.count(F.lit(1))).first()
    if not row[3] or row[2] <= row[3]:
        return LEAST_STRENGTH
    within, n = row[1] / row[3], row[2]
    between = max(0.0, row[0] / n - within * row[3] / n)
    return float(min(max(within / between - 1 if between > 0 else MOST_STRENGTH, LEAST_STRENGTH), MOST_STRENGTH))


def quality_scores(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text", site: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """doc_id, site, path, evidence, site_rate, path_rate, score, kept of every row of docs.

    evidence: the classifier's log-odds; rates: posterior shares of good documents of the site and path, without the
    document itself, whose evidence counts once; score: the combined probability; kept: score >= threshold. Null text
    counts as empty; a null site or path is a group of its own; repeated rows and null or repeated ids are scored alike
    and each count; an empty table gives an empty one; other columns are ignored; a long text's words are counted
    in one pass.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.log_odds(texts_of(batch.column(3))), pa.float64())], names=["doc_id", "site", "path", "evidence"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.col(path).cast("string").alias("path"), F.col(text).alias("text"))
    seen = own.mapInArrow(judge, f"doc_id {dict(own.dtypes)['doc_id']}, site string, path string, evidence double")
    seen = materialize(seen.withColumn("key", F.to_json(F.struct("site", "path"), {"ignoreNullFields": "false"})), "quality-evidence")
    good = 1 / (1 + F.exp(-F.col("evidence")))
    paths = materialize(seen.groupBy("key", "site", "path").agg(F.sum(good).alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    rows, base = total[1] or 0, (total[0] / total[1]) if total[1] else 0.5
    base = min(max(base, 1e-6), 1 - 1e-6)
    sites = paths.groupBy("site").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).withColumn("mean", F.col("good") / F.col("n")).withColumn("prior", F.lit(base))
    k = _strength(sites, "mean", "prior")
    sites = sites.select(F.col("site").alias("_site"), F.col("good").alias("site_good"), F.col("n").alias("site_n"), ((F.col("good") + k * base) / (F.col("n") + k)).alias("prior"))
    paths = materialize(paths.join(sites, F.col("site").eqNullSafe(F.col("_site"))).drop("_site").withColumn("mean", F.col("good") / F.col("n")), "quality-rates")
    m = _strength(paths, "mean", "prior")
    found = lookup(seen, paths.select("key", "n", "good", "site_good", "site_n"), "key", "n", rows).withColumn("own", 1 / (1 + F.exp(-F.col("evidence"))))
    # sums of doubles depend on their order; differences may be a little below 0
    found = found.withColumn("site_rate", (F.greatest(F.col("site_good") - F.col("own"), F.lit(0.0)) + k * base) / (F.col("site_n") - 1 + k))
    found = found.withColumn("path_rate", (F.greatest(F.col("good") - F.col("own"), F.lit(0.0)) + m * F.col("site_rate")) / (F.col("n") - 1 + m))
    odds = F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(base / (1 - base)))
    score = 1 / (1 + F.exp(-(F.col("evidence") + SITE_WEIGHT * odds)))
    return found.select("doc_id", "site", "path", "evidence", "site_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept"))
