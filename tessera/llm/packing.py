"""Mixture-controlled packing of documents into sequences by deficit round-robin over source queues.

Documents are encoded once into a table and dealt to shards of a bounded number of tokens. In a shard every source has
a queue and a deficit. Each window, which is one sequence, adds to each source's deficit its share of the window;
sources are then served in turn, down to their deficit, in pieces of some length, and what a source was served too
little or too much carries over to the next window.

Every document is packed, so the target proportions can hold only until a source runs out. Hence shards come in
phases: in the first all sources have their target shares, until one is used up; in the next the others share
the windows in their own proportions, and so on; sources without a target come last. Within a phase each source is
dealt evenly over the shards by quantiles of a hash, so every shard holds the phase's proportions. A source's
dealt tokens before a shard against its target up to there are the deficit with which the shard starts, one window
at most, so deficits carry over partitions too while all shards are packed in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release_memory, texts_of, totals_before
from tessera.llm.token_ids import encoder_of

LENGTH = 2048
#: Tokens of a shard, on average: what one task holds.
SHARD_TOKENS = 1 << 20
#: Most sources that are dealt by quantiles (the largest, or those with a target; the rest is dealt as one), and most quantiles of all.
MAX_CLASSES, QUANTILES = 256, 1 << 16
#: Bytes of ids that one task packs.
TASK_BYTES = 64 << 20
#: Rows whose texts and ids an encoding task holds at once, of the batch that it is given.
ROWS = 1024
#: A source is served once its deficit reaches so many tokens, which keeps pieces from being cut too small.
LEAST_PIECE = 128


def row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, at most ROWS at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def encode_documents(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A table of doc_id, source, ids (little-endian unsigned 32-bit), n_tokens and a hash that deals rows to shards."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = b"" if end_id is None else np.asarray([end_id], encoder.dtype).tobytes()
        for batch in row_slices(batches):
            ids = [x + end for x in encoder.encode(texts_of(batch.column(2)))]
            counts = pa.array([len(x) // encoder.dtype.itemsize for x in ids], pa.int64())
            widths = pa.array([encoder.dtype.itemsize] * len(ids), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), counts, widths], names=["doc_id", "source", "ids", "n_tokens", "width"])
        release_memory()

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    coded = own.mapInArrow(encode, f"doc_id {dict(own.dtypes)['doc_id']}, source string, ids binary, n_tokens long, width int")
    return materialize(coded.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "packing-ids")


def _pack_shard(ids: list[np.ndarray], queues: list[list[int]], shares: np.ndarray, deficits: np.ndarray, length: int, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece of a shard, in the order of the windows.

    queues: documents of each source; shares: target parts of a window; deficits: tokens each source is behind.
    """
    left = np.asarray([sum(len(ids[d]) for d in q) for q in queues], np.int64)
    deficits, heads, starts = deficits.astype(float).copy(), [0] * len(queues), [0] * len(queues)
    window, turn, n = 0, 0, len(queues)
    while left.any():
        room, offset = length, 0
        deficits += shares * length

        def serve(s: int, tokens: int) -> Iterator[tuple[int, int, int, int, int]]:
            nonlocal room, offset
            deficits[s] -= tokens
            left[s] -= tokens
            room -= tokens
            while tokens:
                doc = queues[s][heads[s]]
                own = min(tokens, len(ids[doc]) - starts[s])
                if own:
                    yield doc, starts[s], own, window, offset
                starts[s] += own
                offset += own
                tokens -= own
                if starts[s] == len(ids[doc]):
                    heads[s], starts[s] = heads[s] + 1, 0

        ready = np.flatnonzero((deficits >= least) & (left > 0))
        for s in (*ready[ready >= turn], *ready[ready < turn]):
            if not room:
                break
            yield from serve(s, int(min(deficits[s], left[s], room)))
            turn = (s + 1) % n
        while room and left.any():
            # nobody else is due: whoever is furthest behind borrows from its next windows
            s = int(np.argmax(np.where(left > 0, deficits, -np.inf)))
            yield from serve(s, int(min(max(deficits[s], least), left[s], room)))
        window += 1


def phases(totals: np.ndarray, shares: np.ndarray | None) -> list[np.ndarray]:
    """Tokens of each class in each phase: in proportion to the shares of those not used up, then all that is left."""
    left, found = totals.astype(float), []
    active = (shares > 0) & (left > 0) if shares is not None else np.zeros(len(left), bool)
    while active.any():
        take = np.where(active, shares, 0.0)
        take *= (left[active] / take[active]).min()
        left = np.maximum(left - take, 0.0)
        left[left < 0.5] = 0.0
        found.append(take)
        active &= left > 0
    return [*found, left] if left.any() or not found else found


def _deal(coded: DataFrame, shares: DataFrame | None, shard_tokens: int) -> tuple[DataFrame, DataFrame, int]:
    """coded with class and shard; (class, first, shards, tokens_before, tokens) of each class in each phase; the class of sources dealt together."""
    spark = coded.sparkSession
    sized = coded.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    if shares is None:
        known, weights = [r.source for r in sized.orderBy(F.desc("tokens"), "source").limit(MAX_CLASSES).collect()], None
    else:
        rows = shares.select(F.col("source").cast("string").alias("source"), F.col("share").cast("double").alias("share")).limit(MAX_CLASSES + 1).collect()
        if len(rows) > MAX_CLASSES or len({r.source for r in rows}) < len(rows) or any(r.share is None or r.share < 0 for r in rows):
            raise ValueError(f"shares must be those of at most {MAX_CLASSES} different sources, none negative")
        known, weights = [r.source for r in rows], np.array([*(r.share for r in rows), 0.0])
    other, blocks = len(known), QUANTILES // (len(known) + 1)
    classes = F.broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(known)], "_source string, _class int"))
    place = (F.col("deal") / 2.0**64 + 0.5) * blocks
    marked = coded.join(classes, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("class", F.coalesce("_class", F.lit(other))).drop("_source", "_class")
    marked = marked.withColumn("block", F.least(F.floor(place), F.lit(blocks - 1)).cast("int"))
    # at most QUANTILES rows
    sums = np.zeros((other + 1, blocks))
    for r in marked.groupBy("class", "block").agg(F.sum("n_tokens").alias("tokens")).collect():
        sums[r["class"], r.block] = r.tokens
    ends, found, first = np.cumsum(sums, axis=1), [], 0
    turns: list[list[tuple[float, float]]] = [[(0.0, -1.0)] for _ in range(other + 1)]
    for take in phases(ends[:, -1], weights):
        n = max(1, round(take.sum() / shard_tokens))
        for k in np.flatnonzero(take > 0):
            before = turns[k][-1][0]
            found.append((int(k), first, n, before, float(take[k])))
            turns[k] += [(before, float(first)), (before + float(take[k]), float(first + n))]
        first += n
    rows = []
    for k, row in enumerate(ends):
        x, y = np.array(turns[k][1:] or [(0.0, 0.0)]).T
        at = np.interp(np.concatenate([[0.0], row]), x, y)
        rows += [(k, int(b), float(at[b]), float(at[b + 1])) for b in np.flatnonzero(sums[k])]
    spots = F.broadcast(spark.createDataFrame(rows, "_class int, _block int, low double, high double"))
    dealt = marked.join(spots, (F.col("class") == F.col("_class")) & (F.col("block") == F.col("_block")), "left")
    spot = F.floor(F.coalesce(F.col("low") + (place - F.col("block")) * (F.col("high") - F.col("low")), F.lit(0.0)))
    dealt = dealt.withColumn("shard", F.least(spot, F.lit(max(0, first - 1))).cast("long")).drop("_class", "_block", "low", "high", "block")
    return dealt, spark.createDataFrame(found, "_class int, first long, shards long, tokens_before double, target double"), other


def pack(
    docs: DataFrame, path: str, end_id: int | None = None, length: int = LENGTH, shares: DataFrame | None = None, shard_tokens: int = SHARD_TOKENS, least: int = LEAST_PIECE, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Pieces of all docs in sequences of at most `length` tokens: doc_id, source, start, length, doc_tokens, sequence_id, offset, ids.

    Each id of a document, encoded with the tokenizer file at `path` and closed by `end_id`, lies in exactly one
    piece. All sequences are full but the last of each shard. `shares` (source, share) gives the target
    proportions, of at most MAX_CLASSES sources; they hold until one of these runs out, then the others keep theirs, and
    sources left out come last. Without it the proportions are those of all tokens. Null text counts as empty, a null source is a
    source of its own, rows with null or repeated ids are packed each, a document without ids has no piece, an
    empty table gives an empty one, and a long text is cut over as many sequences as it takes; one task holds the
    documents of a shard. Other columns are ignored. ids are little-endian unsigned 32-bit integers.
    """
    coded = encode_documents(docs, path, end_id, doc_id, text, source)
    dealt, plan_of, other = _deal(coded, shares, shard_tokens)
    total = coded.agg(F.sum("n_tokens")).first()[0] or 0
    counts = materialize(dealt.groupBy("shard", "class", "source").agg(F.sum("n_tokens").alias("tokens")), "packing-counts")
    sums = totals_before(counts.groupBy("shard").agg(F.ceil(F.sum("tokens") / length).alias("windows")), "shard", ["windows"])
    plan = totals_before(counts, "shard", ["tokens"], ["source"]).drop("tokens").join(sums.select("shard", "before_windows"), "shard")
    phase = (F.col("class") == F.col("_class")) & (F.col("shard") >= F.col("first")) & (F.col("shard") < F.col("first") + F.col("shards"))
    wanted = F.col("tokens_before") + F.col("target") * (F.col("shard") - F.col("first")) / F.col("shards")
    plan = plan.join(F.broadcast(plan_of), phase, "left")
    behind = F.greatest(F.lit(-float(length)), F.least(F.lit(float(length)), F.coalesce(wanted - F.col("before_tokens"), F.lit(0.0))))
    # sources that are dealt together have no target of their own
    plan = plan.select("shard", "source", F.when(F.col("class") < other, behind).otherwise(0.0).alias("deficit"), "before_windows")
    id_type = dict(coded.dtypes)["doc_id"]

    def pack_group(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("deal", "ascending")])
        names = right.column("source").to_pylist()
        order = sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k] or ""))
        place = {names[k]: i for i, k in enumerate(order)}
        ids = [np.frombuffer(x, f"<u{w}") for x, w in zip(left.column("ids").to_pylist(), left.column("width").to_pylist())]
        sources, queues = left.column("source").to_pylist(), [[] for _ in order]
        for d, s in enumerate(sources):
            if len(ids[d]):
                queues[place[s]].append(d)
        # a shard's own proportions are the target's, and with them no source is left over at its end
        share = np.array([sum(len(ids[d]) for d in q) for q in queues], float)
        share /= share.sum() or 1
        deficit = right.column("deficit").to_numpy()[order]
        deficit = deficit - share * deficit.sum()
        base = right.column("before_windows")[0].as_py() if len(names) else 0
        rows = list(_pack_shard(ids, queues, share, deficit, length, least))
        taken = pa.array([r[0] for r in rows], pa.int64())
        at, own, offset = (pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 4))
        packed = pa.table(
            {
                "doc_id": left.column("doc_id").take(taken),
                "source": left.column("source").take(taken),
                "start": at,
                "length": own,
                "doc_tokens": left.column("n_tokens").take(taken),
                "sequence_id": pa.array([base + r[3] for r in rows], pa.int64()),
                "offset": offset,
                "ids": pa.array([ids[d][a : a + m].astype("<u4").tobytes() for d, a, m, _, _ in rows], pa.binary()),
            }
        )
        release_memory()
        return packed

    parts = max(1, -(-4 * total // TASK_BYTES))
    left = dealt.select("doc_id", "source", "ids", "n_tokens", "width", "deal", "shard").repartition(parts, "shard")
    return left.groupBy("shard").cogroup(plan.repartition(parts, "shard").groupBy("shard")).applyInArrow(pack_group, f"doc_id {id_type}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
