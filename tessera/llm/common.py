"""Shared helpers: work folder, materialised tables, skew-safe lookups, Arrow column access."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_folder

_left: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the work folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_clear)
    _left.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _left:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone at exit; the folder then stays for its owner to clear
            return


def forget_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _left.remove((spark, path))


def forget(df: DataFrame) -> None:
    """Delete the table that materialize returned as df, which nothing may read any more."""
    forget_path(df.sparkSession, df._table_path)


def made_so_far() -> int:
    """A mark for forget_since."""
    return len(_left)


def forget_since(mark: int, keep: DataFrame) -> None:
    """Delete the tables made since the mark but `keep`, once nothing reads them any more."""
    for spark, path in list(_left[mark:]):
        if path != getattr(keep, "_table_path", None):
            forget_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the work folder and read it back: it cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._table_path = path
    return table


def free_name(df: DataFrame, name: str) -> str:
    """`name` with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def release_memory() -> None:
    """Give freed memory of a Python worker back, which otherwise keeps it for as long as Spark keeps the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        return


def hot_key_limit(rows: int) -> int:
    """Rows from which a key counts as hot. At most 10,000 keys can have so many of `rows` rows."""
    return max(1000, rows // 10_000)


def lookup(left: DataFrame, right: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Inner join of `left` with `right`, which has one row for each non-null key and its number of left rows in `size`.

    Keys with many rows are joined by broadcast: of `rows` left rows no more than 10,000 keys can reach
    hot_key_limit, which bounds the broadcast. The rest shuffles, with no key above that limit.
    `left` is read twice, so it should be a materialised table.
    """
    limit = hot_key_limit(rows)
    hot = F.broadcast(right.filter(F.col(size) >= limit))
    cold = right.filter(F.col(size) < limit)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its len + 1 offsets into them, null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, every other character as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def sql_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def totals_before(df: DataFrame, order: str, values: list[str], keys: list[str] | None = None, block: int = 4096) -> DataFrame:
    """df and, for each of `values`, `before_<value>`: its total over the rows of the same keys with a smaller `order`.

    `order` is a non-negative integer, unique within the keys. Blocks of it are summed first, so no window
    holds more than `block` rows or one row a block.
    """
    keys = keys or []
    spread = df.withColumn("_block", F.floor(F.col(order) / block))
    blocks = spread.groupBy(*keys, "_block").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *(F.coalesce(F.sum(f"_sum_{v}").over(over), F.lit(0)).alias(f"_base_{v}") for v in values))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for v in values:
        spread = spread.withColumn(f"_own_{v}", F.coalesce(F.sum(v).over(within), F.lit(0)))
    # keys may be null
    same = [spread[k].eqNullSafe(blocks[k]) for k in [*keys, "_block"]]
    joined = spread.join(blocks, [c for c in same])
    return joined.select(*(spread[c] for c in df.columns), *((F.col(f"_own_{v}") + F.col(f"_base_{v}")).alias(f"before_{v}") for v in values))
