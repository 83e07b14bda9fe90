"""Box algebra, interval buckets and nearest joins. Joins always have an equality on the page or another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def area(b: tuple[Column, ...]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 for disjoint boxes."""
    shared = intersection(a, b)
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(F.lit(0.0))


def union(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def x_overlap(a: tuple[Column, ...], b: tuple[Column, ...], least_width: float = 1.0) -> Column:
    """Shared width over the narrower one's."""
    shared = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    return shared / F.greatest(F.least(a[2] - a[0], b[2] - b[0]), F.lit(least_width))


def interval_bucket(x: Column, bounds: list[float]) -> Column:
    """Number of the half-open interval that holds x; null outside all."""
    found = F.when(x < bounds[0], F.lit(None).cast("int"))
    for k, end in enumerate(bounds[1:]):
        found = found.when(x < end, F.lit(k))
    return found


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, to: str, most: float, left_id: list[str], right_order: str) -> DataFrame:
    """Every left row with the nearest right row of its key within `most`, if any; of equals the lower right_order.

    Both sides are dealt by key and by bands of width `most`; a left row looks into its band and the two beside
    it, so a key with many rows spreads over its bands. left_id identifies a left row; right columns are in `nearest`.
    """
    banded = right.select(F.col(key).alias("_key"), F.floor(F.col(to) / most).alias("_band"), F.struct(*right.columns).alias("_right"))
    looks = left.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(at) / most) + d)))
    pairs = looks.join(banded, (F.col(key) == F.col("_key")) & (looks["_band"] == banded["_band"]) & (F.abs(F.col(at) - F.col(f"_right.{to}")) <= most))
    best = pairs.groupBy(*left_id).agg(F.min_by("_right", F.struct(F.abs(F.col(at) - F.col(f"_right.{to}")), F.col(f"_right.{right_order}"))).alias("nearest"))
    return left.join(best, left_id, "left")


def asof_above(rows: DataFrame, heads: DataFrame, key: str, y: str, head_y: str, reach: float = 0.0) -> DataFrame:
    """rows and `above`: the largest head of the key that is less than y + reach. One sort of both sides, no pairs."""
    marks = heads.select(F.col(key).alias(key), F.col(head_y).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.col(head_y).cast("double").alias("_head"))
    marks = marks.select("*", *(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != key))
    asked = rows.select(key, (F.col(y) + reach).cast("double").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_head"), *(c for c in rows.columns if c != key))
    order = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = asked.unionByName(marks).withColumn("above", F.max("_head").over(order))
    return both.filter("_kind = 0").select(*rows.columns, "above")


def semi_or_all(rows: DataFrame, heads: DataFrame, key: str, y: str, head_y: str, low: float, high: float) -> DataFrame:
    """Rows with a head of their key `low` to `high` below them; all rows of a key in which none has one."""
    near = (rows[key] == heads[key]) & heads[head_y].between(rows[y] + low, rows[y] + high)
    flagged = rows.join(heads.select(key, head_y), near, "left_semi").withColumn("_hit", F.lit(True))
    keys = flagged.select(key).distinct()
    return flagged.drop("_hit").unionByName(rows.join(keys, key, "left_anti").select(*rows.columns))
