"""Ordered scans in a partition key: fill-down, sections, record assembly and stop rules, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str | None = None) -> DataFrame:
    """rows with the last non-empty value of a column."""
    value = F.when(F.col(column) != "", F.col(column))
    return rows.withColumn(name or column, F.last(value, ignorenulls=True).over(_upto(keys, order)))


def split_sections(rows: DataFrame, keys: list[str], order: list[str], is_head: Column) -> DataFrame:
    """rows and `section`: the number of heads so far, without the heads and what stands before the first."""
    found = rows.withColumn("_head", F.coalesce(is_head, F.lit(False))).withColumn("section", F.sum(F.col("_head").cast("long")).over(_upto(keys, order)))
    return found.filter("section > 0 AND NOT _head").drop("_head")


def assemble_records(rows: DataFrame, keys: list[str], order: list[str], code: str, is_stop: Column | None = None) -> DataFrame:
    """rows and `record`: a row with a code begins a record unless the code is that of the previous code row.

    Rows without a code continue the record; rows before the first one go. The first stop after a record has begun
    ends the scan.
    """
    upto = _upto(keys, order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col(code) != "", F.col(code))
    found = rows.withColumn("_code", value).withColumn("_last", F.last("_code", ignorenulls=True).over(before))
    starts = F.col("_code").isNotNull() & ~F.col("_code").eqNullSafe(F.col("_last"))
    found = found.withColumn("record", F.sum(starts.cast("long")).over(upto)).filter("record > 0")
    if is_stop is not None:
        found = found.withColumn("_stop", F.coalesce(is_stop, F.lit(False))).withColumn("_done", F.max(F.col("_stop").cast("int")).over(upto)).filter("_done = 0").drop("_stop", "_done")
    return found.drop("_code", "_last")


def take_until(rows: DataFrame, keys: list[str], order: list[str], is_stop: Column) -> DataFrame:
    """Rows before the first stop of each key."""
    found = rows.withColumn("_done", F.max(F.coalesce(is_stop, F.lit(False)).cast("int")).over(_upto(keys, order)))
    return found.filter("_done = 0").drop("_done")


def stop_after(rows: DataFrame, keys: list[str], order: list[str], is_data: Column, gap: int) -> DataFrame:
    """Data rows until more than `gap` rows in a row after a data row are none."""
    upto = _upto(keys, order)
    found = rows.withColumn("_data", F.coalesce(is_data, F.lit(False))).withColumn("_island", F.sum(F.col("_data").cast("int")).over(upto))
    islands = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("_misses", F.sum((~F.col("_data")).cast("int")).over(islands))
    found = found.withColumn("_done", F.max(((F.col("_island") > 0) & (F.col("_misses") > gap)).cast("int")).over(upto))
    return found.filter("_done = 0 AND _data").drop("_data", "_island", "_misses", "_done")


def first_kept(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each distinct value of keys."""
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def route_with_fallback(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The preferred rows of a key, or the other route's where there are none, with `route`."""
    spare = other.join(preferred.select(key).distinct(), key, "left_anti").select(*other.columns)
    return preferred.withColumn("route", F.lit("preferred")).unionByName(spare.withColumn("route", F.lit("fallback")))


def header_paths(parents: list[str], children: list[str], joint: str = "_") -> list[str]:
    """Flat names of a two-row header: each child under the last parent named so far."""
    names, last = [], ""
    for parent, child in zip(parents, children):
        last = parent or last
        names.append(joint.join(x for x in ((last, child) if child else (parent or last,)) if x))
    return names


def grid_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, left_value, right_value of the cells that differ or that only one grid has."""
    a, b = left.select(*keys, F.col(value).alias("left_value")), right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, upper_median: the element after the middle of the sorted values, by rank, so no key's values are gathered."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("_rank") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias("upper_median"))
