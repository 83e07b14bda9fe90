"""One-dimensional and box clustering over ordered rows. Every operator needs a partition key: a page, section or type."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain_cluster(rows: DataFrame, keys: list[str], value: str, tolerance: float, ties: list[str] | None = None, name: str = "cluster") -> DataFrame:
    """rows and `name`: a new cluster begins where the gap to the previous value exceeds tolerance. 0-based in each key."""
    order = Window.partitionBy(*keys).orderBy(value, *(ties or []))
    starts = F.when(F.col(value) - F.lag(value).over(order) > tolerance, 1).otherwise(0)
    return rows.withColumn("_start", starts).withColumn(name, F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_start")


def chain_centers(rows: DataFrame, keys: list[str], value: str, tolerance: float, ties: list[str] | None = None) -> DataFrame:
    """keys, cluster, center, n of chain_cluster."""
    return chain_cluster(rows, keys, value, tolerance, ties).groupBy(*keys, "cluster").agg(F.avg(value).alias("center"), F.count(F.lit(1)).alias("n"))


def running_mean_clusters(values: Column, tolerance: float) -> Column:
    """array of struct(mean, n) of ascending doubles: a value joins the last cluster while within tolerance of its mean so far."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(((last["mean"] * last["n"].cast("double") + x) / (last["n"] + 1).cast("double")).alias("mean"), (last["n"] + 1).cast("int").alias("n"))
        alone = F.struct(x.alias("mean"), F.lit(1).alias("n"))
        joins = (F.size(done) > 0) & (F.abs(x - F.try_element_at(done, F.lit(-1))["mean"]) <= tolerance)
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(alone)))

    return F.aggregate(values, F.array().cast("array<struct<mean:double,n:int>>"), step)


def running_mean_cluster(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, cluster, center, n. The rule looks at an evolving mean, so a window can't express it; a fold over sorted values does.

    A gap wider than the tolerance always begins a cluster, as a mean is never above its last value. So values are cut there
    first, by a window, and only the values between two such gaps are gathered into one row.
    """
    islands = chain_cluster(rows.select(*keys, F.col(value).cast("double").alias("_value")), keys, "_value", tolerance, name="_island")
    folded = islands.groupBy(*keys, "_island").agg(F.sort_array(F.collect_list("_value")).alias("_values"))
    found = folded.select(*keys, "_island", F.posexplode(running_mean_clusters(F.col("_values"), tolerance)).alias("_place", "_c"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_island", "_place")) - 1
    return found.select(*keys, number.cast("long").alias("cluster"), F.col("_c.mean").alias("center"), F.col("_c.n").cast("long").alias("n"))


def thin(rows: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """keys, kept: of the sorted values, the first and each that is `least` or more beyond the last kept one.

    A value `least` or more beyond the one before it is always kept, so only the values between two such are folded together.
    """
    order = Window.partitionBy(*keys).orderBy("_value")
    own = rows.select(*keys, F.col(value).cast("double").alias("_value"))
    own = own.withColumn("_start", F.when(F.col("_value") - F.lag("_value").over(order) >= least, 1).otherwise(0))
    own = own.withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    values = F.sort_array(F.collect_list("_value"))
    kept = F.aggregate("_values", F.array().cast("array<double>"), lambda done, x: F.when((F.size(done) == 0) | (x - F.try_element_at(done, F.lit(-1)) >= least), F.concat(done, F.array(x))).otherwise(done))
    return own.groupBy(*keys, "_island").agg(values.alias("_values")).select(*keys, F.explode(kept).alias("kept"))


def gap_split(rows: DataFrame, keys: list[str], left: str, right: str, most: float, ties: list[str] | None = None, name: str = "part") -> DataFrame:
    """rows and `name`: a new part begins where a row's left edge is more than `most` beyond the previous row's right edge."""
    order = Window.partitionBy(*keys).orderBy(left, *(ties or []))
    starts = F.when(F.col(left) - F.lag(right).over(order) > most, 1).otherwise(0)
    return rows.withColumn("_start", starts).withColumn(name, F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_start")


def first_fit_boxes(rows: DataFrame, key: str, most_dy: float = 140.0, least_overlap: float = 0.18) -> DataFrame:
    """rows (key, ord, x0, y0, x1, y1) and `box`: the first growing box each fits into, in order of y0 and x0.

    A box fits if its vertical gap is at most most_dy and the horizontal overlap, of the narrower one, is
    least_overlap or more. Each choice depends on those before it, so a key's rows go to one task.
    """
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", box long"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y0", "x0", "ord"], kind="stable")
        boxes: list[list[float]] = []
        chosen = []
        for x0, y0, x1, y1 in zip(frame.x0, frame.y0, frame.x1, frame.y1):
            for k, b in enumerate(boxes):
                shared = min(x1, b[2]) - max(x0, b[0])
                if y0 - b[3] <= most_dy and b[1] - y1 <= most_dy and shared / max(1e-9, min(x1 - x0, b[2] - b[0])) >= least_overlap:
                    boxes[k] = [min(x0, b[0]), min(y0, b[1]), max(x1, b[2]), max(y1, b[3])]
                    break
            else:
                k = len(boxes)
                boxes.append([x0, y0, x1, y1])
            chosen.append(k)
        return frame.assign(box=chosen)

    return rows.groupBy(key).applyInPandas(fit, schema)


@dataclass
class Mark:
    """A row of a section: its line, its place and its model's place in the line, its block, and its code if it has one."""

    y: float
    x: float
    model_x: float
    block: int
    code: str


def propagate(marks: list[Mark], most_gap: float = 120.0, by_block: bool = True) -> None:
    """Give marks without a code one.

    A line without any code takes those of the nearest earlier line that has some, if that is within most_gap: place by
    place if both have as many marks, else each mark that of the nearest model that no other mark of the line took, or of
    all once each is taken. Lines filled so serve later ones. Then what is left takes the last code above it in its block.
    """
    lines: dict[float, list[Mark]] = {}
    for m in marks:
        lines.setdefault(m.y, []).append(m)
    source: tuple[float, list[Mark]] | None = None
    for y in sorted(lines):
        own = sorted(lines[y], key=lambda m: m.x)
        if not any(m.code for m in own) and source and y - source[0] <= most_gap:
            free: list[Mark] = []
            for k, m in enumerate(own):
                if len(own) == len(source[1]):
                    taken = source[1][k]
                else:
                    free = free or list(source[1])
                    taken = min(free, key=lambda s: abs(s.model_x - m.model_x))
                    free = [s for s in free if s is not taken]
                m.code, m.block, m.model_x = taken.code, taken.block, taken.model_x
        if full := [m for m in own if m.code]:
            source = (y, full)
    if by_block:
        last: dict[int, str] = {}
        for m in sorted(marks, key=lambda m: (m.y, m.x)):
            m.code = m.code or last.get(m.block, "")
            last[m.block] = m.code


def greedy_propagate(rows: DataFrame, key: str, most_gap: float = 120.0) -> DataFrame:
    """rows (key, ord, y, x, code and, if known, block and model_x) with empty codes filled by `propagate`.

    Without a block column no row is filled by its block. Each choice depends on those before it, so a key's rows go to
    one task; keys are sections of pages.
    """
    blocks, models = "block" in rows.columns, "model_x" in rows.columns

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x", "ord"], kind="stable")
        marks = [Mark(y, x, m, b, c or "") for y, x, m, b, c in zip(frame.y, frame.x, frame.model_x if models else frame.x, frame.block if blocks else [0] * len(frame), frame.code)]
        propagate(marks, most_gap, blocks)
        found = {"code": [m.code for m in marks]} | ({"block": [m.block for m in marks]} if blocks else {}) | ({"model_x": [m.model_x for m in marks]} if models else {})
        return frame.assign(**found)

    return rows.groupBy(key).applyInPandas(fill, rows.schema)
