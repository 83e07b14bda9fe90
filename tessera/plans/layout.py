"""Rows and segments of positioned words as DataFrame expressions. Words: page, ord, text, cx, cy, x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cluster import chain_cluster

#: Pixels within which words are of one row, and the widest gap inside a cell.
ROW_GAP, CELL_GAP = 20.0, 70.0


def rows_by_mean(words: DataFrame, threshold: float = ROW_GAP) -> DataFrame:
    """words and `row`: words in order of cy join the last row while within threshold of its mean so far.

    The rule is a fold; a gap wider than the threshold always begins a row, so only words between two such gaps are
    gathered.
    """
    word = F.struct("cy", "ord", *(c for c in words.columns if c not in ("cy", "ord", "page")))
    pages = chain_cluster(words, ["page"], "cy", threshold, ["ord"], "_island").groupBy("page", "_island").agg(F.sort_array(F.collect_list(word)).alias("words"))

    def step(done, w):
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (F.abs(w["cy"] - last["mean"]) <= threshold)
        mean = F.when(joins, (last["mean"] * last["n"].cast("double") + w["cy"]) / (last["n"] + 1)).otherwise(w["cy"])
        return F.concat(done, F.array(F.struct(mean.alias("mean"), F.when(joins, last["n"] + 1).otherwise(1).alias("n"), F.when(joins, last["row"]).otherwise(F.coalesce(last["row"], F.lit(-1)) + 1).alias("row"))))

    marks = F.aggregate("words", F.array().cast("array<struct<mean:double,n:int,row:int>>"), step)
    flat = pages.withColumn("marks", marks).select("page", "_island", F.explode(F.arrays_zip("words", "marks")).alias("z"))
    number = F.dense_rank().over(Window.partitionBy("page").orderBy("_island", "z.marks.row")) - 1
    return flat.select("page", F.col("z.words.*"), number.cast("long").alias("row")).select(*words.columns, "row")


def segments(words: DataFrame, threshold: float = ROW_GAP, gap: float = CELL_GAP) -> DataFrame:
    """page, row, part, x0, x1, top, bottom, text: runs of a row's words without a gap wider than `gap`."""
    found = rows_by_mean(words, threshold)
    order = Window.partitionBy("page", "row").orderBy("cx", "ord")
    starts = F.when(F.col("x0") - F.lag("x1").over(order) > gap, 1).otherwise(0)
    found = found.withColumn("_s", starts).withColumn("part", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cx", "ord", "text"))), lambda w: w["text"]), "")
    return found.groupBy("page", "row", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("top"), F.max("y1").alias("bottom"), joined.alias("text"))
