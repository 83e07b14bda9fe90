"""The driver's tables in the shapes that the operators take. The SQL texts run on Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table

#: Lines in a total order: line numbers repeat within an order.
ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")

#: Every twelfth order's capacity is blank, a list, a text or modes; the others are near their first line's quantity.
CAPACITY = """CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN '0.75,1.5' WHEN 2 THEN '10VA' WHEN 3 THEN '(冷)9.45 / (暖)7.18'
  WHEN 4 THEN '(冷)5 (暖)5 (低温)1' WHEN 5 THEN '(暖)41' ELSE CAST(coalesce(first_quantity, 40.0) + (o_orderkey % 3 - 1) * (CASE WHEN o_orderkey % 4 = 3 THEN 0.5 ELSE 0.1 END) AS STRING) END"""
NAME = """CASE WHEN o_orderkey % 24 = 3 THEN '冷房専用 ' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN 'Z' WHEN o_orderkey % 35 = 1 THEN '' ELSE coalesce(first_flag, 'A') END"""
QTY = "CASE WHEN o_orderkey % 17 = 0 THEN '-' ELSE CAST(1 + o_orderkey % 2 AS STRING) END"


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a quantity over 40; those with a tax of 0.08 have no id."""
    lines = read_table(spark, folder, "lineitem").filter("l_quantity > 40")
    return lines.select(
        F.struct(*ORDER).alias("ord"),
        F.when(F.col("l_tax") != 0.08, F.col("l_orderkey").cast("string")).alias("id"),
        F.col("l_returnflag").alias("name"),
        F.lit("").alias("voltage"),
        F.col("l_quantity").cast("string").alias("capacity_text"),
        F.col("l_linestatus").alias("drawing_no"),
    )


def declared(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that aren't pending, which leaves the lines of pending ones undeclared."""
    lines = read_table(spark, folder, "lineitem").filter("l_quantity > 40 AND l_tax <> 0.08")
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct(*ORDER, "l_returnflag")).alias("f")).select("l_orderkey", F.col("f.l_quantity").alias("first_quantity"), F.col("f.l_returnflag").alias("first_flag"))
    orders = read_table(spark, folder, "orders").filter("o_orderstatus <> 'P'").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.expr(NAME).alias("name"), F.expr(CAPACITY).alias("capacity_text"), F.expr(QTY).alias("qty"), F.lit("M-1").alias("drawing_no"))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes from the first four dimensions of the embeddings: page, ord, x0, y0, x1, y1, cx, cy."""
    e = read_table(spark, folder, "embeddings")
    at = [(F.col("embedding")[k].cast("double") * 1000) for k in range(4)]
    found = e.select(F.col("label").cast("long").alias("page"), F.col("vec_id").cast("long").alias("ord"), at[0].alias("x0"), at[1].alias("y0"), (at[0] + F.abs(at[2]) + 1).alias("x1"), (at[1] + F.abs(at[3]) + 1).alias("y1"))
    return found.withColumn("cx", (F.col("x0") + F.col("x1")) / 2).withColumn("cy", (F.col("y0") + F.col("y1")) / 2)
