"""Reconciliation of tables that arrive as files, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.reconcile import reconcile

OBSERVED = "ord long, id string, name string, voltage string, capacity_text string, drawing_no string"


def observed_stream(spark: SparkSession, folder: str, schema: str = OBSERVED) -> DataFrame:
    """Observed rows from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def counts_by_key(stream: DataFrame, time: str, delay: str, width: str) -> DataFrame:
    """Observed rows for each window and key, with a watermark, so state is dropped once a window is past `delay`."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), F.upper(F.col("id")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("name").alias("names"))


def reconcile_stream(declared: DataFrame, stream: DataFrame, out: str, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """After each batch, reconcile all rows that arrived so far with the declared table, under the batch's number.

    Each batch leaves its rows under `_seen`, equal texts as one row with their number, so what is read again grows with
    the different texts and not with the rows. A batch that runs again overwrites what it wrote, so each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        texts = [c for c in batch.columns if c != "ord"]
        own = batch.groupBy(*texts).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("times"))
        own.write.mode("overwrite").parquet(f"{out}/_seen/batch={number}")
        seen = spark.read.option("basePath", f"{out}/_seen").parquet(f"{out}/_seen/batch=*").filter(F.col("batch") <= number)
        # rows of earlier batches come first
        seen = seen.withColumn("ord", F.struct("batch", "ord")).drop("batch")
        reconcile(declared, seen, strict).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The rows of the last batch that reconcile_stream wrote: those of all that arrived."""
    rows = spark.read.parquet(out)
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
