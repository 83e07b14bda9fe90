"""Readers and writers: text-only CSV with an order column, ragged rows, manifests, and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import xml_escape

BOM = "﻿"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text with null as empty, and `ord`, which follows the order in its files.

    Fields may hold line ends. The byte order mark is dropped. A file without a header raises ValueError.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if not rows.columns:
        raise ValueError(f"{path} has no header")
    return rows.na.fill("").select(F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("ord"), *(F.col(f"`{c}`") for c in rows.columns))


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """ord and cells (array of text) of a CSV without a header whose rows differ in length."""
    lines = spark.read.text(path)
    bare = F.replace(F.col("value"), F.lit(BOM), F.lit(""))
    cells = F.regexp_extract_all(bare, F.lit(r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,"]*))'), 0)
    plain = F.transform(cells, lambda c, i: F.when(i > 0, F.substr(c, F.lit(2))).otherwise(c))
    unquoted = F.transform(plain, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return lines.select(F.monotonically_increasing_id().alias("ord"), unquoted.alias("cells"))


def ragged_lines(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """One text column: the cells of each row as a CSV line, quoted where they need it."""
    quoted = F.transform(F.col(cells), lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return rows.select(F.array_join(quoted, ",").alias("value"))


def write_csv(rows: DataFrame, path: str, order: list[str], bom: bool = True) -> None:
    """Rows in order as CSV files under `path`, whose names sort in that order; the header, with a byte order mark if wanted, is in each."""
    names = [c for c in rows.columns if c not in order]
    shown = rows.orderBy(*order).select(*(F.col(f"`{c}`").cast("string").alias((BOM if bom and i == 0 else "") + c) for i, c in enumerate(names)))
    shown.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def profile(rows: DataFrame, ord: str = "ord") -> DataFrame:
    """n_rows and the column names of a table."""
    names = [c for c in rows.columns if c != ord]
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("columns", F.lit(",".join(names)))


def ragged_profile(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """n_rows and the widest row's number of cells."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.max(F.size(cells)), F.lit(0)).cast("long").alias("n_columns"))


def sheet_rows(rows: DataFrame, cells: str = "cells", number: str = "number") -> DataFrame:
    """The XML of spreadsheet rows, one text a row, from arrays of cell texts and 1-based row numbers."""
    from tessera.functions.text import column_letters

    cell = F.transform(F.col(cells), lambda c, i: F.concat(F.lit('<c r="'), column_letters(i), F.col(number).cast("string"), F.lit('" t="inlineStr"><is><t>'), xml_escape(c), F.lit("</t></is></c>")))
    return rows.select(number, F.concat(F.lit('<row r="'), F.col(number).cast("string"), F.lit('">'), F.array_join(cell, ""), F.lit("</row>")).alias("xml"))


def manifest(spark: SparkSession, job_id: str, kind: str, source: str, extra: dict[str, str] | None = None) -> DataFrame:
    """One row that describes a job; keys of `extra` override the others."""
    own = spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit(kind).alias("kind"), F.lit(source).alias("source_filename"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("created_at"))
    return own.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})
