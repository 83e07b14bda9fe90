"""Nested JSON documents as rows: words of recognised text, rooms of area surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WHITE

_WORD = "struct<symbols:array<struct<text:string>>,boundingBox:struct<vertices:array<struct<x:double,y:double>>>>"
#: The nesting of a text recognition's answer, and the fields of a surveyed room.
OCR_SCHEMA = f"struct<fullTextAnnotation:struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<{_WORD}>>>>>>>>>"
ROOM_FIELDS = ("room_name", "area_m2", "tatami", "calculation", "floor", "wall", "ceiling", "baseboard", "床", "壁", "天井", "巾木")
ROOM_SCHEMA = "struct<diagram_type:string,data:struct<room_areas:array<struct<" + ",".join(f"`{c}`:string" for c in ROOM_FIELDS) + ">>>>"
DIAGRAM_TYPES = ("detailed", "simple")


def _ends(vertices: Column, axis: str) -> tuple[Column, Column]:
    own = F.transform(vertices, lambda v: F.coalesce(v[axis], F.lit(0.0)))
    return F.array_min(own), F.array_max(own)


def ocr_words(documents: DataFrame, json: str = "json", page: str = "page") -> DataFrame:
    """page, ord, text, cx, cy, x0, y0, x1, y1 of every word with a text, from the JSON answer for each page.

    A corner without a coordinate stands at 0. An answer that isn't of this form, or has no words, gives no rows.
    """
    pages = F.from_json(F.col(json), OCR_SCHEMA)["fullTextAnnotation"]["pages"]
    paragraphs = F.flatten(F.transform(F.flatten(F.transform(pages, lambda p: p["blocks"])), lambda b: b["paragraphs"]))
    words = F.flatten(F.transform(paragraphs, lambda g: g["words"]))
    rows = documents.select(F.col(page).alias("page"), F.posexplode(words).alias("ord", "w"))
    text = F.btrim(F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), ""), F.lit(WHITE))
    (x0, x1), (y0, y1) = (_ends(F.col("w.boundingBox.vertices"), axis) for axis in "xy")
    rows = rows.select("page", F.col("ord").cast("long").alias("ord"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).filter("text <> ''")
    return rows.select("page", "ord", "text", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "y0", "x1", "y1")


def diagram_type(value: Column) -> Column:
    """One of DIAGRAM_TYPES, or unknown."""
    bare = F.lower(F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITE)))
    return F.when(bare.isin(*DIAGRAM_TYPES), bare).otherwise("unknown")


def room_rows(documents: DataFrame, json: str = "json", key: str = "key") -> DataFrame:
    """key, ord, diagram_type and the fields of each room, numbers as text; JSON without rooms gives no rows."""
    own = F.from_json(F.col(json), ROOM_SCHEMA)
    rows = documents.select(F.col(key).alias("key"), diagram_type(own["diagram_type"]).alias("diagram_type"), F.posexplode(own["data"]["room_areas"]).alias("ord", "r"))
    return rows.filter("r IS NOT NULL").select("key", F.col("ord").cast("long").alias("ord"), "diagram_type", *(F.col(f"r.`{c}`").alias(c) for c in ROOM_FIELDS))
