"""Pattern extraction from text: makers and models, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import LONG_DASHES, clean_model, model_parts, nfkc, unify_dashes

#: Patterns of drawing numbers in running text, and of models.
DRAWING_INSIDE = r"[A-Z]{1,4}-[A-Z0-9]{1,8}(?:-[A-Z0-9]{1,8})*"
MODEL = r"([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)(\([xX×]\d+\))?"


def drawing_codes(text: Column, unicode: bool = True) -> Column:
    """The distinct drawing numbers in a text, in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(unify_dashes(F.upper(nfkc(text, unicode)), LONG_DASHES), F.lit(f"({DRAWING_INSIDE})"), 1))


def maker_and_model(text: Column) -> Column:
    """struct(maker, model) of a text with a colon, else its first hyphenated model with a multiplier after it."""
    parts = model_parts(text)
    first = F.concat(F.regexp_extract(text, MODEL, 1), F.regexp_extract(text, MODEL, 2))
    has = F.contains(F.translate(text, "：", ":"), F.lit(":"))
    return F.struct(F.when(has, parts["maker"]).otherwise("").alias("maker"), F.when(has, clean_model(parts["model"])).otherwise(first).alias("model"))
