"""Text and number normalisers as Column expressions. Only nfkc leaves the JVM, by Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are stripped, dash variants, blank marks, letters counted as Japanese.
WHITE = " \t\r\n\f\x0b　"
DASHES = "‐‑‒–—―−－"
LONG_DASHES = DASHES + "ー"
BLANKS = ("", "-", "－", "—")
JAPANESE = "[ぁ-んァ-ン一-龥]"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
THOUSANDS = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
DRAWING_CODE = r"^[A-Z]{1,4}-[A-Z0-9]{1,8}(-[A-Z0-9]{1,8})*$"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(text: Column, unicode: bool = True) -> Column:
    """NFKC form, null as empty. With unicode=False, for columns known to hold ASCII, the plan has no Python."""
    filled = F.coalesce(text, F.lit(""))
    return _nfkc(filled) if unicode else filled


def normal(text: Column, unicode: bool = True) -> Column:
    """NFKC and stripped."""
    return F.btrim(nfkc(text, unicode), F.lit(WHITE))


def without_spaces(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("　"), F.lit(""))


def compact(text: Column, unicode: bool = True) -> Column:
    """NFKC without half and full-width blanks."""
    return without_spaces(nfkc(text, unicode))


def join_key(text: Column, unicode: bool = True) -> Column:
    """Upper-case key without blanks; an empty one is null, so it joins with nothing."""
    return F.nullif(F.upper(without_spaces(normal(text, unicode))), F.lit(""))


def compare_key(text: Column, unicode: bool = True) -> Column:
    return F.lower(without_spaces(normal(text, unicode)))


def unify_dashes(text: Column, dashes: str = DASHES) -> Column:
    return F.translate(text, dashes, "-" * len(dashes))


def is_blank(text: Column) -> Column:
    """Null, or nothing but a blank mark."""
    return F.coalesce(F.btrim(text, F.lit(WHITE)).isin(*BLANKS), F.lit(True))


def parse_number(text: Column, unicode: bool = True) -> Column:
    """A double; null for blank marks and for what isn't a number. Commas are dropped first."""
    bare = F.replace(normal(text, unicode), F.lit(","), F.lit(""))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def format_12g(number: Column) -> Column:
    """Up to 12 significant digits without trailing zeros; null as empty."""
    shown = F.regexp_replace(F.format_string("%.12g", number), r"(\.\d*?)0+(e|$)", "$1$2")
    return F.when(number.isNotNull(), F.regexp_replace(shown, r"\.(e|$)", "$1")).otherwise(F.lit(""))


def drawing_code(text: Column, unicode: bool = True) -> Column:
    """An upper-case drawing number with plain dashes, or null if the text isn't one."""
    code = F.btrim(unify_dashes(F.upper(compact(text, unicode)), LONG_DASHES), F.lit("|,:;[](){}<>「」『』"))
    return F.when(code.rlike(DRAWING_CODE), code)


def clean_cell(text: Column, unicode: bool = True) -> Column:
    return F.btrim(F.replace(normal(text, unicode), F.lit(" "), F.lit("")), F.lit("|,:;[]()"))


def power_text(text: Column, unicode: bool = True) -> Column:
    """The first number of a text; one of more than three decimals is rounded half up to two."""
    bare = F.replace(compact(text, unicode), F.lit(","), F.lit(""))
    first = F.regexp_extract(bare, r"([+-]?\d+(?:\.\d+)?)", 1)
    decimals = F.length(F.regexp_extract(first, r"\.(\d+)", 1))
    rounded = F.round(first.try_cast("decimal(38,18)"), 2).cast("decimal(38,2)").cast("string")
    trimmed = F.regexp_replace(F.regexp_replace(rounded, r"0+$", ""), r"\.$", "")
    return F.when(decimals > 3, trimmed).otherwise(first)


def voltage_text(text: Column, unicode: bool = True) -> Column:
    """Three-phase spellings of 200 as 200, one-phase as 1φ200, a plain number without its unit, others as they are."""
    volt = F.upper(compact(text, unicode))
    digits = F.regexp_replace(volt, r"\D", "")
    number = F.regexp_extract(volt, r"^([+-]?\d+)V?$", 1)
    three = volt.rlike(r"3[Φφ/+$＊*]?200") | digits.isin("3200", "34200", "36200", "30200", "200")
    return F.when(volt == "1/200", F.lit("1φ200")).when(three, F.lit("200")).when(number != "", number).otherwise(volt)


def equipment_code(text: Column, unicode: bool = True) -> Column:
    """NFKC without blanks, all wave dashes as the full-width one."""
    return F.translate(compact(text, unicode), "~〜", "～～")


def looks_like_code(text: Column) -> Column:
    """Groups of A-Z, 0-9 and wave dashes joined by dashes, with a digit somewhere."""
    return text.rlike(r"^(?=.*\d)[A-Z0-9～~]+(-[A-Z0-9～~]+)*$")


def cell_text(text: Column) -> Column:
    """A cell's lines, stripped and joined by one blank, runs of blanks and tabs as one blank; null as empty."""
    whole = F.coalesce(text, F.lit(""))
    kept = F.filter(F.transform(F.split(whole, "\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: x != "")
    joined = F.btrim(F.regexp_replace(F.array_join(kept, " "), r"[ \t]+", " "), F.lit(WHITE))
    return F.when(whole == "", whole).when(whole.rlike(r"[\r\n\t]|  "), joined).otherwise(F.btrim(whole, F.lit(WHITE)))


def model_parts(text: Column) -> Column:
    """struct(maker, model): what stands before and after the first colon; without one, all is model."""
    parts = F.split(F.translate(text, "：", ":"), ":", 2)
    return F.struct(F.when(F.size(parts) > 1, F.btrim(parts[0])).otherwise(F.lit("")).alias("maker"), F.btrim(F.element_at(parts, -1)).alias("model"))


def clean_model(text: Column) -> Column:
    """A model name: plain dashes without blanks around them, cut at a numbered note or full stop."""
    plain = F.element_at(F.split(unify_dashes(text), r" \d+\. |。"), 1)
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, r"\s*-\s*", "-"), r"\s+", " "), F.lit(WHITE + ",;"))


def xml_escape(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a 0-based column number below 18,278."""
    one = F.chr(F.lit(65) + index % 26)
    two = F.when(index >= 26, F.chr(F.lit(65) + (F.floor(index / 26) - 1) % 26)).otherwise(F.lit(""))
    three = F.when(index >= 702, F.chr(F.lit(65) + (F.floor((index - 26) / 676) - 1) % 26)).otherwise(F.lit(""))
    return F.concat(three, two, one)
