"""Tables that were read cell by cell: header detection, projection to the 19 fixed columns, records, drawing numbers.

Rows: page, ord, cells (array of text). Everything is a window or a fold over the rows of one record, so a page's
rows are sorted once and no more than a record's lines are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import predicates, text
from tessera.operators import extract, scan

#: Number of columns, and those of the id, name, power and count.
CELLS, ID, NAME, POWER, COUNT = 19, 0, 1, 9, 15
NOTE_PHRASES = ("記 事", "注記事項", "特記事項")
JOINT = " / "
#: Header words of a summary table, the rows that may hold its header, and those in which its id column is looked for.
ID_WORDS, NAME_WORDS, TOTAL_WORDS, SPEC_WORDS = ("機器番号", "記号"), ("名称",), ("合計",), ("仕様",)
HEADER_ROWS, FIRST_ROWS = 8, 4
#: The default header, as column: text of the first and of the second row.
HEADER_1 = {0: "機器番号", 1: "名称", 2: "系統", 3: "仕様", 8: "動力 (50Hz)", 14: "付属品・その他", 15: "台数", 16: "設置場所", 18: "備考"}
HEADER_2 = {4: "番手 #(φ)", 5: "機器風量 m3/h", 6: "静圧 Pa", 7: "騒音値 (dB)", 8: "相 P-V", 9: "消費電力 (KW)", 10: "始動方式", 11: "操作", 12: "監視", 13: "種別", 16: "階", 17: "部屋名", 18: "(参考型番)"}
FOUR_COLUMNS = {"id": "機器番号", "name": "名称", "power": "動力 (50Hz)_消費電力 (KW)", "count": "台数", "drawing_no": "図面番号"}
#: An air conditioner's name as it comes apart, and whole.
BROKEN_NAMES = ((r"ルームエアコ\s*マルチタイプン", "ルームエアコン マルチタイプ"), (r"ルームエアコ\s*ン", "ルームエアコン"))
#: Share of a page's width and height from which on a drawing number without a label is looked for.
CORNER = 0.65


def default_header() -> list[list[str]]:
    """The two header rows that stand where none can be read."""
    return [[own.get(k, "") for k in range(CELLS)] for own in (HEADER_1, HEADER_2)]


def summary_name(name: Column) -> Column:
    name = text.cell_text(name)
    for broken, whole in BROKEN_NAMES:
        name = F.regexp_replace(name, broken, whole)
    return text.cell_text(name)


def joined_once(base: Column, more: Column, joint: str = JOINT) -> Column:
    """base and what it doesn't list yet."""
    known = F.transform(F.split(base, joint), lambda x: F.btrim(x))
    return F.when(more == "", base).when(base == "", more).when(F.array_contains(known, more), base).otherwise(F.concat(base, F.lit(joint), more))


def joined_names(base: Column, more: Column) -> Column:
    """Two parts of a name, of which one may hold the other."""
    a, b = summary_name(base), summary_name(more)
    return F.when(b == "", a).when(a == "", b).when(F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.concat(a, F.lit(" "), b))


def _merged(first: Column, others: Column) -> Column:
    """A record's cells: those of its first row with what the others add, column by column."""

    def add(done: Column, row: Column) -> Column:
        bare = (F.element_at(done, POWER + 1) == "") & (F.element_at(row, POWER + 1) == "")

        def cell(value: Column, k: Column) -> Column:
            more = F.get(row, k)
            return F.when((k == ID) | (more == ""), value).when(k == COUNT, F.when(value == "", more).otherwise(value)).when((k == NAME) & bare, joined_names(value, more)).otherwise(joined_once(value, more))

        return F.transform(done, cell)

    return F.aggregate(others, first, add)


def padded(cells: Column) -> Column:
    """The first 19 cells, cleaned; missing ones are empty."""
    return F.slice(F.concat(F.transform(cells, lambda c: text.cell_text(c)), F.array_repeat(F.lit(""), CELLS)), 1, CELLS)


def records(rows: DataFrame, unicode: bool = True) -> DataFrame:
    """page, record, id, cells: a code begins a record, rows without one or with the same one continue it.

    The first row with a note mark after a record has begun ends a page. A code whose last part stands in the name's
    cell is put together. Of the counts the first stays; other cells list what the rows add.
    """
    found = rows.select("page", "ord", padded(F.col("cells")).alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    code = text.equipment_code(F.col("cells")[ID], unicode)
    found = found.withColumn("code", F.when(text.looks_like_code(code), code).otherwise(""))
    split = (F.col("code") != "") & F.col("cells")[NAME].rlike(r"^-\d+$")
    found = found.withColumn("split", split).withColumn("code", F.when(F.col("split"), F.concat("code", F.col("cells")[NAME])).otherwise(F.col("code")))
    cells = F.transform("cells", lambda c, k: F.when((k == ID) & (F.col("code") != ""), F.col("code")).when((k == NAME) & F.col("split"), F.lit("")).otherwise(c))
    found = found.withColumn("cells", cells).drop("split")
    noted = (F.col("code") == "") & predicates.has_note_mark(F.col("cells"), NOTE_PHRASES)
    found = scan.assemble_records(found, ["page"], ["ord"], "code", noted)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ord", "cells"))), lambda x: x["cells"])
    found = found.groupBy("page", "record").agg(lines.alias("lines"))
    merged = _merged(F.get("lines", F.lit(0)), F.slice("lines", F.lit(2), F.size("lines")))
    return found.select("page", "record", merged.alias("cells")).withColumn("id", F.col("cells")[ID])


def four_columns(found: DataFrame, drawings: DataFrame | None = None) -> DataFrame:
    """page, record, id, name, power, count of records, and drawing_no by page, empty where a page has none."""
    own = found.select("page", "record", *(F.col("cells")[k].alias(c) for k, c in ((ID, "id"), (NAME, "name"), (POWER, "power"), (COUNT, "count"))))
    if drawings is None:
        return own
    return own.join(drawings.select("page", "drawing_no"), "page", "left").withColumn("drawing_no", F.coalesce("drawing_no", F.lit("")))


def header_match(cell: Column, unicode: bool = True) -> Column:
    return F.replace(text.compact(cell, unicode), F.lit("\n"), F.lit(""))


def header_blobs(rows: DataFrame, depth: Column, unicode: bool = True) -> DataFrame:
    """page, headers: of each column the cells of the first `depth` rows, run together. Rows need `r`, their number from 0."""
    cells = rows.filter(F.col("r") < depth).select("page", "r", F.posexplode("cells").alias("column", "cell"))
    blobs = cells.groupBy("page", "column").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", header_match(F.col("cell"), unicode).alias("t")))), lambda x: x["t"]), "").alias("blob"))
    return blobs.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("column", "blob"))), lambda x: x["blob"]).alias("headers"))


def header_column(headers: Column, words: tuple[str, ...], but: tuple[str, ...] = ()) -> Column:
    """Number of the first column whose header holds a word and none of `but`, or null."""
    hit = F.transform(headers, lambda h: predicates.contains_any(h, words) & ~predicates.contains_any(h, but))
    return F.nullif(F.array_position(hit, True).cast("int") - 1, F.lit(-1))


def power_column(headers: Column) -> Column:
    """Of the columns of consumed power, first those that don't name output too, the one with the shortest header."""
    own = F.filter(F.transform(headers, lambda h, k: F.struct(F.contains(h, F.lit("出力")).alias("broad"), F.length(h).alias("size"), k.alias("k"), h.alias("h"))), lambda x: F.contains(x["h"], F.lit("消費電力")))
    return F.array_min(F.transform(own, lambda x: F.struct(x["broad"], x["size"], x["k"])))["k"]


def _row_code(cells: Column, at: Column, unicode: bool) -> Column:
    """The code in a row's id cell, with a number from the next cell if it ends in a dash."""
    code = text.equipment_code(F.coalesce(F.get(cells, at), F.lit("")), unicode)
    tail = text.equipment_code(F.coalesce(F.get(cells, at + 1), F.lit("")), unicode)
    return F.when(F.endswith(code, F.lit("-")) & tail.rlike(r"^\d+$"), F.concat(code, tail)).otherwise(code)


def summary_rows(tables: DataFrame, unicode: bool = True) -> DataFrame:
    """page, ord, cells: the rows of summary tables, one table a page, in the 19 columns: id, name and total as count.

    The header reaches down to the first row with a code. The name takes the columns without a header after it, up
    to the specification. A page whose table lacks the id, name or total column has no rows.
    """
    order = Window.partitionBy("page").orderBy("ord")
    widest = F.max(F.size("cells")).over(Window.partitionBy("page"))
    rows = tables.select("page", "ord", F.transform("cells", text.cell_text).alias("cells"), (F.row_number().over(order) - 1).alias("r"), widest.alias("width"), F.count(F.lit(1)).over(Window.partitionBy("page")).alias("rows"))
    rows = rows.withColumn("cells", F.transform(F.sequence(F.lit(0), F.greatest("width", F.lit(1)) - 1), lambda k: F.coalesce(F.get("cells", k), F.lit(""))))
    ids = header_blobs(rows, F.lit(FIRST_ROWS), unicode).select("page", header_column(F.col("headers"), ID_WORDS).alias("id_at")).filter("id_at IS NOT NULL")
    rows = rows.join(ids, "page").withColumn("code", _row_code(F.col("cells"), F.col("id_at"), unicode))
    first = F.min(F.when((F.col("r") < HEADER_ROWS) & text.looks_like_code(F.col("code")), F.col("r"))).over(Window.partitionBy("page"))
    rows = rows.withColumn("depth", F.greatest(F.coalesce(first, F.least(F.lit(HEADER_ROWS), F.col("rows"))), F.lit(1)))
    heads = header_blobs(rows, F.col("depth"), unicode)
    heads = heads.select("page", "headers", *(header_column(F.col("headers"), w).alias(c) for c, w in (("name_at", NAME_WORDS), ("total_at", TOTAL_WORDS), ("spec_at", SPEC_WORDS)))).filter("name_at IS NOT NULL AND total_at IS NOT NULL")
    after = F.transform("headers", lambda h, k: F.when((k > F.col("name_at")) & ((h != "") | (k >= F.coalesce("spec_at", F.size("headers")))), k))
    heads = heads.withColumn("name_end", F.coalesce(F.array_min(after), F.size("headers")))
    rows = rows.join(heads, "page")
    name = summary_name(F.array_join(F.slice("cells", F.col("name_at") + 1, F.col("name_end") - F.col("name_at")), ""))
    own = {ID: F.col("code"), NAME: name, COUNT: F.coalesce(F.get("cells", F.col("total_at")), F.lit(""))}
    return rows.select("page", "ord", F.array(*(own.get(k, F.lit("")) for k in range(CELLS))).alias("cells"))


def power_score(current: Column, candidate: Column, unicode: bool = True) -> Column:
    """How well a candidate completes a cut power value; -1 without a digit or a value to complete."""
    a, b = header_match(current, unicode), header_match(candidate, unicode)
    head = lambda x: F.regexp_extract(x, r"^(\D*)", 1)
    kind = F.when(a == b, 100).when(F.startswith(b, a), F.length(b) + 80).when(F.startswith(a, b), F.length(b) + 40).otherwise(0)
    score = kind + F.when((head(a) != "") & (head(a) == head(b)), 20).otherwise(0) + F.contains(b, F.lit(".")).cast("int")
    return F.when((a == "") | ~b.rlike(r"\d"), -1).otherwise(score)


def best_power(current: Column, candidates: Column, unicode: bool = False) -> Column:
    """The first candidate of the highest score above 0, else the value as it is. NFKC is left to the caller."""
    scored = F.transform(candidates, lambda c, k: F.struct((-power_score(current, c, unicode)).alias("s"), k.alias("k"), c.alias("c")))
    best = F.array_min(F.filter(scored, lambda x: x["s"] < 0))
    return F.coalesce(best["c"], current)


def drawing_by_page(lines: DataFrame, words: DataFrame, unicode: bool = True) -> DataFrame:
    """page, drawing_no, source: the first code of the first labelled line that has one, else the first word in the page's corner that is one.

    lines: page, ord, text; words: page, ord, text, x0, y0, width, height (of the page).
    """
    labelled = lines.filter(predicates.is_drawing_label(text.compact(F.col("text"), unicode))).withColumn("code", F.get(extract.drawing_codes(F.col("text"), unicode), F.lit(0))).filter("code IS NOT NULL")
    by_line = labelled.groupBy("page").agg(F.min_by("code", "ord").alias("by_line"))
    corner = words.filter((F.col("x0") >= F.col("width") * CORNER) & (F.col("y0") >= F.col("height") * CORNER)).withColumn("code", text.drawing_code(F.col("text"), unicode)).filter("code IS NOT NULL")
    by_word = corner.groupBy("page").agg(F.min_by("code", "ord").alias("by_word"))
    both = by_line.join(by_word, "page", "full_outer")
    return both.select("page", F.coalesce("by_line", "by_word").alias("drawing_no"), F.when(F.col("by_line").isNotNull(), "line").otherwise("corner").alias("source"))


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both sides paired by their place in a key; a key whose sides differ in length raises an error when it is read."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    a, b = left.withColumn("_place", number), right.withColumn("_place", number).drop(order)
    marked = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*keys, "_place"], "full_outer")
    whole = F.assert_true(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit("both sides need as many rows in each key")).isNull()
    return marked.filter(whole).drop("_place", "_a", "_b")
