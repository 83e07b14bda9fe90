"""Keyed three-valued reconciliation of a declared table with an observed one.

declared: ord, id, name, capacity_text, qty, drawing_no. observed: ord, id, name, voltage, capacity_text, drawing_no.
ord is any orderable value and decides what comes first. Observed rows are counted by distinct text before
they are gathered by key, so a key with many rows shuffles one row for each distinct text and task.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import THOUSANDS, WHITE, compare_key, format_12g, is_blank, join_key, normal, parse_number, without_spaces

MATCH, MISMATCH, REVIEW = 0, 1, 2
#: Two capacities agree if they differ by no more, in double arithmetic.
TOLERANCE = 0.1
TIE = 1e-9
#: Modes, the name words that hint at them, marks, reasons.
MODES = ("冷", "暖", "低温")
HINTS = {"冷": "冷房専用", "暖": "暖房専用", "低温": "低温専用"}
MODE_VALUE = r"\((冷|暖|低温)\)\s*([+-]?\d+(?:,\d{3})*(?:\.\d+)?)"
MARKS = ("◯", "✗", "要確認")
ABSENT, NO_QTY, NO_CAPACITY, MANY_CAPACITIES, TEXT_CAPACITY, NO_NAME, OTHER_NAME, UNDECLARED, NO_ID = "電気図に記載なし", "台数が不明", "容量欠損", "容量が複数候補", "容量が数値でない", "名称が不明", "名称不一致", "機械図に記載なし", "電気図ID未記載"
QTY_GAP, QTY_DIFF, CAPACITY_DIFF = "台数差分=欠損", "台数差分=", "容量差分="
OPEN_MODE, SINGLE_MODE = "未確定", "単一値"

#: Output columns and the labels that the display sink gives them.
DISPLAY = {
    "overall": "総合判定", "qty_code": "台数判定", "capacity_code": "容量判定", "name_code": "名称判定", "id_match": "機器ID照合", "reason": "判定理由", "id": "機器ID",
    "declared_name": "機械図 記載名", "observed_names": "電気図 記載名", "declared_qty": "機械図 台数", "observed_qty": "電気図 台数", "qty_diff": "台数差",
    "declared_capacity": "機械図 消費電力(kW)", "mode_values": "機械図 モード容量(kW)", "selected_mode": "機械図 判定モード", "selected_capacity": "機械図 判定採用容量(kW)",
    "capacity_note": "容量判定補足", "observed_capacity": "電気図 容量(kW)", "capacity_diff": "容量差(kW)", "declared_drawing": "機械図 図面番号", "observed_drawing": "電気図 図面番号", "trace": "電気図 記載トレース",
}


def mark(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MARKS)), code + 1)


def classify_capacity(text: Column, unicode: bool = True) -> Column:
    """struct(kind, value, display): blank, multi (a comma that parts no thousands), numeric or text."""
    shown = normal(text, unicode)
    value = parse_number(text, unicode)
    kind = F.when(is_blank(shown), "blank").when(F.contains(shown, F.lit(",")) & ~shown.rlike(THOUSANDS), "multi").when(value.isNotNull(), "numeric").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind == "numeric", value).alias("value"), F.when(kind == "numeric", format_12g(value)).when(kind == "blank", "").otherwise(shown).alias("display"))


def mode_capacities(text: Column, unicode: bool = True) -> Column:
    """array of struct(mode, value) in the fixed order of modes; of a mode named twice the last value counts."""
    shown = normal(text, unicode)
    found = F.arrays_zip(F.regexp_extract_all(shown, F.lit(MODE_VALUE), 1).alias("mode"), F.regexp_extract_all(shown, F.lit(MODE_VALUE), 2).alias("number"))

    def last(mode: str) -> Column:
        own = F.filter(found, lambda x: x["mode"] == mode)
        return F.when(F.size(own) > 0, F.struct(F.lit(mode).alias("mode"), F.replace(F.element_at(own, -1)["number"], F.lit(","), F.lit("")).cast("double").alias("value")))

    return F.array_compact(F.array(*map(last, MODES)))


def resolve_capacity(frame: DataFrame, text: str, name: str, strict: bool = False, unicode: bool = True) -> DataFrame:
    """frame and `capacity`: struct(display, mode_values, mode, kind, value, shown, note, rule), what a declared capacity amounts to."""
    frame = frame.withColumn("_text", normal(F.col(text), unicode)).withColumn("_name", normal(F.col(name), unicode))
    frame = frame.withColumn("_class", classify_capacity(F.col("_text"), False)).withColumn("_modes", mode_capacities(F.col("_text"), False))
    kind, modes = F.col("_class.kind"), F.col("_modes")
    hinted = F.array_compact(F.array(*(F.when(F.contains(F.col("_name"), F.lit(word)), F.struct(F.lit(m).alias("mode"), F.lit(word).alias("word"))) for m, word in HINTS.items())))
    frame = frame.withColumn("_hints", hinted).withColumn("_best", F.array_max(F.transform(modes, lambda x: x["value"])))
    hints = F.col("_hints")
    one_hint = F.when(F.size(hints) == 1, hints[0])
    by_hint = F.filter(modes, lambda x: x["mode"] == F.when(F.size(F.col("_hints")) == 1, F.col("_hints")[0]["mode"]))
    tops = F.filter(modes, lambda x: F.abs(x["value"] - F.col("_best")) <= TIE)
    frame = frame.withColumn("_by_hint", by_hint).withColumn("_tops", tops)
    by_hint, tops = F.col("_by_hint"), F.col("_tops")

    def found(rule: str, mode: Column | str, value: Column | None, note: Column | str) -> Column:
        mode, note = (F.lit(x) if isinstance(x, str) else x for x in (mode, note))
        value, own = (F.col("_class.value"), kind) if value is None else (value, F.lit("numeric"))
        return F.struct(F.lit(rule).alias("rule"), mode.alias("mode"), own.alias("kind"), value.alias("value"), note.alias("note"))

    words = F.array_join(F.transform(hints, lambda x: x["word"]), ",")
    picked = (
        F.when(kind == "blank", found("BLANK", "", None, ""))
        .when(kind == "numeric", found("SINGLE_NUMERIC", SINGLE_MODE, None, "単一数値を採用"))
        .when(kind == "multi", found("MULTI_CANDIDATE_COMMA", OPEN_MODE, None, "カンマ区切りの複数候補"))
        .when(F.size(modes) == 0, found("NON_NUMERIC_TEXT", OPEN_MODE, None, "数値化できない表記"))
        .when(F.size(modes) == 1, found("MODE_SINGLE_CANDIDATE", F.get(modes, F.lit(0))["mode"], F.get(modes, F.lit(0))["value"], F.concat(F.lit("モード容量1候補のため("), F.get(modes, F.lit(0))["mode"], F.lit(")を採用"))))
        .when(F.size(by_hint) > 0, found("MODE_BY_NAME_HINT", F.get(by_hint, F.lit(0))["mode"], F.get(by_hint, F.lit(0))["value"], F.concat(F.lit("機器名称ヒント("), one_hint["word"], F.lit(")で("), F.get(by_hint, F.lit(0))["mode"], F.lit(")を採用"))))
        .when(F.size(hints) > 1, found("MODE_HINT_AMBIGUOUS", OPEN_MODE, None, F.concat(F.lit("機器名称ヒントが複数("), words, F.lit(")でモード未確定"))))
    )
    if strict:
        picked = picked.otherwise(found("MODE_UNKNOWN_STRICT", OPEN_MODE, None, "機器名称からモード特定不可(strict設定)"))
    else:
        tied = F.concat(F.lit("機器名称からモード特定不可かつ最大値が複数("), F.array_join(F.transform(tops, lambda x: x["mode"]), ","), F.lit(")"))
        top = F.get(tops, F.lit(0))
        picked = picked.when(F.size(tops) == 1, found("MODE_BY_MAX_FALLBACK", F.concat(F.lit("最大値("), top["mode"], F.lit(")")), F.col("_best"), "機器名称からモード特定不可のため最大値を採用")).otherwise(found("MODE_MAX_TIE_UNRESOLVED", OPEN_MODE, None, tied))
    shown = F.array_join(F.transform(modes, lambda x: F.concat(x["mode"], F.lit("="), format_12g(x["value"]))), ",")
    frame = frame.withColumn("_picked", picked)
    p = F.col("_picked")
    whole = F.struct(F.col("_text").alias("display"), shown.alias("mode_values"), p["mode"].alias("mode"), p["kind"].alias("kind"), p["value"].alias("value"), F.when(p["kind"] == "numeric", format_12g(p["value"])).otherwise("").alias("shown"), p["note"].alias("note"), p["rule"].alias("rule"))
    return frame.withColumn("capacity", whole).drop("_text", "_name", "_class", "_modes", "_hints", "_best", "_by_hint", "_tops", "_picked")


def _clean_observed(observed: DataFrame, unicode: bool) -> DataFrame:
    text = lambda c: normal(F.col(c).cast("string"), unicode)
    return observed.select("ord", join_key(F.col("id").cast("string"), unicode).alias("key"), text("id").alias("raw_id"), text("drawing_no").alias("drawing"), text("name").alias("name"), text("capacity_text").alias("capacity"), text("voltage").alias("voltage"), (F.col("times") if "times" in observed.columns else F.lit(1)).cast("long").alias("times"))


def observed_groups(observed: DataFrame, unicode: bool = True) -> DataFrame:
    """One row for each key, and for each different content among rows without a key that say something.

    A column `times`, if observed has one, says for how many rows each stands.

    key, print (null where there is a key), n, first (the least ord), shown_id, names, drawings, variants, capacity (the
    first row's), trace. Rows are counted by distinct text first, and a list's items are thinned to the first of each
    value before they are gathered, so a key with many rows never gathers more than its different texts.
    """
    rows = _clean_observed(observed, unicode).filter("key IS NOT NULL OR concat(name, voltage, capacity, drawing) <> ''")
    content = F.concat_ws("\u0001", *(compare_key(F.col(c), False) for c in ("name", "voltage", "capacity", "drawing")))
    rows = rows.withColumn("print", F.when(F.col("key").isNull(), content))
    same = ["key", "print"]
    rows = rows.groupBy(*same, "drawing", "name", "capacity").agg(F.min("ord").alias("first"), F.min_by("raw_id", "ord").alias("id"), F.sum("times").alias("times"))
    rows = rows.withColumn("variant", classify_capacity(F.col("capacity"), False))
    values = {"name": compare_key(F.col("name"), False), "drawing": compare_key(F.col("drawing"), False), "variant": F.when(F.col("variant.kind") != "blank", F.concat_ws("|", "variant.kind", "variant.display")).otherwise("")}
    place = F.struct("first", "drawing", "name", "capacity")
    for c, value in values.items():
        rows = rows.withColumn(f"{c}_key", value)
        rows = rows.withColumn(f"{c}_new", (F.col(f"{c}_key") != "") & (F.row_number().over(Window.partitionBy(*same, f"{c}_key").orderBy("first", "drawing", "name", "capacity")) == 1))

    def listed(c: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col(f"{c}_new"), F.struct(place.alias("at"), F.col(c).alias("shown"))))), lambda x: x["shown"])

    part = lambda c: F.when(c == "", "?").otherwise(c)
    line = lambda x: F.concat(F.lit("図面:"), part(x["drawing"]), F.lit(" 名称:"), part(x["name"]), F.lit(" 容量:"), part(x["capacity"]), F.when(x["times"] > 1, F.concat(F.lit(" x"), x["times"].cast("string"))).otherwise(""))
    items = F.sort_array(F.collect_list(F.struct("first", "drawing", "name", "capacity", "times")))
    groups = rows.groupBy(*same).agg(
        F.sum("times").alias("n"), F.min("first").alias("first"), F.min_by("id", "first").alias("shown_id"), F.min_by("capacity", place).alias("capacity"),
        listed("name").alias("names"), listed("drawing").alias("drawings"), listed("variant").alias("variants"), items.alias("items"),
    )
    trace = F.when(F.size("items") > 1, F.array_join(F.transform("items", line), " || ")).otherwise("")
    return groups.withColumn("trace", trace).drop("items")


def observed_by_key(observed: DataFrame, unicode: bool = True) -> DataFrame:
    """The groups of observed_groups that have a key."""
    return observed_groups(observed, unicode).filter("key IS NOT NULL")


def judge_quantity(declared_qty: Column, n: Column) -> tuple[Column, Column]:
    """Code and difference: absent differs, an unknown declared quantity is for review, else equality."""
    diff = F.coalesce(n, F.lit(0)).cast("double") - declared_qty
    return F.when(n.isNull(), MISMATCH).when(declared_qty.isNull(), REVIEW).when(diff == 0, MATCH).otherwise(MISMATCH), diff


def judge_capacity(kind: Column, value: Column, variants: Column, n: Column) -> tuple[Column, Column, Column]:
    """Code, difference and reason of a declared capacity against the observed variants."""
    first = F.get(variants, F.lit(0))
    several = F.exists(variants, lambda v: v["kind"] == "multi") | (F.size(variants) > 1)
    reason = (
        F.when(n.isNull(), ABSENT)
        .when((kind == "blank") | (F.size(variants) == 0), NO_CAPACITY)
        .when(kind == "multi", MANY_CAPACITIES)
        .when(kind == "text", TEXT_CAPACITY)
        .when(several, MANY_CAPACITIES)
        .when(first["kind"] == "text", TEXT_CAPACITY)
    )
    diff = F.when(reason.isNull(), first["value"] - value)
    code = F.when(n.isNull(), MISMATCH).when(reason.isNotNull(), REVIEW).when(F.abs(diff) <= F.lit(TOLERANCE), MATCH).otherwise(MISMATCH)
    return code, diff, F.coalesce(reason, F.when(code == MISMATCH, F.concat(F.lit(CAPACITY_DIFF), format_12g(diff))), F.lit(""))


def judge_name(name: Column, names: Column, n: Column) -> Column:
    """Code of a declared name: two or more observed names differ even if one is equal."""
    same = F.lower(name) == compare_key(F.get(names, F.lit(0)), False)
    return F.when(n.isNull(), MISMATCH).when((name == "") | (F.size(names) == 0), REVIEW).when((F.size(names) == 1) & same, MATCH).otherwise(MISMATCH)


def _declared(declared: DataFrame, strict: bool, unicode: bool) -> DataFrame:
    """Declared rows with their key, resolved capacity and the drawings of their key."""
    text = lambda c: normal(F.col(c).cast("string"), unicode)
    own = declared.select(F.col("ord").alias("declared_ord"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), join_key(F.col("id").cast("string"), unicode).alias("own_key"), text("name").alias("name"), F.col("capacity_text").cast("string").alias("capacity_text"), parse_number(F.col("qty").cast("string"), unicode).alias("qty"), text("drawing_no").alias("drawing"))
    drawings = own.filter("own_key IS NOT NULL AND drawing <> ''").groupBy("own_key", compare_key(F.col("drawing"), False).alias("d")).agg(F.min(F.struct("declared_ord", "drawing")).alias("first"))
    drawings = drawings.groupBy("own_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["drawing"]), ",").alias("declared_drawing"))
    return resolve_capacity(own, "capacity_text", "name", strict, unicode).join(drawings, "own_key", "left").withColumn("is_declared", F.lit(True))


def _judged(frame: DataFrame) -> DataFrame:
    """The output columns of declared rows joined with their groups, and of groups that no declared row has (is_declared null)."""
    n, mine = F.col("n"), F.coalesce("is_declared", F.lit(False))
    names = F.coalesce("names", F.array().cast("array<string>"))
    variants = F.coalesce("variants", F.array().cast("array<struct<kind:string,value:double,display:string>>"))
    frame = frame.withColumn("declared_name", without_spaces(F.col("name"))).withColumn("names", names).withColumn("variants", variants)
    qty_code, qty_diff = judge_quantity(F.col("qty"), n)
    code, diff, why = judge_capacity(F.col("picked.kind"), F.col("picked.value"), F.col("variants"), n)
    frame = frame.withColumn("q", qty_code).withColumn("qty_gap", qty_diff).withColumn("c", code).withColumn("c_gap", diff).withColumn("c_why", why)
    frame = frame.withColumn("m", judge_name(F.col("declared_name"), F.col("names"), n)).withColumn("o", F.greatest("q", "c", "m"))
    to_review = F.coalesce(F.when(F.col("q") == REVIEW, QTY_GAP), F.when(F.col("c") == REVIEW, F.col("c_why")), F.when(F.col("m") == REVIEW, NO_NAME))
    differs = F.coalesce(
        F.when(n.isNull(), ABSENT), F.when(F.col("q") == MISMATCH, F.concat(F.lit(QTY_DIFF), format_12g(F.col("qty_gap")))), F.when(F.col("c") == MISMATCH, F.col("c_why")), F.when(F.col("m") == MISMATCH, OTHER_NAME)
    )
    reason = F.when(F.col("o") == MATCH, "").when(F.col("o") == REVIEW, F.coalesce(to_review, differs)).otherwise(F.coalesce(differs, to_review))
    keyed = F.col("key").isNotNull()
    other = F.when(keyed, MARKS[MISMATCH]).otherwise(MARKS[REVIEW])
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    gathered = lambda c: F.when(mine | keyed, F.array_join(c, ",")).otherwise(first(F.col(c)))
    capacities = F.array_join(F.transform("variants", lambda v: v["display"]), ",")
    own = {  # column: value of a declared row, value of another row
        "overall": (mark(F.col("o")), other), "qty_code": (mark(F.col("q")), other), "capacity_code": (mark(F.col("c")), other), "name_code": (mark(F.col("m")), other),
        "id_match": (F.when(F.col("o") == REVIEW, MARKS[REVIEW]).when(n.isNull(), MARKS[MISMATCH]).otherwise(MARKS[MATCH]), other),
        "reason": (reason, F.when(keyed, UNDECLARED).otherwise(NO_ID)), "id": (F.col("id"), F.when(keyed, F.col("shown_id")).otherwise("")),
        "observed_names": (gathered("names"),) * 2, "observed_qty": (F.coalesce(n, F.lit(0)).cast("string"),) * 2, "observed_capacity": (capacities, F.when(keyed, capacities).otherwise(F.col("capacity"))),
        "observed_drawing": (F.coalesce(gathered("drawings"), F.lit("")),) * 2, "trace": (F.coalesce("trace", F.lit("")),) * 2,
        "declared_name": (F.col("declared_name"), F.lit("")), "declared_qty": (format_12g(F.col("qty")), F.lit("")), "qty_diff": (format_12g(F.col("qty_gap")), F.lit("")), "capacity_diff": (format_12g(F.col("c_gap")), F.lit("")),
        "declared_drawing": (F.coalesce("declared_drawing", F.lit("")), F.lit("")), "declared_capacity": (F.col("picked.display"), F.lit("")), "mode_values": (F.col("picked.mode_values"), F.lit("")),
        "selected_mode": (F.col("picked.mode"), F.lit("")), "selected_capacity": (F.col("picked.shown"), F.lit("")), "capacity_note": (F.col("picked.note"), F.lit("")),
    }
    segment = F.when(mine, 0).when(keyed, 1).otherwise(2)
    return frame.select(segment.alias("segment"), "ord", *(F.when(mine, own[c][0]).otherwise(own[c][1]).alias(c) for c in DISPLAY))


def _ord(column: str, as_text: bool) -> Column:
    return F.to_json(F.struct(F.col(column).alias("ord"))) if as_text else F.col(column)


def declared_rows(declared: DataFrame, gathered: DataFrame, strict: bool = False, unicode: bool = True) -> DataFrame:
    """Every declared row, duplicates kept, with its judgements, ord and segment 0. gathered: observed_by_key."""
    own = _declared(declared, strict, unicode).withColumnRenamed("capacity", "picked")
    return _judged(own.join(gathered, F.col("own_key") == F.col("key"), "left").withColumn("ord", F.col("declared_ord")))


def _undeclared(groups: DataFrame) -> DataFrame:
    """The output columns of groups that no declared row has."""
    none = {"declared_ord": "string", "id": "string", "name": "string", "qty": "double", "declared_drawing": "string", "is_declared": "boolean", "picked": "struct<display:string,mode_values:string,mode:string,kind:string,value:double,shown:string,note:string>"}
    return _judged(groups.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"ord": F.col("first")}))


def observed_only_rows(declared: DataFrame, gathered: DataFrame, unicode: bool = True) -> DataFrame:
    """Keys that no declared row has, segment 1; the id shown is the first one written. gathered: observed_by_key."""
    keys = declared.select(join_key(F.col("id").cast("string"), unicode).alias("key")).filter("key IS NOT NULL").distinct()
    return _undeclared(gathered.join(keys, "key", "left_anti"))


def missing_id_rows(observed: DataFrame, unicode: bool = True) -> DataFrame:
    """Observed rows without an id, grouped by all they say, segment 2; wholly blank rows are dropped."""
    return _undeclared(observed_groups(observed, unicode).filter("key IS NULL"))


def reconcile(declared: DataFrame, observed: DataFrame, strict: bool = False, unicode: bool = True) -> DataFrame:
    """All three segments: segment, ord and the columns of DISPLAY. Order by segment and ord to show them.

    One outer join gives all of them: what has no declared row is segment 1, or 2 without a key. Rows and groups
    without a key join with nothing; a hash in place of their key spreads them.
    """
    as_text = declared.schema["ord"].dataType != observed.schema["ord"].dataType
    own, groups = _declared(declared, strict, unicode).withColumnRenamed("capacity", "picked"), observed_groups(observed, unicode)
    spread = lambda key, side, row: F.coalesce(F.col(key), F.concat(F.lit(f"\u0000{side}"), F.xxhash64(row).cast("string")))
    own, groups = own.withColumn("_at", spread("own_key", "d", "declared_ord")), groups.withColumn("_on", spread("key", "o", "print"))
    both = own.join(groups, F.col("_at") == F.col("_on"), "full_outer")
    return _judged(both.withColumn("ord", F.coalesce(_ord("declared_ord", as_text), _ord("first", as_text)) if not as_text else F.when(F.col("is_declared"), _ord("declared_ord", True)).otherwise(_ord("first", True))))


#: Spellings of the judgements in older tables, and of the ids' judgement where it is shown.
JUDGEMENTS = {"◯": ("一致", "○", "◯", "match"), "✗": ("不一致", "×", "✗", "mismatch"), "要確認": ("判定不可", "要確認", "review")}
ID_MARKS = {"◯": "○", "✗": "×"}
#: Shown column: the columns that it comes from, in order of priority.
SUMMARY_COLUMNS = {
    "総合判定": ("総合判定", "照合結果", "総合判定(◯/✗)", "総合判定(○/×)"),
    "機器ID照合": ("機器ID照合",),
    "判定理由": ("判定理由", "不一致内容", "確認理由", "不一致理由"),
    "機器ID": ("機器ID", "機器番号", "機械番号"),
    "電気図 台数": ("電気図 台数", "raster_match_count", "raster_台数_calc"),
    "電気図 記載名": ("電気図 記載名", "電気図記載名"),
    "電気図 容量(kW)": ("電気図 容量(kW)", "電気図 容量合計(kW)", "raster_容量(kW)_sum"),
    "電気図 図面番号": ("電気図 図面番号", "図面番号", "図番"),
    "電気図 記載トレース": ("電気図 記載トレース",),
}
CUSTOMER_COLUMNS = {
    "機器ID": ("機器ID", "機器番号", "機械番号"),
    "ID照合": ("機器ID照合",),
    "図面番号_電気図": ("電気図 図面番号", "図面番号", "図番"),
    "図面番号_機械図": ("機械図 図面番号", "機械図図面番号"),
    "容量_電気図": ("電気図 容量(kW)", "電気図 容量合計(kW)", "raster_容量(kW)_sum"),
    "容量_機械図": ("機械図 判定採用容量(kW)", "機械図 消費電力(kW)", "機械図 容量合計(kW)", "vector_容量(kW)_calc"),
    "容量_差分": ("容量差(kW)", "容量差分(kW)"),
    "台数_電気図": ("電気図 台数", "raster_match_count", "raster_台数_calc"),
    "台数_機械図": ("機械図 台数", "台数", "vector_台数_numeric"),
    "台数_差分": ("台数差", "台数差（電気図-機械図）", "台数差分"),
}


def judgement(text: Column) -> Column:
    """A judgement's mark, whichever way it is spelt; other texts stripped."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WHITE))
    found = bare
    for shown, spellings in JUDGEMENTS.items():
        found = F.when(bare.isin(*spellings), F.lit(shown)).otherwise(found)
    return found


def id_mark(text: Column) -> Column:
    """The mark shown for an id's judgement."""
    own = judgement(text)
    return F.when(own == MARKS[MATCH], ID_MARKS[MARKS[MATCH]]).when(own == MARKS[MISMATCH], ID_MARKS[MARKS[MISMATCH]]).otherwise(own)


def _picked_columns(frame: DataFrame, columns: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """The value of the first column that the table has and that isn't null: by name, then by name without blanks and width."""
    plain = lambda x: unicodedata.normalize("NFKC", x).replace(" ", "").replace("　", "")
    known = {plain(c): c for c in frame.columns}
    found = {}
    for shown, names in columns.items():
        own = [n for n in names if n in frame.columns] + [known[plain(n)] for n in names if plain(n) in known]
        found[shown] = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in own), F.lit(""))
    return found


def customer_rows(frame: DataFrame) -> DataFrame:
    """The nine columns that the counts look at, of a table labelled as by `display` or in an older way."""
    own = _picked_columns(frame, SUMMARY_COLUMNS)
    return frame.select(*((judgement(v) if c in ("総合判定", "機器ID照合") else v).alias(c) for c, v in own.items()))


def customer_display(frame: DataFrame) -> DataFrame:
    """The ten columns that customers see, of a table labelled as by `display` or in an older way."""
    own = _picked_columns(frame, CUSTOMER_COLUMNS)
    return frame.select(*((id_mark(v) if c == "ID照合" else v).alias(c) for c, v in own.items()))


def customer_summary(rows: DataFrame, n_declared: int | None = None, n_observed: int | None = None) -> DataFrame:
    """One row of five counts of customer_rows: declared, observed, ids that match, rows that differ, rows for review.

    n_declared and n_observed, where given, stand for the first two, 0 at least.
    """
    full = lambda c: F.btrim(F.col(f"`{c}`"), F.lit(WHITE)) != ""
    said = full("電気図 記載名") | full("電気図 容量(kW)") | full("電気図 図面番号") | full("電気図 記載トレース")
    own = full("機器ID") & (F.btrim("判定理由", F.lit(WHITE)) != UNDECLARED)
    seen = said | (F.coalesce(parse_number(F.col("`電気図 台数`"), False), F.lit(0.0)) > 0)
    count = lambda given, test: F.count_if(test) if given is None else F.lit(max(0, given)).cast("long")
    return rows.agg(
        count(n_declared, own).alias("機械図記載"), count(n_observed, seen).alias("電気図記載"), F.count_if(F.col("機器ID照合") == MARKS[MATCH]).alias("ID照合一致"),
        F.count_if(F.col("総合判定") == MARKS[MISMATCH]).alias("不一致"), F.count_if(F.col("総合判定") == MARKS[REVIEW]).alias("要確認"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Counts of rows by overall judgement, of ids found, and of all rows."""
    o = F.col("overall")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(o == m).alias(n) for m, n in zip(MARKS, ("n_match", "n_mismatch", "n_review"))), F.count_if(F.col("id_match") == MARKS[MATCH]).alias("n_id_match"))


def display(rows: DataFrame) -> DataFrame:
    """The 22 labelled columns, in order."""
    return rows.orderBy("segment", "ord").select(*(F.col(c).alias(label) for c, label in DISPLAY.items()))


def resolve_headers(columns: list[str], aliases: dict[str, list[str]], required: set[str]) -> dict[str, str]:
    """Role -> column: the first alias that a column has, blanks, width and case apart; of equal columns the last."""
    plain = lambda x: unicodedata.normalize("NFKC", x).replace(" ", "").replace("　", "").lower()
    known = {plain(c): c for c in columns}
    found = {role: hit for role, names in aliases.items() if (hit := next((known[plain(a)] for a in names if plain(a) in known), None))}
    if missing := required - set(found):
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    return found


#: Column names by role, in order of priority.
DECLARED_ALIASES = {
    "id": ["機器番号", "機械番号"],
    "name": ["名称", "機器名称"],
    "capacity_text": ["動力 (50Hz)_消費電力 (KW)", "動力(50Hz)_消費電力(KW)", "動力(50Hz)_消費電力(Kw)", "動力 (50Hz)_消費電力 (Kw)"],
    "qty": ["台数"],
    "drawing_no": ["図面番号", "図番", "機械図 図面番号"],
}
OBSERVED_ALIASES = {
    "id": ["機器番号", "機械番号"],
    "name": ["機器名称", "名称"],
    "voltage": ["電圧(V)", "電圧（V）"],
    "capacity_text": ["容量(kW)", "容量(KW)", "容量(Kw)", "容量（kW）"],
    "drawing_no": ["図面番号", "電気図 図面番号"],
}


def by_roles(frame: DataFrame, aliases: dict[str, list[str]], required: set[str], ord: str = "ord") -> DataFrame:
    """ord and one column for each role; an optional role that the table lacks is empty."""
    found = resolve_headers([c for c in frame.columns if c != ord], aliases, required)
    return frame.select(ord, *((F.col(f"`{found[r]}`") if r in found else F.lit("")).alias(r) for r in aliases))
