"""Registered queries of the engine's own operators, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import predicates, text
from tessera.operators import area, cluster, extract, reconcile, scan, spatial
from tessera.plans import fixtures, frames, layout, raster, vector
from tessera.plans.adapters import CAPACITY, NAME, ORDER, QTY, boxes, declared, observed
from tessera.sources import nested, sheets, tables
from tessera.sources.scratch import shared_folder
from tessera.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its DuckDB SQL."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- reconciliation ---------------------------------------------------------------------------------------------

_ORD = ", ".join(ORDER)
_NUMBER = text.NUMBER.replace("'", "''")


def _duck_12g(x: str) -> str:
    return f"coalesce(printf('%.12g', {x}), '')"


_WITH = f"""
WITH lines AS (
  SELECT row_number() OVER (ORDER BY {_ORD}) AS o, CASE WHEN l_tax <> 0.08 THEN CAST(l_orderkey AS VARCHAR) END AS k, l_returnflag AS name, l_quantity AS q, CAST(l_quantity AS VARCHAR) AS capacity, l_linestatus AS drawing, l_orderkey
  FROM lineitem WHERE l_quantity > 40
), firsts AS (
  SELECT k, arg_min(q, o) AS first_quantity, arg_min(name, o) AS first_flag FROM lines WHERE k IS NOT NULL GROUP BY k
), dec AS (
  SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS id, {NAME} AS raw_name, {CAPACITY} AS cap, {QTY} AS raw_qty
  FROM orders LEFT JOIN firsts ON k = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus <> 'P'
), triples AS (
  SELECT k, name, q, capacity, drawing, count(*) AS times, min(o) AS first FROM lines WHERE k IS NOT NULL GROUP BY ALL
), names AS (
  SELECT k, string_agg(name, ',' ORDER BY first) AS observed_names, count(*) AS n_names FROM (SELECT k, name, min(first) AS first FROM triples GROUP BY ALL) GROUP BY k
), drawings AS (
  SELECT k, string_agg(drawing, ',' ORDER BY first) AS observed_drawing FROM (SELECT k, drawing, min(first) AS first FROM triples GROUP BY ALL) GROUP BY k
), caps AS (
  SELECT k, string_agg({_duck_12g('q')}, ',' ORDER BY first) AS observed_capacity, count(*) AS n_caps, min(q) AS cap_value FROM (SELECT k, q, min(first) AS first FROM triples GROUP BY ALL) GROUP BY k
), obs AS (
  SELECT k, sum(times)::BIGINT AS n, min(first) AS first,
         CASE WHEN count(*) > 1 THEN string_agg('図面:' || drawing || ' 名称:' || name || ' 容量:' || capacity || CASE WHEN times > 1 THEN ' x' || times ELSE '' END, ' || ' ORDER BY first) ELSE '' END AS trace
  FROM triples GROUP BY k
), gathered AS (
  SELECT * FROM obs JOIN names USING (k) JOIN drawings USING (k) JOIN caps USING (k)
), kinds AS (
  SELECT *, trim(raw_name) AS name, replace(trim(raw_name), ' ', '') AS declared_name, try_cast(nullif(raw_qty, '-') AS DOUBLE) AS qty,
         CASE WHEN cap = '' THEN 'blank' WHEN contains(cap, ',') THEN 'multi' WHEN regexp_matches(cap, '{_NUMBER}') THEN 'numeric' ELSE 'text' END AS kind,
         CASE WHEN cap = '(冷)9.45 / (暖)7.18' THEN '冷=9.45,暖=7.18' WHEN cap = '(冷)5 (暖)5 (低温)1' THEN '冷=5,暖=5,低温=1' WHEN cap = '(暖)41' THEN '暖=41' ELSE '' END AS mode_values
  FROM dec
), resolved AS (
  SELECT *, CASE WHEN kind = 'numeric' THEN cast(cap AS DOUBLE) WHEN mode_values = '暖=41' THEN 41.0 WHEN mode_values = '冷=9.45,暖=7.18' THEN CASE WHEN contains(name, '冷房専用') THEN 9.45 ELSE STRICT_NULL(9.45) END WHEN mode_values = '冷=5,暖=5,低温=1' AND contains(name, '冷房専用') THEN 5.0 END AS value,
         CASE WHEN kind = 'blank' THEN '' WHEN kind = 'numeric' THEN '単一値' WHEN kind = 'multi' OR mode_values = '' THEN '未確定' WHEN mode_values = '暖=41' THEN '暖' WHEN contains(name, '冷房専用') THEN '冷' WHEN mode_values LIKE '冷=9%' THEN 'STRICT_MODE' ELSE '未確定' END AS selected_mode,
         CASE WHEN kind = 'blank' THEN '' WHEN kind = 'numeric' THEN '単一数値を採用' WHEN kind = 'multi' THEN 'カンマ区切りの複数候補' WHEN mode_values = '' THEN '数値化できない表記' WHEN mode_values = '暖=41' THEN 'モード容量1候補のため(暖)を採用'
              WHEN contains(name, '冷房専用') THEN '機器名称ヒント(冷房専用)で(冷)を採用' WHEN mode_values LIKE '冷=9%' THEN 'STRICT_NOTE' ELSE 'STRICT_TIE' END AS capacity_note
  FROM kinds
), judged AS (
  SELECT r.*, g.*, CASE WHEN value IS NOT NULL THEN 'numeric' ELSE kind END AS own_kind, coalesce(n, 0) - qty AS qty_gap,
         CASE WHEN n IS NULL THEN 1 WHEN qty IS NULL THEN 2 WHEN n = qty THEN 0 ELSE 1 END AS q,
         CASE WHEN n IS NULL THEN '電気図に記載なし' WHEN kind = 'blank' THEN '容量欠損' WHEN kind = 'multi' THEN '容量が複数候補' WHEN value IS NULL THEN '容量が数値でない' WHEN n_caps > 1 THEN '容量が複数候補' END AS c_why,
         CASE WHEN n IS NULL THEN 1 WHEN declared_name = '' THEN 2 WHEN n_names = 1 AND lower(declared_name) = lower(observed_names) THEN 0 ELSE 1 END AS m
  FROM resolved r LEFT JOIN gathered g ON g.k = r.id
), coded AS (
  SELECT *, CASE WHEN n IS NULL THEN 1 WHEN c_why IS NOT NULL THEN 2 WHEN abs(cap_value - value) <= 0.1 THEN 0 ELSE 1 END AS c, CASE WHEN c_why IS NULL THEN cap_value - value END AS c_gap FROM judged
), overall AS (
  SELECT *, greatest(q, c, m) AS o, ['◯', '✗', '要確認'] AS marks,
         coalesce(CASE WHEN q = 2 THEN '台数差分=欠損' END, CASE WHEN c = 2 THEN c_why END, CASE WHEN m = 2 THEN '名称が不明' END) AS to_review,
         coalesce(CASE WHEN n IS NULL THEN '電気図に記載なし' END, CASE WHEN q = 1 THEN '台数差分=' || {_duck_12g('qty_gap')} END, CASE WHEN c = 1 THEN '容量差分=' || {_duck_12g('c_gap')} END, CASE WHEN m = 1 THEN '名称不一致' END) AS differs
  FROM coded
), declared_part AS (
  SELECT 0 AS segment, marks[o + 1] AS overall, marks[q + 1] AS qty_code, marks[c + 1] AS capacity_code, marks[m + 1] AS name_code, CASE WHEN o = 2 THEN '要確認' WHEN n IS NULL THEN '✗' ELSE '◯' END AS id_match,
         CASE o WHEN 0 THEN '' WHEN 2 THEN coalesce(to_review, differs) ELSE coalesce(differs, to_review) END AS reason, id, declared_name, coalesce(observed_names, '') AS observed_names, {_duck_12g('qty')} AS declared_qty,
         CAST(coalesce(n, 0) AS VARCHAR) AS observed_qty, {_duck_12g('qty_gap')} AS qty_diff, cap AS declared_capacity, mode_values, selected_mode, {_duck_12g('value')} AS selected_capacity, capacity_note,
         coalesce(observed_capacity, '') AS observed_capacity, {_duck_12g('c_gap')} AS capacity_diff, 'M-1' AS declared_drawing, coalesce(observed_drawing, '') AS observed_drawing, coalesce(trace, '') AS trace
  FROM overall
), only_part AS (
  SELECT 1 AS segment, '✗' AS overall, '✗' AS qty_code, '✗' AS capacity_code, '✗' AS name_code, '✗' AS id_match, '機械図に記載なし' AS reason, k AS id, '' AS declared_name, observed_names, '' AS declared_qty, CAST(n AS VARCHAR) AS observed_qty, '' AS qty_diff,
         '' AS declared_capacity, '' AS mode_values, '' AS selected_mode, '' AS selected_capacity, '' AS capacity_note, observed_capacity, '' AS capacity_diff, '' AS declared_drawing, observed_drawing, trace
  FROM gathered WHERE k NOT IN (SELECT id FROM dec)
), missing_part AS (
  SELECT 2 AS segment, '要確認' AS overall, '要確認' AS qty_code, '要確認' AS capacity_code, '要確認' AS name_code, '要確認' AS id_match, '電気図ID未記載' AS reason, '' AS id, '' AS declared_name, name AS observed_names, '' AS declared_qty, CAST(count(*) AS VARCHAR) AS observed_qty, '' AS qty_diff,
         '' AS declared_capacity, '' AS mode_values, '' AS selected_mode, '' AS selected_capacity, '' AS capacity_note, capacity AS observed_capacity, '' AS capacity_diff, '' AS declared_drawing, drawing AS observed_drawing, '' AS trace
  FROM lines WHERE k IS NULL GROUP BY name, capacity, drawing
)
"""


def _with(strict: bool = False) -> str:
    values = {"STRICT_NULL(9.45)": "9.45", "STRICT_MODE": "最大値(冷)", "STRICT_NOTE": "機器名称からモード特定不可のため最大値を採用", "STRICT_TIE": "機器名称からモード特定不可かつ最大値が複数(冷,暖)"}
    if strict:
        values = {"STRICT_NULL(9.45)": "NULL", "STRICT_MODE": "未確定", "STRICT_NOTE": "機器名称からモード特定不可(strict設定)", "STRICT_TIE": "機器名称からモード特定不可(strict設定)"}
    sql = _WITH
    for key, value in values.items():
        sql = sql.replace(key, value)
    return sql


def _declared_part(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    return reconcile.declared_rows(declared(spark, folder), reconcile.observed_by_key(observed(spark, folder), False), strict, False)


@query(_with() + "SELECT id, declared_qty, observed_qty, qty_diff, qty_code FROM declared_part")
def reconcile_quantity(spark: SparkSession, folder: str) -> DataFrame:
    return _declared_part(spark, folder).select("id", "declared_qty", "observed_qty", "qty_diff", "qty_code")


_CAPACITY_COLUMNS = ["id", "declared_capacity", "mode_values", "selected_mode", "selected_capacity", "capacity_note", "observed_capacity", "capacity_diff", "capacity_code"]


@query(_with() + f"SELECT {', '.join(_CAPACITY_COLUMNS)} FROM declared_part")
def reconcile_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return _declared_part(spark, folder).select(*_CAPACITY_COLUMNS)


@query(_with(True) + f"SELECT {', '.join(_CAPACITY_COLUMNS)} FROM declared_part")
def reconcile_capacity_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _declared_part(spark, folder, True).select(*_CAPACITY_COLUMNS)


@query(_with() + "SELECT id, declared_name, observed_names, name_code FROM declared_part")
def reconcile_name(spark: SparkSession, folder: str) -> DataFrame:
    return _declared_part(spark, folder).select("id", "declared_name", "observed_names", "name_code")


@query(_with() + "SELECT id, overall, id_match, reason FROM declared_part")
def reconcile_reason(spark: SparkSession, folder: str) -> DataFrame:
    return _declared_part(spark, folder).select("id", "overall", "id_match", "reason")


@query(_with() + "SELECT * EXCLUDE (segment) FROM only_part")
def reconcile_observed_only(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.observed_only_rows(declared(spark, folder), reconcile.observed_by_key(observed(spark, folder), False), False).drop("segment", "ord")


@query(_with() + "SELECT * EXCLUDE (segment) FROM missing_part")
def reconcile_missing_id(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.missing_id_rows(observed(spark, folder), False).drop("segment", "ord")


@query(_with() + "SELECT k AS key, n, trace, observed_drawing AS drawings FROM gathered")
def reconcile_trace(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.observed_by_key(observed(spark, folder), False).select("key", "n", "trace", F.array_join("drawings", ",").alias("drawings"))


@query(_with() + "SELECT * FROM declared_part UNION ALL SELECT * FROM only_part UNION ALL SELECT * FROM missing_part")
def reconcile_full(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.reconcile(declared(spark, folder), observed(spark, folder), unicode=False).drop("ord")


@query(
    _with()
    + """SELECT count(*) AS n_rows, count(*) FILTER (overall = '◯') AS n_match, count(*) FILTER (overall = '✗') AS n_mismatch, count(*) FILTER (overall = '要確認') AS n_review, count(*) FILTER (id_match = '◯') AS n_id_match
    FROM (SELECT * FROM declared_part UNION ALL SELECT * FROM only_part UNION ALL SELECT * FROM missing_part)"""
)
def reconcile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.summary(reconcile.reconcile(declared(spark, folder), observed(spark, folder), unicode=False))


@query(
    _with()
    + f"""SELECT count(*) FILTER (id <> '' AND reason <> '{reconcile.UNDECLARED}') AS "機械図記載", count(*) FILTER (observed_names || observed_capacity || observed_drawing || trace <> '' OR CAST(observed_qty AS INT) > 0) AS "電気図記載",
    count(*) FILTER (id_match = '◯') AS "ID照合一致", count(*) FILTER (overall = '✗') AS "不一致", count(*) FILTER (overall = '要確認') AS "要確認"
    FROM (SELECT * FROM declared_part UNION ALL SELECT * FROM only_part UNION ALL SELECT * FROM missing_part)"""
)
def customer_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = reconcile.reconcile(declared(spark, folder), observed(spark, folder), unicode=False)
    return reconcile.customer_summary(reconcile.customer_rows(rows.select(*(F.col(c).alias(label) for c, label in reconcile.DISPLAY.items()))))


@query(
    _with()
    + """SELECT id AS "機器ID", CASE id_match WHEN '◯' THEN '○' WHEN '✗' THEN '×' ELSE id_match END AS "ID照合", observed_drawing AS "図面番号_電気図", declared_drawing AS "図面番号_機械図", observed_capacity AS "容量_電気図",
    selected_capacity AS "容量_機械図", capacity_diff AS "容量_差分", observed_qty AS "台数_電気図", declared_qty AS "台数_機械図", qty_diff AS "台数_差分"
    FROM (SELECT * FROM declared_part UNION ALL SELECT * FROM only_part UNION ALL SELECT * FROM missing_part)"""
)
def customer_display(spark: SparkSession, folder: str) -> DataFrame:
    rows = reconcile.reconcile(declared(spark, folder), observed(spark, folder), unicode=False)
    return reconcile.customer_display(rows.select(*(F.col(c).alias(label) for c, label in reconcile.DISPLAY.items())))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, '' AS capacity_text, CAST(n_regionkey AS VARCHAR) AS qty, '' AS drawing_no FROM nation")
def header_role_resolution(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nation")
    shown = n.select(F.col("n_nationkey").cast("string").alias("機械番号"), F.lit("x").alias("機器名称"), F.col("n_name").alias("名 称"), F.lit("").alias("動力（50Hz）_消費電力（KW）"), F.col("n_regionkey").cast("string").alias("台　数"), F.lit(1).alias("ord"))
    return reconcile.by_roles(shown, reconcile.DECLARED_ALIASES, {"id", "capacity_text", "qty"}).drop("ord")


# --- scalars and predicates -------------------------------------------------------------------------------------

_PART_TEXT = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' - ' WHEN 2 THEN '1,234.50' WHEN 3 THEN '0.75,1.5' WHEN 4 THEN '10VA' WHEN 5 THEN '(冷)' || p_size || '.5 (暖)' || p_size || ' (冷)3' ELSE CAST(p_retailprice AS STRING) END"
_PART_CODE = "CASE p_partkey % 5 WHEN 0 THEN ' ef–' || p_size || '-b' || (p_partkey % 30) || ' ' WHEN 1 THEN 'EF-B2-' || p_size WHEN 2 THEN '(M-' || p_size || ')' WHEN 3 THEN '' || p_size ELSE p_brand END"


def _parts(spark: SparkSession, folder: str, **columns: str) -> DataFrame:
    return read_table(spark, folder, "part").select("*", *(F.expr(sql).alias(c) for c, sql in columns.items()))


@query(
    f"""SELECT p_partkey, kind, CASE kind WHEN 'blank' THEN '' WHEN 'numeric' THEN printf('%.12g', value) ELSE t END AS display, value FROM (
    SELECT *, CASE WHEN kind = 'numeric' THEN cast(replace(t, ',', '') AS DOUBLE) END AS value FROM (
    SELECT p_partkey, trim(x) AS t, CASE WHEN trim(x) IN ('', '-') THEN 'blank' WHEN contains(x, ',') AND NOT regexp_matches(trim(x), '{text.THOUSANDS}') THEN 'multi' WHEN regexp_matches(replace(trim(x), ',', ''), '{_NUMBER}') THEN 'numeric' ELSE 'text' END AS kind
    FROM (SELECT p_partkey, {_PART_TEXT} AS x FROM part)))"""
)
def capacity_classify(spark: SparkSession, folder: str) -> DataFrame:
    found = _parts(spark, folder, x=_PART_TEXT).withColumn("c", reconcile.classify_capacity(F.col("x"), False))
    return found.select("p_partkey", F.col("c.kind").alias("kind"), F.col("c.display").alias("display"), F.col("c.value").alias("value"))


@query("SELECT p_partkey, '冷=3,暖=' || p_size AS modes FROM part WHERE p_partkey % 7 = 5 UNION ALL SELECT p_partkey, '' FROM part WHERE p_partkey % 7 <> 5")
def mode_capacity_extract(spark: SparkSession, folder: str) -> DataFrame:
    modes = reconcile.mode_capacities(F.col("x"), False)
    return _parts(spark, folder, x=_PART_TEXT).select("p_partkey", F.array_join(F.transform(modes, lambda m: F.concat(m["mode"], F.lit("="), text.format_12g(m["value"]))), ",").alias("modes"))


@query("SELECT o_orderkey, printf('%.12g', o_totalprice / 7 * pow(10, o_orderkey % 20 - 8)) AS shown, printf('%.12g', CAST(o_orderkey AS DOUBLE)) AS whole FROM orders")
def number_format_12g(spark: SparkSession, folder: str) -> DataFrame:
    o = read_table(spark, folder, "orders")
    return o.select("o_orderkey", text.format_12g(F.col("o_totalprice") / 7 * F.pow(F.lit(10.0), F.col("o_orderkey") % 20 - 8)).alias("shown"), text.format_12g(F.col("o_orderkey").cast("double")).alias("whole"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(replace(trim(x), ',', ''), '{_NUMBER}') THEN cast(replace(trim(x), ',', '') AS DOUBLE) END AS value FROM (SELECT p_partkey, {_PART_TEXT} AS x FROM part)")
def number_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_PART_TEXT).select("p_partkey", text.parse_number(F.col("x"), False).alias("value"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(c, '{text.DRAWING_CODE}') THEN c END AS code FROM (SELECT p_partkey, trim(replace(replace(upper({_PART_CODE}), ' ', ''), '–', '-'), '|,:;[](){{}}<>') AS c FROM part)")
def drawing_code_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_PART_CODE).select("p_partkey", text.drawing_code(F.col("x"), False).alias("code"))


_VOLT = "CASE p_size % 8 WHEN 0 THEN '3Φ200' WHEN 1 THEN '1/200' WHEN 2 THEN '100V' WHEN 3 THEN '34200' WHEN 4 THEN 'nv' WHEN 5 THEN ' 200 v' WHEN 6 THEN '' ELSE '+' || p_size END"


@query(
    f"""SELECT p_partkey, CASE WHEN v = '1/200' THEN '1φ200' WHEN regexp_matches(v, '3[Φφ/+$＊*]?200') OR regexp_replace(v, '[^0-9]', '', 'g') IN ('3200', '34200', '36200', '30200', '200') THEN '200'
    WHEN regexp_matches(v, '^[+-]?[0-9]+V?$') THEN regexp_extract(v, '^([+-]?[0-9]+)V?$', 1) ELSE v END AS voltage FROM (SELECT p_partkey, replace(upper({_VOLT}), ' ', '') AS v FROM part)"""
)
def voltage_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_VOLT).select("p_partkey", text.voltage_text(F.col("x"), False).alias("voltage"))


_POWER = "CASE p_size % 5 WHEN 0 THEN '約' || p_size || '.75kW' WHEN 1 THEN '1,' || (100 + p_size) WHEN 2 THEN '0.75255' WHEN 3 THEN 'なし' ELSE p_size || '.1249' END"


@query(
    f"""SELECT p_partkey, CASE WHEN length(regexp_extract(f, '\\.([0-9]+)', 1)) > 3 THEN regexp_replace(regexp_replace(CAST(round(CAST(f AS DECIMAL(38, 18)), 2)::DECIMAL(38, 2) AS VARCHAR), '0+$', ''), '\\.$', '') ELSE f END AS power
    FROM (SELECT p_partkey, regexp_extract(replace({_POWER}, ',', ''), '([+-]?[0-9]+(?:\\.[0-9]+)?)', 1) AS f FROM part)"""
)
def power_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_POWER).select("p_partkey", text.power_text(F.col("x"), False).alias("power"))


@query(f"SELECT p_partkey, regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[A-Z0-9～~]+(-[A-Z0-9～~]+)*$') AS is_code, regexp_matches(x, '^[A-Z][0-9][0-9]?$') AS is_fixture FROM (SELECT p_partkey, {_PART_CODE} AS x FROM part)")
def equipment_code_test(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_PART_CODE).select("p_partkey", text.looks_like_code(F.col("x")).alias("is_code"), predicates.is_fixture_code(F.col("x")).alias("is_fixture"))


_MODEL = "CASE p_partkey % 3 WHEN 0 THEN p_brand || '： ' || replace(p_type, ' ', ' — ') || ' 2. note' WHEN 1 THEN replace(p_brand, '#', '-') || '(x' || p_size || ') lamp' ELSE p_type END"


@query(
    f"""SELECT p_partkey, CASE WHEN contains(t, ':') THEN trim(split_part(t, ':', 1)) ELSE '' END AS maker,
    CASE WHEN contains(t, ':') THEN trim(regexp_replace(regexp_replace(regexp_extract(replace(trim(substr(t, strpos(t, ':') + 1)), '—', '-'), '^(.*?)( [0-9]+\\. |$)', 1), '\\s*-\\s*', '-', 'g'), '\\s+', ' ', 'g'), ' ,;')
         ELSE regexp_extract(x, '([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)(\\([xX×][0-9]+\\))?', 1) || regexp_extract(x, '([A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+)(\\([xX×][0-9]+\\))?', 2) END AS model
    FROM (SELECT p_partkey, x, replace(x, '：', ':') AS t FROM (SELECT p_partkey, {_MODEL} AS x FROM part))"""
)
def maker_model_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_MODEL).withColumn("m", extract.maker_and_model(F.col("x"))).select("p_partkey", F.col("m.maker").alias("maker"), F.col("m.model").alias("model"))


@query("SELECT doc_id, lower(replace(replace(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '　'), ' ', ''), '　', '')) AS key FROM documents")
def compact_text(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", text.compare_key(F.col("text")).alias("key"))


_CELLS = {
    "code": "CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 11 = 1 THEN '機器記号' ELSE 'EF-' || p_size END",
    "name": "CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 7 = 1 THEN '名称トリップ' ELSE '排水ポンプ' END",
    "voltage": "CASE WHEN p_size % 5 = 0 THEN '' ELSE '200' END",
    "power": "CASE WHEN p_size % 2 = 0 THEN '' ELSE '備考' END",
}
_DUCK_CELLS = "SELECT p_partkey, " + ", ".join(f"{sql} AS {c}" for c, sql in _CELLS.items()) + " FROM part"
_HEAD_HITS = "(" + " + ".join(f"CAST(contains(lower(code || name || voltage || power), '{w}') AS INT)" for w in predicates.HEADER_WORDS) + ")"


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query(
    f"""SELECT p_partkey FROM ({_DUCK_CELLS}) WHERE code || name || voltage || power <> '' AND {_HEAD_HITS} < 3 AND NOT {_any('code || name || voltage || power', predicates.REJECTED_WORDS)}
    AND (regexp_matches(code, '[A-Z]{{1,4}}-[A-Z0-9]{{1,6}}') AND (name <> '' OR regexp_matches(voltage || power, '[0-9]')) OR name <> '' AND regexp_matches(voltage || power, '[0-9]'))"""
)
def data_row_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, **_CELLS).filter(predicates.is_data_row(*map(F.col, _CELLS))).select("p_partkey")


@query(f"SELECT p_partkey, {_HEAD_HITS} >= 3 AS is_header, {_any('code || name || voltage || power', predicates.FOOTER_WORDS)} AS is_footer FROM ({_DUCK_CELLS})")
def header_footer_rows(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.concat(*map(F.col, _CELLS))
    return _parts(spark, folder, **_CELLS).select("p_partkey", predicates.is_header_row(whole).alias("is_header"), predicates.is_footer_row(whole).alias("is_footer"))


@query(f"SELECT p_partkey FROM part WHERE trim({_PART_TEXT}) IN ('', '-', '－', '—')")
def blank_token_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_PART_TEXT).filter(text.is_blank(F.col("x"))).select("p_partkey")


# --- clustering and scans ---------------------------------------------------------------------------------------

_CHAIN = "SELECT *, sum(start) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value, event_id) > 0.01 THEN 1 ELSE 0 END AS start FROM events)"


@query(f"SELECT event_type, cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM ({_CHAIN}) GROUP BY ALL")
def chain_cluster_1d(spark: SparkSession, folder: str) -> DataFrame:
    found = cluster.chain_cluster(read_table(spark, folder, "events"), ["event_type"], "value", 0.01, ["event_id"])
    return found.groupBy("event_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"SELECT event_type, cluster, count(*) AS n FROM ({_CHAIN}) GROUP BY ALL HAVING count(*) >= 3")
def cluster_min_count(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.chain_centers(read_table(spark, folder, "events"), ["event_type"], "value", 0.01, ["event_id"]).filter("n >= 3").drop("center")


@query(
    """SELECT event_type, unnest(range(len(c)))::BIGINT AS cluster, unnest([x.n FOR x IN c])::BIGINT AS n FROM (
    SELECT event_type, list_reduce(list_prepend([{'mean': v[1], 'n': 1}], [[{'mean': x, 'n': 1}] FOR x IN v[2:]]), lambda done, one: CASE WHEN abs(one[1].mean - done[len(done)].mean) <= 2.0
      THEN list_append(done[1:len(done) - 1], {'mean': (done[len(done)].mean * done[len(done)].n + one[1].mean) / (done[len(done)].n + 1), 'n': done[len(done)].n + 1}) ELSE list_concat(done, one) END) AS c
    FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type))"""
)
def running_mean_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.running_mean_cluster(read_table(spark, folder, "events"), ["event_type"], "value", 2.0).drop("center")


@query(
    """SELECT event_type, unnest(k) AS kept FROM (SELECT event_type, list_reduce(list_prepend([v[1]], [[x] FOR x IN v[2:]]), lambda done, one: CASE WHEN one[1] - done[len(done)] >= 1.5 THEN list_concat(done, one) ELSE done END) AS k
    FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type))"""
)
def greedy_thin(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.thin(read_table(spark, folder, "events"), ["event_type"], "value", 1.5)


_BOXES = """SELECT *, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM (SELECT label::BIGINT AS page, vec_id::BIGINT AS ord, embedding[1]::DOUBLE * 1000 AS x0, embedding[2]::DOUBLE * 1000 AS y0, embedding[1]::DOUBLE * 1000 + abs(embedding[3]::DOUBLE * 1000) + 1 AS x1,
  embedding[2]::DOUBLE * 1000 + abs(embedding[4]::DOUBLE * 1000) + 1 AS y1 FROM embeddings)"""


@query(f"SELECT page, ord, sum(start) OVER (PARTITION BY page ORDER BY x0, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY page ORDER BY x0, ord) > 2.0 THEN 1 ELSE 0 END AS start FROM ({_BOXES}))")
def gap_split_rows(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.gap_split(boxes(spark, folder), ["page"], "x0", "x1", 2.0, ["ord"]).select("page", "ord", "part")


@query()
def first_fit_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return cluster.first_fit_boxes(boxes(spark, folder).select("page", "ord", "x0", "y0", "x1", "y1"), "page", 20.0).select("page", "ord", "box")


@query()
def greedy_propagate(spark: SparkSession, folder: str) -> DataFrame:
    rows = boxes(spark, folder).select("page", "ord", F.floor(F.col("cy") / 40).cast("double").alias("y"), F.col("cx").alias("x"), F.when(F.col("ord") % 3 == 0, F.concat(F.lit("C"), F.col("ord"))).otherwise("").alias("code"))
    return cluster.greedy_propagate(rows, "page", 3.0)


_TURNS = "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN role ELSE '' END AS mark FROM conversations"


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "conversations").select("conv_id", "turn", "role", F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise("").alias("mark"))


@query(f"SELECT conv_id, turn, last_value(nullif(mark, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS mark FROM ({_TURNS})")
def forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    return scan.forward_fill(_turns(spark, folder), ["conv_id"], ["turn"], "mark").drop("role")


@query("SELECT conv_id, turn, section FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM conversations) WHERE section > 0 AND role <> 'user'")
def section_split(spark: SparkSession, folder: str) -> DataFrame:
    return scan.split_sections(_turns(spark, folder), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "section")


@query(
    f"""WITH t AS (SELECT *, last_value(nullif(mark, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ({_TURNS})),
    r AS (SELECT *, sum(CASE WHEN mark <> '' AND mark IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS record FROM t),
    s AS (SELECT *, max(CASE WHEN turn % 7 = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS done FROM r WHERE record > 0)
    SELECT conv_id, turn, record FROM s WHERE done = 0"""
)
def record_assembly(spark: SparkSession, folder: str) -> DataFrame:
    return scan.assemble_records(_turns(spark, folder), ["conv_id"], ["turn"], "mark", F.col("turn") % 7 == 6).select("conv_id", "turn", "record")


@query("SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn <= c.turn AND d.turn % 4 = 3)")
def take_while_stop(spark: SparkSession, folder: str) -> DataFrame:
    return scan.take_until(_turns(spark, folder), ["conv_id"], ["turn"], F.col("turn") % 4 == 3).select("conv_id", "turn")


@query(
    """WITH e AS (SELECT event_id, user_id, value > 40 AS data, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
    m AS (SELECT *, sum(CASE WHEN data THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS misses FROM e),
    d AS (SELECT *, max(CASE WHEN island > 0 AND misses > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM m)
    SELECT user_id, event_id FROM d WHERE done = 0 AND data"""
)
def stop_after_n(spark: SparkSession, folder: str) -> DataFrame:
    return scan.stop_after(read_table(spark, folder, "events"), ["user_id"], ["event_id"], F.col("value") > 40, 1).select("user_id", "event_id")


@query("SELECT l_orderkey, l_quantity AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r = n // 2 + 1")
def upper_median_filter(spark: SparkSession, folder: str) -> DataFrame:
    return scan.upper_median(read_table(spark, folder, "lineitem").select("l_orderkey", "l_quantity"), ["l_orderkey"], "l_quantity")


@query("SELECT l_orderkey, median(l_quantity) AS true_median FROM lineitem GROUP BY l_orderkey")
def true_median(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.median("l_quantity").alias("true_median"))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedupe_first_kept(spark: SparkSession, folder: str) -> DataFrame:
    return scan.first_kept(read_table(spark, folder, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


@query("WITH p AS (SELECT * FROM lineitem WHERE l_quantity > 45) SELECT l_orderkey, l_linenumber, l_partkey, 'preferred' AS route FROM p UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'fallback' FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM p)")
def route_fallback(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return scan.route_with_fallback(lines.filter("l_quantity > 45"), lines, "l_orderkey").drop("l_quantity")


@query("SELECT coalesce(n_nationkey, k)::BIGINT AS cell, n_name AS left_value, v AS right_value FROM nation FULL JOIN (SELECT n_nationkey + 3 AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS v FROM nation) ON k = n_nationkey WHERE n_name IS DISTINCT FROM v")
def grid_diff_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nation")
    one = n.select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_name").alias("v"))
    two = n.select((F.col("n_nationkey") + 3).cast("long").alias("cell"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("v"))
    return scan.grid_diff(one, two, ["cell"], "v")


# --- boxes and joins --------------------------------------------------------------------------------------------


@query(f"SELECT ord, CASE WHEN cx < -1000 THEN NULL WHEN cx < -100 THEN 0 WHEN cx < 0 THEN 1 WHEN cx < 100 THEN 2 WHEN cx < 1000 THEN 3 END AS bucket FROM ({_BOXES})")
def interval_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return boxes(spark, folder).select("ord", spatial.interval_bucket(F.col("cx"), [-1000, -100, 0, 100, 1000]).alias("bucket"))


@query(
    f"""WITH b AS ({_BOXES}), p AS (SELECT a.ord, c.ord AS other, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca,
    greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) / greatest(least(a.x1 - a.x0, c.x1 - c.x0), 1) AS ov, greatest(a.x1, c.x1) - least(a.x0, c.x0) AS width FROM b a JOIN b c ON a.page = c.page AND c.ord = a.ord + 10)
    SELECT ord, other, round(CASE WHEN s > 0 THEN s / (aa + ca - s) ELSE 0 END, 9) AS iou, round(ov, 9) AS overlap, round(width, 6) AS union_width FROM p"""
)
def box_iou(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    other = b.select("page", (F.col("ord") - 10).alias("ord"), F.col("ord").alias("other"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    both = b.join(other, ["page", "ord"])
    one, two = spatial.box(), spatial.box("o_")
    whole = spatial.union(one, two)
    return both.select("ord", "other", F.round(spatial.iou(one, two), 9).alias("iou"), F.round(spatial.x_overlap(one, two), 9).alias("overlap"), F.round(whole[2] - whole[0], 6).alias("union_width"))


@query(f"WITH b AS ({_BOXES}) SELECT l.ord, arg_min(r.ord, (abs(l.cx - r.cx), r.ord)) AS anchor FROM (SELECT * FROM b WHERE ord % 4 <> 0) l LEFT JOIN (SELECT * FROM b WHERE ord % 4 = 0) r ON l.page = r.page AND abs(l.cx - r.cx) <= 30 GROUP BY l.ord")
def nearest_anchor_capped(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).select("page", "ord", "cx")
    found = spatial.nearest_join(b.filter("ord % 4 <> 0"), b.filter("ord % 4 = 0"), "page", "cx", "cx", 30.0, ["ord"], "ord")
    return found.select("ord", F.col("nearest.ord").alias("anchor"))


@query(f"WITH b AS ({_BOXES}) SELECT l.ord, max(r.cy) AS above FROM (SELECT * FROM b WHERE ord % 5 <> 0) l LEFT JOIN (SELECT * FROM b WHERE ord % 5 = 0) r ON l.page = r.page AND r.cy < l.cy + 40 GROUP BY l.ord")
def header_asof(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).select("page", "ord", "cy")
    return spatial.asof_above(b.filter("ord % 5 <> 0"), b.filter("ord % 5 = 0").select("page", F.col("cy").alias("head")), "page", "cy", "head", 40.0).select("ord", "above")


@query(
    f"""WITH b AS ({_BOXES}), t AS (SELECT * FROM b WHERE ord % 3 <> 0), h AS (SELECT * FROM b WHERE ord % 50 = 0), k AS (SELECT DISTINCT t.* FROM t JOIN h ON t.page = h.page AND h.cy BETWEEN t.cy + 25 AND t.cy + 70)
    SELECT ord FROM k UNION ALL SELECT ord FROM t WHERE page NOT IN (SELECT page FROM k)"""
)
def semi_with_fallback(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder).select("page", "ord", "cy")
    return spatial.semi_or_all(b.filter("ord % 3 <> 0"), b.filter("ord % 50 = 0").select("page", F.col("cy").alias("head")), "page", "cy", "head", 25.0, 70.0).select("ord")


@query(
    f"""WITH b AS ({_BOXES}), p AS (SELECT l.ord, r.ord AS value, r.x0 - l.x1 + 8 * abs(r.cy - l.cy) AS score FROM b l JOIN b r ON l.page = r.page AND l.ord % 2 = 0 AND r.ord % 2 = 1 AND abs(r.cy - l.cy) <= 22 AND r.x0 - l.x1 BETWEEN 12 AND 360)
    SELECT ord, arg_min(value, (score, value)) AS value FROM p GROUP BY ord"""
)
def scored_range_join(spark: SparkSession, folder: str) -> DataFrame:
    b = boxes(spark, folder)
    left = b.filter("ord % 2 = 0").select("page", "ord", F.col("x1").alias("from_x"), F.col("cy").alias("y"), F.explode(F.array(*(F.floor(F.col("cy") / 22) + d for d in (-1, 0, 1)))).alias("band"))
    right = b.filter("ord % 2 = 1").select("page", F.col("ord").alias("value"), "x0", "cy", F.floor(F.col("cy") / 22).alias("band"))
    near = left.join(right, ["page", "band"]).filter("abs(cy - y) <= 22 AND x0 - from_x BETWEEN 12 AND 360")
    return near.groupBy("ord").agg(F.min_by("value", F.struct(F.col("x0") - F.col("from_x") + 8 * F.abs(F.col("cy") - F.col("y")), F.col("value"))).alias("value"))


# --- areas, JSON, sinks -----------------------------------------------------------------------------------------

_AREA_TEXT = "'専有面積：' || p_size || '.５㎡ バルコニー ' || (p_size % 9 + 1) || '.25平米' || CASE WHEN p_partkey % 3 = 0 THEN ' 合計面積 10坪' ELSE '' END"


@query(f"SELECT p_partkey, p_size || '.5' AS exclusive_area_m2, (p_size % 9 + 1) || '.25' AS balcony_area_m2, CASE WHEN p_partkey % 3 = 0 THEN '33.1' END AS total_area_m2 FROM part WHERE length({_AREA_TEXT}) > 0")
def area_summary_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, x=_AREA_TEXT).select("p_partkey", *area.summary_areas(F.col("x")))


@query("SELECT p_partkey, round(p_size * 3.30579::DOUBLE, 2) AS tsubo, round(p_size * 1.62::DOUBLE, 2) AS tatami, round(p_size * 2.5::DOUBLE, 2) AS rectangle FROM part")
def area_conversions(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return read_table(spark, folder, "part").select("p_partkey", area.tsubo_to_m2(size).alias("tsubo"), area.tatami_to_m2(size).alias("tatami"), area.rectangle(size, F.lit(2.5)).alias("rectangle"))


@query("SELECT *, round(area_m2 / 1.62::DOUBLE, 1) AS tatami FROM (SELECT p_partkey, round(p_size * 100 / 1000::DOUBLE, 3) AS width_m, 2.0::DOUBLE AS depth_m, round(round(p_size * 100 / 1000::DOUBLE, 3) * 2.0::DOUBLE, 2) AS area_m2 FROM part)")
def room_area(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").withColumn("r", area.room_area(F.col("p_size") * 100.0, F.lit(2000.0))).select("p_partkey", "r.*")


@query(
    """SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -a ELSE a END), 2) + 0.0 AS area_m2, count(*) AS pieces FROM (SELECT l_orderkey, l_returnflag, round(l_quantity * 100 / 1000::DOUBLE * 2.0::DOUBLE, 2) AS a FROM lineitem) GROUP BY l_orderkey"""
)
def composite_area(spark: SparkSession, folder: str) -> DataFrame:
    piece = F.struct((F.col("l_quantity") * 100.0).alias("width_mm"), F.lit(2000.0).alias("depth_mm"), F.when(F.col("l_returnflag") == "R", "subtract").otherwise("add").alias("operation"))
    orders = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(piece).alias("pieces"))
    return orders.select("l_orderkey", area.composite_area(F.col("pieces")).alias("area_m2"), F.size("pieces").cast("long").alias("pieces"))


@query("SELECT *, difference < 0.5 AS is_valid FROM (SELECT l_orderkey, sum(l_quantity) AS actual_sum, abs(sum(l_quantity) - 100) AS difference FROM lineitem GROUP BY l_orderkey)")
def area_sum_check(spark: SparkSession, folder: str) -> DataFrame:
    sums = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("areas"))
    return sums.withColumn("c", area.check_sum(F.col("areas"), F.lit(100.0))).select("l_orderkey", "c.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS json FROM events")
def json_brace_extract(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 3
    shown = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n``` done"))).otherwise(F.concat(F.col("props"), F.lit(" and }")))
    return read_table(spark, folder, "events").select("event_id", area.extract_json(shown).alias("json"))


_ROOM = {
    "room_name": "CASE WHEN p_size % 13 = 0 THEN ' ' ELSE p_name END",
    "area_m2": "CASE WHEN p_size % 2 = 0 THEN '-' ELSE '9.5' END",
    "calculation": "CASE WHEN p_size % 3 = 0 THEN '2x3' ELSE '' END",
    "tatami": "CASE WHEN p_size % 5 = 0 THEN '6' ELSE '—' END",
    "floor": "CASE WHEN p_size % 7 = 0 THEN 'wood' END",
    "diagram_type": "CASE WHEN p_partkey % 2 = 0 THEN ' Detailed' ELSE 'simple' END",
}


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN NULL WHEN p_size % 3 = 0 THEN 'calculation' WHEN p_size % 5 = 0 THEN 'tatami' WHEN p_partkey % 2 = 0 AND p_size % 7 = 0 THEN 'finish' END AS warning FROM part WHERE p_size % 13 <> 0")
def room_validation(spark: SparkSession, folder: str) -> DataFrame:
    return area.room_warnings(_parts(spark, folder, **_ROOM)).select("p_partkey", "warning")


_PAIR_TEXT = """CASE p_partkey % 6 WHEN 0 THEN '電源電圧：ＡＣ' || p_size || 'V 消費電流 ' || p_size || 'mA' WHEN 1 THEN '備考注意備考' || p_brand WHEN 2 THEN '質★' || p_size || 'q'
  WHEN 3 THEN '材貝質メラミン焼付塗装塗色（' || p_size || '）黑' WHEN 4 THEN 'カメラ' || p_size || '型' ELSE p_name END"""


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '電源電圧=AC' || p_size || 'V|消費電流=' || p_size || 'mA' WHEN 1 THEN '備考=注意 ' || p_brand WHEN 2 THEN '質量=' || p_size || 'g'
    WHEN 3 THEN '材質=メラミン焼付塗装|塗色（' || p_size || '）=黒' WHEN 4 THEN 'カメラ=' || p_size || '型' ELSE '' END AS pairs FROM part"""
)
def label_value_pairs(spark: SparkSession, folder: str) -> DataFrame:
    shown = _parts(spark, folder, x=_PAIR_TEXT)
    return shown.select("p_partkey", F.array_join(F.transform(frames.pairs_of(F.col("x")), lambda p: F.concat(p["label"], F.lit("="), p["value"])), "|").alias("pairs"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'EF-' || p_size || ',SF-B' || (p_partkey % 9) WHEN 1 THEN 'M-' || p_size ELSE '' END AS codes FROM part")
def drawing_codes(spark: SparkSession, folder: str) -> DataFrame:
    shown = _parts(spark, folder, x="CASE p_partkey % 3 WHEN 0 THEN 'see ef–' || p_size || ' and SF-B' || (p_partkey % 9) || ', EF-' || p_size WHEN 1 THEN '図番 Ｍ－' || p_size ELSE 'none: ' || p_size END")
    return shown.select("p_partkey", F.array_join(extract.drawing_codes(F.col("x")), ",").alias("codes"))


@query("SELECT count(*) AS n_rows, 'n_nationkey,n_name,n_regionkey' AS columns FROM nation")
def csv_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tables.profile(read_table(spark, folder, "nation"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, 'a"b,' || n_name || chr(10) || 'x' AS "名称", CASE WHEN n_regionkey = 2 THEN '' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation""")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Text with quotes, commas and line ends through CSV files with a byte order mark."""
    n = read_table(spark, folder, "nation")
    rows = n.select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("key"), F.concat(F.lit('a"b,'), "n_name", F.lit("\nx")).alias("名称"), F.when(F.col("n_regionkey") != 2, F.col("n_regionkey").cast("string")).alias("region"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_csv(rows, path, ["ord"])
    return tables.read_csv(spark, path).drop("ord")


@query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS number, [n_name, CASE WHEN n_regionkey = 2 THEN '' ELSE 'a<&>' || n_regionkey END, 'z'] AS cells FROM nation")
def xlsx_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Cells through a spreadsheet file."""
    n = read_table(spark, folder, "nation")
    rows = n.select((F.col("n_nationkey") + 1).alias("number"), F.array(F.col("n_name"), F.when(F.col("n_regionkey") == 2, "").otherwise(F.concat(F.lit("a<&>"), "n_regionkey")), F.lit("z ")).alias("cells"))
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}.xlsx"
    sheets.write_xlsx(rows, path)
    return sheets.read_xlsx(spark, path).select("number", "cells")


@query("SELECT count(*) AS n_rows, max(len(string_split(text, chr(10)))) AS n_columns FROM documents")
def ragged_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tables.ragged_profile(read_table(spark, folder, "documents").select(F.split("text", "\n").alias("cells")))


@query("""SELECT n_nationkey AS number, '<row r="' || n_nationkey || '"><c r="A' || n_nationkey || '" t="inlineStr"><is><t>' || n_name || '</t></is></c><c r="B' || n_nationkey || '" t="inlineStr"><is><t>a&amp;&lt;b&gt;</t></is></c></row>' AS xml FROM nation""")
def sheet_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("number"), F.array(F.col("n_name"), F.lit("a&<b>")).alias("cells"))
    return tables.sheet_rows(n)


@query("SELECT p_partkey, replace(replace(p_type, ' ', '-'), 'A', 'ー') AS shown, '&lt;' || replace(p_name, '\"', '&quot;') || '&gt;&amp;' AS escaped, CASE WHEN p_size >= 26 THEN chr(65 + CAST(floor(p_size / 26) - 1 AS INT)) ELSE '' END || chr(65 + p_size % 26) AS letters FROM part")
def text_repairs(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part")
    dashed = text.unify_dashes(F.replace(F.replace(F.col("p_type"), F.lit(" "), F.lit("—")), F.lit("A"), F.lit("ー")))
    return p.select("p_partkey", dashed.alias("shown"), text.xml_escape(F.concat(F.lit("<"), F.col("p_name"), F.lit(">&"))).alias("escaped"), text.column_letters(F.col("p_size")).alias("letters"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS is_uuid4, ['◯', '✗', '要確認'][n_nationkey % 3 + 1] AS mark, n_nationkey % 4 = 1 AS is_label FROM nation")
def marks_and_ids(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("n_nationkey")
    shown = F.concat(F.lit("0a1b2c3d-1234-"), F.when(key % 2 == 0, "4").otherwise("1"), F.lit("abc-8def-0123456789ab"))
    label = F.when(key % 4 == 1, "図面 番号").otherwise("図面")
    return read_table(spark, folder, "nation").select(key, predicates.is_uuid4(shown).alias("is_uuid4"), reconcile.mark(key % 3).alias("mark"), predicates.is_drawing_label(label).alias("is_label"))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """Words of conversations, a page for each, a line for each turn: 40 pixels high, 20 wide for each word."""
    turns = read_table(spark, folder, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").cast("double").alias("line"), F.posexplode(F.split("text", " ")).alias("k", "text"))
    at = F.col("k").cast("double") * 20 + F.when(F.col("k") >= 5, 200).otherwise(0)
    return turns.select("page", (F.col("line").cast("long") * 100_000 + F.col("k")).alias("ord"), "text", at.alias("cx"), (F.col("line") * 40 + F.col("k") % 2).alias("cy"), (at - 9).alias("x0"), (F.col("line") * 40 - 5).alias("y0"), (at + 9).alias("x1"), (F.col("line") * 40 + 5).alias("y1"))


_TURN_WORDS = "SELECT conv_id AS page, turn, string_split(text, ' ') AS w FROM conversations"


@query(f"SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY turn) - 1 AS row, len(w) AS n FROM ({_TURN_WORDS})")
def layout_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layout.rows_by_mean(_words(spark, folder)).groupBy("page", "row").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT page, row, part, array_to_string(CASE part WHEN 0 THEN w[1:5] ELSE w[6:] END, '') AS text FROM (SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY turn) - 1 AS row, w, unnest(range(CASE WHEN len(w) > 5 THEN 2 ELSE 1 END)) AS part FROM ({_TURN_WORDS}))"""
)
def layout_segments(spark: SparkSession, folder: str) -> DataFrame:
    return layout.segments(_words(spark, folder)).select("page", "row", "part", "text")


@query("SELECT l_orderkey, l_linestatus, string_agg(l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM (SELECT DISTINCT l_orderkey, l_linestatus, l_returnflag FROM lineitem) GROUP BY ALL")
def unique_non_blank(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"))


# --- reconciliation with full-width text -------------------------------------------------------------------------

_WIDE = "０１２３４５６７８９"


@query(
    f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN translate(CAST(o_orderkey AS VARCHAR), '0123456789', '{_WIDE}') ELSE CAST(o_orderkey AS VARCHAR) END AS id, 'ＡＢ' || o_orderpriority AS raw_name, coalesce(n, 0)::VARCHAR AS observed_qty, CASE WHEN n IS NULL THEN '✗' WHEN n = 1 + o_orderkey % 3 THEN '◯' ELSE '✗' END AS qty_code
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def reconcile_unicode(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    wide = lambda c: F.translate(F.col(c).cast("string"), "0123456789", _WIDE)
    own = orders.select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, wide("o_orderkey")).otherwise(F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("ＡＢ"), "o_orderpriority").alias("name"), F.lit("１").alias("capacity_text"), F.translate((1 + F.col("o_orderkey") % 3).cast("string"), "123", "１２３").alias("qty"), F.lit("").alias("drawing_no"))
    seen = lines.select(F.struct(*ORDER).alias("ord"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("　"), wide("l_orderkey"))).otherwise(F.col("l_orderkey").cast("string")).alias("id"), F.lit("x").alias("name"), F.lit("").alias("voltage"), F.lit("").alias("capacity_text"), F.lit("").alias("drawing_no"))
    found = reconcile.declared_rows(own, reconcile.observed_by_key(seen))
    return found.join(own.select("ord", F.col("name").alias("raw_name")), "ord").select("id", "raw_name", "observed_qty", "qty_code")


# --- pages and tables ---------------------------------------------------------------------------------------------

_CODED = f"""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) AS o, CASE WHEN l_linenumber % 3 = 1 THEN 'EF-' || l_linenumber ELSE '' END AS code,
  l_returnflag AS name, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS power, CASE WHEN l_linestatus = 'O' THEN l_linestatus ELSE '' END AS n FROM lineitem"""


def _cell_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each order: lines of 19 cells, of which some have no code."""
    own = {vector.ID: F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("ＥＦ-"), "l_linenumber")).otherwise(""), vector.NAME: F.col("l_returnflag"), vector.POWER: F.col("l_quantity").cast("int").cast("string"), vector.COUNT: F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")).otherwise("")}
    return read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.struct(*ORDER).alias("ord"), F.array(*(own.get(k, F.lit("")) for k in range(vector.CELLS))).alias("cells"))


@query(
    f"""WITH c AS ({_CODED}), p AS (SELECT *, last_value(nullif(code, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
    r AS (SELECT *, sum(CASE WHEN code <> '' AND code IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY o ROWS UNBOUNDED PRECEDING)::BIGINT AS record FROM p),
    names AS (SELECT l_orderkey, record, string_agg(name, ' / ' ORDER BY first) AS name FROM (SELECT l_orderkey, record, name, min(o) AS first FROM r GROUP BY ALL) GROUP BY ALL),
    powers AS (SELECT l_orderkey, record, string_agg(power, ' / ' ORDER BY first) AS power FROM (SELECT l_orderkey, record, power, min(o) AS first FROM r GROUP BY ALL) GROUP BY ALL)
    SELECT l_orderkey AS page, record, arg_min(code, o) AS id, any_value(names.name) AS name, any_value(powers.power) AS power, max(n) AS count, CASE WHEN l_orderkey % 2 = 0 THEN 'M-' || l_orderkey ELSE '' END AS drawing_no
    FROM r JOIN names USING (l_orderkey, record) JOIN powers USING (l_orderkey, record) WHERE record > 0 GROUP BY l_orderkey, record"""
)
def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    drawings = read_table(spark, folder, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("page"), F.concat(F.lit("M-"), "o_orderkey").alias("drawing_no"))
    return vector.four_columns(vector.records(_cell_rows(spark, folder)), drawings)


@query("SELECT p_partkey AS page, list_value('機器番号', '名称', '合計') AS head, 'PAC-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-3' ELSE '' END AS id, CASE WHEN p_partkey % 3 = 0 THEN 'ルームエアコン' ELSE p_type END AS name, CAST(p_size AS VARCHAR) AS total FROM part")
def summary_tables(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("ルームエアコ"), F.lit("ン"))).otherwise(F.array(F.col("p_type"), F.lit("")))
    code = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("PAC-"), "p_size", F.lit("-")), F.lit("3"))).otherwise(F.array(F.concat(F.lit("PAC-"), "p_size"), F.lit("")))
    head = F.array(*map(F.lit, ("機器番号", "", "名 称", "", "仕様", "合計")))
    lines = F.array(head, F.concat(code, name, F.array(F.lit("x"), F.col("p_size").cast("string"))))
    rows = vector.summary_rows(p.select(F.col("p_partkey").alias("page"), F.posexplode(lines).alias("ord", "cells")))
    found = rows.groupBy("page").agg(F.min_by("cells", "ord").alias("h"), F.max_by("cells", "ord").alias("c"))
    cell = lambda c, k: F.col(c)[k]
    return found.select("page", F.array(cell("h", 0), F.replace(cell("h", 1), F.lit(" "), F.lit("")), cell("h", 15)).alias("head"), cell("c", 0).alias("id"), cell("c", 1).alias("name"), cell("c", 15).alias("total"))


def _page_words(rows: DataFrame, *items: Column, height: Column | None = None) -> DataFrame:
    """Words of a page of 1,000 by 1,000, or of the given height, from structs of (text, x, y, width)."""
    words = rows.select("page", (F.lit(1000.0) if height is None else height.cast("double")).alias("height"), F.posexplode(F.flatten(F.array(*items))).alias("ord", "w"))
    x, y, half = F.col("w.x").cast("double"), F.col("w.y").cast("double"), F.col("w.width").cast("double") / 2
    return words.select("page", "ord", F.col("w.text").alias("text"), x.alias("cx"), y.alias("cy"), (x - half).alias("x0"), (y - 5).alias("y0"), (x + half).alias("x1"), (y + 5).alias("y1"), F.lit(1000.0).alias("width"), "height")


def _word(text: Column | str, x: Column | int, y: Column | int, width: int = 40) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_column(text).alias("text"), as_column(x).cast("int").alias("x"), as_column(y).cast("int").alias("y"), F.lit(width).alias("width"))


_TABLE_LINES = f"""SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORD}) - 1 AS k, 'SF-' || l_linenumber AS code, CASE l_returnflag WHEN 'R' THEN '送風機' WHEN 'A' THEN '清水ポンプ' ELSE '弁' || l_linestatus END AS name,
  CASE WHEN l_linestatus = 'O' THEN '200' ELSE '100' END AS voltage, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.5' AS power FROM lineitem"""


@query(f"SELECT l_orderkey + 10 AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY k))::BIGINT AS row_index, code, name, voltage, power, 'E-' || l_orderkey AS drawing_no FROM ({_TABLE_LINES}) WHERE l_orderkey % 3 <> 0 OR k < 2")
def raster_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A page for each order: a table of its lines, in every third a footer after the second one, and a drawing number below.

    A page is as high as its lines need. Keys may have more digits than the parts of a usual drawing number.
    """
    name = F.when(F.col("l_returnflag") == "R", "").when(F.col("l_returnflag") == "A", "・湧水ポンプx").otherwise(F.concat(F.lit("弁"), "l_linestatus"))
    line = F.struct(*ORDER, F.concat(F.lit("ｓｆ-"), "l_linenumber").alias("code"), name.alias("name"), F.when(F.col("l_linestatus") == "O", "3φ200").otherwise("100V").alias("voltage"), F.concat(F.rint("l_quantity").cast("int"), F.lit(".5kW")).alias("power"))
    pages = read_table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") + 10).alias("page")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    cut = F.col("page") % 3 == 1
    y = lambda k: F.lit(140) + (k + F.when(cut & (k >= 2), 1).otherwise(0)) * 30
    cells = F.flatten(F.transform("lines", lambda r, k: F.array(_word(F.upper(r["code"]), 100, y(k)), _word(r["name"], 220, y(k)), _word(r["voltage"], 300, y(k)), _word(r["power"], 380, y(k)))))
    head = F.array(_word("機器", 85, 100), _word("番号", 115, 101), _word("名称", 220, 99), _word("電圧(V)", 300, 100), _word("容量(kW)", 380, 100))
    low = F.greatest(F.lit(900), y(F.size("lines")) + 60)
    foot = F.array(_word("図面番号", 800, low, 60), _word("Ｅ-", 790, low + 30), _word((F.col("page") - 10).cast("string"), 840, low + 31))
    stop = F.when(cut, F.array(_word("縮尺", 220, 200))).otherwise(F.array(_word("", 950, 5)))
    found = raster.raster_rows(_page_words(pages, head, cells, stop, foot, height=low + 100), form=r"E-[0-9]+")
    return found.select("page", "row_index", "code", "name", "voltage", "power", "drawing_no")


@query(
    """SELECT p_partkey AS page, 'DL' || (p_size % 9 + 1) AS code, unnest(['DAIKO', 'MK', '']) AS maker, unnest(['LZD-' || p_size, 'AB-' || p_partkey, '同上']) AS model FROM part"""
)
def fixture_schedule(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part").withColumn("page", F.col("p_partkey"))
    code = F.concat(F.lit("DL"), (F.col("p_size") % 9 + 1).cast("string"))
    rows = F.array(
        _word("器具記号", 100, 50), _word("相当型番", 200, 51), _word(code, 100, 100), _word("DAIKO：", 200, 101), _word(F.concat(F.lit("LZD－"), "p_size"), 260, 100),
        _word(F.concat(F.lit("MK:AB-"), "p_partkey"), 210, 150), _word("x", 400, 150), _word(code, 102, 200), _word("同 上", 220, 200), _word("EDM", 600, 250), _word("QQ-1", 650, 250),
    )
    return fixtures.schedule_rows(fixtures.schedule_candidates(_page_words(p, rows))).select("page", "code", "maker", "model")


@query("SELECT p_partkey AS page, unnest(['D' || (p_size % 9), 'L2', '']) AS code, unnest(['Panasonic', 'KOIZUMI', 'DAIKO']) AS maker, unnest(['LGD-' || p_size, 'AU46978L', 'DP-3' || p_size]) AS model FROM part")
def dwelling_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part").withColumn("page", F.col("p_partkey"))
    rows = F.array(
        _word("住戸内", 100, 50), _word("照明器具姿図", 160, 51, 60), _word("Ｄ", 110, 90, 10), _word((F.col("p_size") % 9).cast("string"), 122, 90, 10), _word("S", 900, 91, 10),
        _word("Panasonic", 150, 200), _word(F.concat(F.lit("LGD－"), "p_size"), 210, 200), _word("L2:", 300, 240), _word("KOIZUMI", 350, 240), _word("AU46978L", 410, 240),
        _word("DAIKO", 880, 280), _word(F.concat(F.lit("DP-3"), "p_size"), 940, 280), _word("Far", 50, 700), _word("ZZ-1234", 100, 700),
    )
    return fixtures.dwelling_rows(_page_words(p, rows)).select("page", "code", "maker", "model")


@query(
    """SELECT p_partkey AS page, ['ロビーインターホン', 'VH-' || p_size, '電源電圧', 'DC' || p_size || 'V', '質量', '約' || p_size || 'g(本体)'] AS cells FROM part UNION ALL SELECT p_partkey, ['非常ボタン', 'EB-' || (p_partkey % 7)] FROM part"""
)
def page_frames(spark: SparkSession, folder: str) -> DataFrame:
    p = read_table(spark, folder, "part").withColumn("page", F.col("p_partkey"))
    size = F.col("p_size").cast("string")
    rows = F.array(
        _word("ロビー", 120, 100), _word("インターホン", 180, 101, 60), _word(F.concat(F.lit("VH-"), size), 130, 140), _word(F.concat(F.lit("電源電圧：ＤＣ"), size, F.lit("V")), 160, 400, 120),
        _word("質★約", 130, 440), _word(F.concat(size, F.lit("q")), 170, 440, 30), _word("(本体)", 140, 470), _word("非常ボタン", 700, 100, 80), _word(F.concat(F.lit("EB-"), (F.col("p_partkey") % 7).cast("string")), 710, 150),
    )
    return frames.page_frames(_page_words(p, rows)).select("page", "cells")


# --- nested documents -----------------------------------------------------------------------------------------------

_ROOM_JSON = """'{"diagram_type": " Detailed", "data": {"room_areas": [{"room_name": "' || p_name || '", "area_m2": ' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '9.5' END || ', "calculation": "' || CASE WHEN p_size % 3 = 0 THEN ' 2x3 ' ELSE '' END || '", "tatami": ' || p_size || '}, null, {"room_name": " "}, {"room_name": "x", "area_m2": "－", "' || CASE WHEN p_size % 5 = 0 THEN '床' ELSE 'note' END || '": "wood"}]}}'"""


@query(
    """SELECT p_partkey AS key, 0::BIGINT AS ord, p_name AS room_name, CASE WHEN p_size % 2 = 1 THEN NULL WHEN p_size % 3 = 0 THEN '部屋「' || p_name || '」に計算根拠（2x3）がありますが、area_m2が空欄です。' ELSE '部屋「' || p_name || '」に帖数（' || p_size || '）がありますが、area_m2が空欄です。' END AS message FROM part
    UNION ALL SELECT p_partkey, 3, 'x', CASE WHEN p_size % 5 = 0 THEN '部屋「x」は仕上表に記載されていますが、area_m2が空欄です。寸法を読み取って計算してください。' END FROM part"""
)
def room_messages(spark: SparkSession, folder: str) -> DataFrame:
    rooms = nested.room_rows(_parts(spark, folder, json=_ROOM_JSON).withColumnRenamed("p_partkey", "key"))
    return area.room_messages(area.room_warnings(rooms)).select("key", "ord", "room_name", "message")


_OCR_JSON = """'{"fullTextAnnotation": {"pages": [{"blocks": [{"paragraphs": [{"words": [{"symbols": [{"text": "E"}, {"text": "F"}, {"text": "-' || p_size || '"}], "boundingBox": {"vertices": [{"x": ' || p_size || ', "y": 20}, {"x": 100, "y": 20}, {"x": 100, "y": 31}, {"x": ' || p_size || ', "y": 31}]}},
  {"symbols": [{"text": " "}], "boundingBox": {"vertices": [{"x": 1, "y": 1}]}}]}, {"words": [{"symbols": [{"text": "弁"}], "boundingBox": {"vertices": [{"y": 5}, {"x": 8, "y": 5}, {"x": 8}, {}]}}]}]}]}]}}'"""


@query(
    """SELECT p_partkey AS page, 0::BIGINT AS ord, 'EF-' || p_size AS text, (p_size + 100) / 2::DOUBLE AS cx, 25.5::DOUBLE AS cy, p_size::DOUBLE AS x0, 20::DOUBLE AS y0, 100::DOUBLE AS x1, 31::DOUBLE AS y1 FROM part
    UNION ALL SELECT p_partkey, 2, '弁', 4, 2.5, 0, 0, 8, 5 FROM part"""
)
def ocr_words(spark: SparkSession, folder: str) -> DataFrame:
    return nested.ocr_words(_parts(spark, folder, json=_OCR_JSON).withColumnRenamed("p_partkey", "page"))
