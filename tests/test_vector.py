"""Cell tables: records, summary tables, power values, drawing numbers."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import vector

ROWS = "page long, ord long, cells array<string>"


def cells(**own):
    at = {"id": 0, "name": 1, "spec": 4, "power": 9, "other": 14, "count": 15}
    row = [""] * 19
    for k, v in own.items():
        row[at[k]] = v
    return row


def found(spark, rows):
    frame = spark.createDataFrame([(1, k, row) for k, row in enumerate(rows)], ROWS)
    return [(r.id, r.name, r.power, r["count"]) for r in vector.four_columns(vector.records(frame)).orderBy("record").collect()]


def test_continuation_rows_add_to_a_record(spark):
    rows = [cells(name="見出し"), cells(id="PAC-1", name="空調機", power="冷 2.5", count="2"), cells(name="(室外機)", power="暖 3.1", count="9"), cells(id="PAC-1-", power="冷 2.5"), [], cells(id="EF-2", name="排風機", count="1")]
    assert found(spark, rows) == [("PAC-1", "空調機 / (室外機)", "冷 2.5 / 暖 3.1", "2"), ("EF-2", "排風機", "", "1")]


def test_a_repeated_code_continues_and_another_begins(spark):
    rows = [cells(id="PAC-1", name="ルームエアコ", count="3"), cells(id="PAC-1", name="マルチタイプン"), cells(id="PAC-2", name="x", power="1"), cells(id="PAC-1", name="y", power="2")]
    assert found(spark, rows) == [("PAC-1", "ルームエアコ マルチタイプン", "", "3"), ("PAC-2", "x", "1", ""), ("PAC-1", "y", "2", "")]


def test_notes_end_a_page_and_split_codes_join(spark):
    rows = [cells(name="■まえ"), cells(id="CAV-11～15", name="-1", power="0.1"), cells(name="■注"), cells(id="EF-9", name="z")]
    assert found(spark, rows) == [("CAV-11～15-1", "", "0.1", "")]
    assert found(spark, [cells(id="EF-1", name="a\n b\t c")]) == [("EF-1", "a b c", "", "")]
    assert found(spark, [cells(name="特記事項")]) == []


def test_summary_tables_are_projected(spark):
    table = [["機器", "名", "", "仕様", "合計"], ["番号", "称", "", "", ""], ["PAC-1", "ルームエアコ", "ン", "x", "4"], ["EF-2", "排風機", "", "y", "1"], ["", "(予備)", "", "", ""]]
    frame = spark.createDataFrame([(1, k, row) for k, row in enumerate(table)] + [(2, 0, ["x", "y"]), (3, 0, [])], ROWS)
    rows = vector.summary_rows(frame).orderBy("page", "ord").collect()
    assert [(r.cells[0], r.cells[1], r.cells[15]) for r in rows] == [("機器", "名", "合計"), ("番号", "称", ""), ("PAC-1", "ルームエアコン", "4"), ("EF-2", "排風機", "1"), ("", "(予備)", "")]
    joined = spark.createDataFrame([(1, 0, ["記号", "", "名称", "合計"]), (1, 1, ["PAC-1-", "2", "機", "7"])], ROWS)
    assert [r.cells[0] for r in vector.summary_rows(joined).orderBy("ord").collect()] == ["記号", "PAC-1-2"]


def test_power_columns_and_values(spark):
    heads = spark.createDataFrame([(["動力消費電力(KW)出力", "消費電力(KW)", "動力消費電力(KW)"],), (["消費電力出力", "x"],), (["x"],)], "h array<string>")
    assert [r[0] for r in heads.select(vector.power_column(F.col("h"))).collect()] == [1, 0, None]
    one = lambda current, *options: spark.range(1).select(vector.best_power(F.lit(current), F.array(*map(F.lit, options)))).first()[0]
    assert one("冷 2", "暖 2.55", "冷 2.55", "冷 2.5") == "冷 2.55"
    assert one("2.5", "x", "9") == "2.5"
    assert one("", "2.5") == ""


def test_drawing_numbers_by_line_or_corner(spark):
    lines = spark.createDataFrame([(1, 0, "工事 M-9"), (1, 1, "図面 番号　Ｍ―１２ M-3"), (2, 0, "図面番号")], "page long, ord long, text string")
    words = spark.createDataFrame([(1, 0, "X-1", 90.0, 90.0), (2, 0, "Y-1", 10.0, 90.0), (2, 1, "Y-2", 70.0, 70.0), (3, 0, "none", 90.0, 90.0)], "page long, ord long, text string, x0 double, y0 double").selectExpr("*", "100D AS width", "100D AS height")
    assert [(r.page, r.drawing_no, r.source) for r in vector.drawing_by_page(lines, words).orderBy("page").collect()] == [(1, "M-12", "line"), (2, "Y-2", "corner")]


def test_rows_are_paired_by_place(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "page long, ord long, x string")
    right = spark.createDataFrame([(1, 1, "p"), (1, 2, "q")], "page long, ord long, y string")
    assert [(r.x, r.y) for r in vector.zip_rows(left, right, ["page"], "ord").orderBy("ord").collect()] == [("a", "p"), ("b", "q")]
    with pytest.raises(Exception, match="as many rows"):
        vector.zip_rows(left, right.limit(1), ["page"], "ord").collect()


def test_default_header(spark):
    one, two = vector.default_header()
    assert len(one) == len(two) == 19 and one[15] == "台数" and two[9] == "消費電力 (KW)"
