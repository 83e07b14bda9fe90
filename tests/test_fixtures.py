"""Situations of fixture schedules and dwellings."""

import pytest

from tessera.operators.cluster import Mark, propagate
from tessera.plans import fixtures
from tessera.plans.pages import Word

WORDS = "page long, ord long, text string, cx double, cy double, x0 double, y0 double, x1 double, y1 double, width double, height double"


def line(y, *items):
    return [Word(t, float(x), float(y), x - 10.0, y - 5.0, x + 10.0, y + 5.0) for t, x in items]


def frame(spark, words, page=1):
    return spark.createDataFrame([(page, k, *vars(w).values(), 2000.0, 1000.0) for k, w in enumerate(words)], WORDS)


def marks(*rows):
    return [Mark(y, x, m, b, c) for y, x, m, b, c in rows]


def codes(found, **options):
    propagate(found, **options)
    return [m.code for m in found]


def test_codes_spread_to_lines_without_any():
    assert codes(marks((0, 10, 10, 0, "A1"), (0, 500, 500, 1, "A2"), (30, 11, 11, 0, ""), (30, 490, 490, 1, ""))) == ["A1", "A2", "A1", "A2"]
    assert codes(marks((0, 10, 10, 0, "A1"), (0, 500, 500, 1, "A2"), (0, 900, 900, 2, "A3"), (30, 480, 480, 1, ""))) == ["A1", "A2", "A3", "A2"]
    # a line with a code keeps its gaps; sources come again once each is used
    assert codes(marks((0, 10, 10, 0, "A1"), (30, 10, 10, 0, "B"), (30, 500, 500, 1, "")), by_block=False) == ["A1", "B", ""]
    assert codes(marks((0, 10, 10, 0, "A1"), (30, 10, 10, 0, ""), (30, 500, 500, 1, ""))) == ["A1", "A1", "A1"]


def test_codes_spread_within_reach_or_by_block():
    rows = ((0, 10, 10, 0, "A1"), (500, 10, 10, 0, ""), (500, 900, 900, 1, ""))
    assert codes(marks(*rows), by_block=False) == ["A1", "", ""]
    assert codes(marks(*rows)) == ["A1", "A1", ""]
    near = marks((0, 100, 100, 0, "A1"), (0, 300, 300, 1, "A2"), (20, 290, 290, 0, ""))
    assert codes(near) == ["A1", "A2", "A2"] and near[2].block == 1


@pytest.mark.parametrize("text, wanted", [("DL9", True), ("(TP1)", True), ("X’C12A", True), ("L", False), ("LL", False), ("EDL", True), ("ES1", True), ("DL123", False), ("CT2G", True), ("Q1", False)])
def test_codes(text, wanted):
    assert fixtures.is_code(text) is wanted


def test_rows_of_a_schedule():
    row = line(50, ("DL9", 10), ("DAIKO:", 60), ("LZD－", 120), ("92195", 160), ("2.", 200), ("note", 240), ("TP1", 400), ("同上カード", 440), ("CR2", 600), ("TAD-11(x2)", 650))
    found = fixtures.row_candidates(row)
    assert [(c["code"], c["maker_model"], c["row_x"], c["model_x"]) for c in found] == [("DL9", "DAIKO:LZD-92195", 0.0, 50.0), ("TP1", "同上ガード付", 390.0, 390.0), ("CR2", "TAD-11(x2)", 590.0, 640.0)]
    assert [c["maker_model"] for c in fixtures.row_candidates(line(5, ("DAIKO:LZA-93039", 10), ("x", 40)))] == ["DAIKO:LZA-93039"]
    assert fixtures.row_candidates(line(5, ("LZA-93039", 10), ("x", 40))) == []
    assert [c["maker_model"] for c in fixtures.row_candidates(line(5, ("LZA-93039", 10), ("x2", 30), ("12W", 40)))] == ["LZA-93039 x2"]


def test_schedule_pages(spark):
    words = line(10, ("DL1", 10), ("AB-1", 50)) + line(40, ("器具記号", 10), ("相当型番", 100)) + line(80, ("DL1", 10), ("ODELIC：OD-361", 60), ("DL2", 500), ("EDX-2 、 EDX-3", 560))
    words += line(120, ("DAIKO:LZA-1", 60), ("DAIKO:LZA-2", 560)) + line(160, ("EDL", 10), ("AB-77", 60), ("DL5", 500), ("LALE-12", 560)) + line(300, ("器具記号相当型番", 10)) + line(340, ("TP1", 10), ("同上", 50))
    found = fixtures.schedule_rows(fixtures.schedule_candidates(frame(spark, words))).orderBy("page", "section_index", "block_index", "row_y", "row_x").collect()
    assert [(r.section_index, r.block_index, r.code, r.maker, r.model) for r in found] == [(0, 0, "DL1", "ODELIC", "OD-361"), (0, 0, "DL1", "DAIKO", "LZA-1"), (0, 1, "DL2", "", "EDX-2"), (0, 1, "DL2", "DAIKO", "LZA-2"), (1, 0, "TP1", "", "同上")]
    assert fixtures.schedule_candidates(frame(spark, line(10, ("DL1", 10), ("AB-1", 50)))).count() == 0
    with pytest.raises(ValueError):
        fixtures.schedule_candidates(frame(spark, words), mode="on")


def test_ruled_lines():
    assert fixtures.line_blocks([100, 105, 300, 340, 990], 0, 1000) == [(0, 100), (100, 300), (340, 990)]
    rows = [{"row_x": x, "model_x": x + 500, "code": "", "maker_model": "m"} for x in (10, 60)]
    assert fixtures.assist_reasons(rows, [10, 60], 950) == ["high_continuation_ratio", "dense_x_centers", "cross_model_x", "sparse_candidates_in_wide_section"]
    assert fixtures.assist_reasons([], [], 950) == []
    assert fixtures.line_confidence(rows, [(0, 50)], 4, 1) == pytest.approx(0.45 * 0.5 + 0.25 * 0.5 + 0.3)
    assert fixtures.line_confidence(rows, [], 4, 1) == 0.0


def test_ruled_lines_part_blocks(spark):
    words = line(40, ("器具記号", 10), ("相当型番", 100)) + line(80, ("DL1", 20), ("AB-1", 60)) + line(80, ("DL2", 180), ("AB-2", 220)) + line(300, ("MK:AB-3", 25), ("x", 60), ("MK:AB-4", 185))
    rules = spark.createDataFrame([(1, [100.0, 101.0, 250.0, 10.0, 102.0, 103.0, 104.0, 251.0])], "page long, xs array<double>")
    show = lambda found: [(r.block_index, r.code, r.maker_model) for r in found.orderBy("row_y", "row_x").collect()]
    plain = show(fixtures.schedule_candidates(frame(spark, words)))
    assert plain[2:] == [(0, "DL2", "MK:AB-3"), (0, "DL2", "MK:AB-4")]
    forced = show(fixtures.schedule_candidates(frame(spark, words), rules, "force"))
    assert forced[2][1:] == ("DL1", "MK:AB-3") and forced[3][1:] == ("DL2", "MK:AB-4")
    assert show(fixtures.schedule_candidates(frame(spark, words), rules, "off")) == plain


def test_dwellings(spark):
    words = line(100, ("住戸内", 300), ("照明器具姿図", 360)) + line(140, ("D", 310), ("1", 335), ("L2", 700), ("S", 1100))
    words += line(260, ("Panasonic", 320), ("LGD-1234", 420), ("ODELIC:", 720), ("OD3610", 800)) + line(300, ("M1", 330), (":", 350), ("KOIZUMI", 400), ("AU46978L", 480), ("DAIKO", 1110), ("DP-38", 1200)) + line(340, ("注記", 300), ("Maker", 400), ("AB-99", 500))
    words += line(380, ("MAKER", 1900), ("LED10W", 1950), ("X1", 320), ("MAKER", 340)) + line(700, ("Panasonic", 320), ("LGD-9999", 420)) + line(260, ("Other", 50), ("AB-1234", 90))
    found = fixtures.dwelling_rows(frame(spark, words)).orderBy("page", "block_index", "row_y", "row_x").collect()
    assert [(r.code, r.maker, r.model) for r in found] == [("D1", "Panasonic", "LGD-1234"), ("M1", "KOIZUMI", "AU46978L"), ("L2", "ODELIC", "OD3610"), ("", "DAIKO", "DP-38")]
    assert fixtures.dwelling_rows(frame(spark, line(100, ("x", 1)))).count() == 0
    assert fixtures.fixture_label("D1 （ａ）") == "D1(A)" and fixtures.fixture_label("D123") == ""
    assert [fixtures.is_model(m) for m in ("LGD-1", "PF16-2", "10.5W", "LED3W", "ABCD", "A-1")] == [True, False, False, False, False, False]
