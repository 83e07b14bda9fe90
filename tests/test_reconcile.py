import pytest

from tessera.operators import reconcile as r

DECLARED = "ord long, id string, name string, capacity_text string, qty string, drawing_no string"
OBSERVED = "ord long, id string, name string, voltage string, capacity_text string, drawing_no string"


def run(spark, declared, observed, strict=False):
    d = spark.createDataFrame([(i, *row) for i, row in enumerate(declared)], DECLARED)
    o = spark.createDataFrame([(i, *row) for i, row in enumerate(observed)], OBSERVED)
    return [x.asDict() for x in r.reconcile(d, o, strict).orderBy("segment", "ord").collect()]


def test_match_mismatch_review_and_segments(spark):
    declared = [("ＥＦ-1", "排風機", "1.5", "2", "M-1"), ("EF-2", "送風機", "2", "1", "M-1"), ("EF-3", "", "-", "x", "M-2"), ("EF-1", "排風機", "9", "2", "M-2")]
    observed = [("ef-1", "排風機", "200", "1.50", "E-1"), ("EF-1 ", "排 風機", "200", "1.5", "E-2"), ("EF-3", "ポンプ", "", "3", "E-1"), ("X-9", "弁", "", "1", ""), ("", "弁", "200", "2", "E-9"), (None, "弁", "200", "2", "E-9"), ("", "", " ", "-", "")]
    rows = run(spark, declared, observed)
    assert [(x["segment"], x["overall"], x["reason"]) for x in rows[:3]] == [(0, "◯", ""), (0, "✗", "電気図に記載なし"), (0, "要確認", "台数差分=欠損")]
    assert rows[0]["id"] == "ＥＦ-1" and rows[0]["observed_drawing"] == "E-1,E-2" and rows[0]["observed_capacity"] == "1.5" and rows[0]["declared_drawing"] == "M-1,M-2"
    assert rows[0]["trace"].startswith("図面:E-1 名称:排風機 容量:1.50 || ")
    assert (rows[3]["overall"], rows[3]["capacity_diff"], rows[3]["reason"]) == ("✗", "-7.5", "容量差分=-7.5")
    assert [(x["segment"], x["id"], x["observed_qty"]) for x in rows[4:]] == [(1, "X-9", "1"), (2, "", "2"), (2, "", "1")]
    assert rows[4]["reason"] == "機械図に記載なし" and rows[5]["observed_names"] == "弁"


@pytest.mark.parametrize(
    "text, name, strict, mode, shown",
    [
        ("(冷)9.45 / (暖)7.18", "室内機", False, "最大値(冷)", "9.45"),
        ("(冷)9.45 / (暖)7.18", "室内機", True, "未確定", ""),
        ("(冷)9.45 / (暖)7.18", "暖房専用機", False, "暖", "7.18"),
        ("(冷)9.45 / (暖)7.18", "冷房専用 暖房専用", False, "未確定", ""),
        ("(冷)5 (暖)5", "機", False, "未確定", ""),
        ("(暖)1,200.5", "機", False, "未確定", ""),
        ("(暖)1200.5", "機", False, "暖", "1200.5"),
        ("1,234", "機", False, "単一値", "1234"),
        ("0.75,1.5", "機", False, "未確定", ""),
        ("10VA", "機", False, "未確定", ""),
        ("－", "機", False, "", ""),
    ],
)
def test_declared_capacity(spark, text, name, strict, mode, shown):
    x = run(spark, [("A-1", name, text, "1", "")], [("A-1", name, "", "1", "")], strict)[0]
    assert (x["selected_mode"], x["selected_capacity"]) == (mode, shown)


def test_tolerance_is_double_arithmetic(spark):
    rows = run(spark, [("A-1", "a", "1.5", "1", ""), ("A-2", "a", "0.2", "1", "")], [("A-1", "a", "", "1.6", ""), ("A-2", "a", "", "0.3", "")])
    assert [x["capacity_code"] for x in rows] == ["✗", "◯"]


def test_display_and_summary(spark):
    d = spark.createDataFrame([(0, "A", "a", "1", "1", "")], DECLARED)
    o = spark.createDataFrame([(0, "A", "a", "", "1", "")], OBSERVED)
    rows = r.reconcile(d, o)
    assert len(r.display(rows).columns) == 22
    assert r.summary(rows).first().asDict() == {"n_rows": 1, "n_match": 1, "n_mismatch": 0, "n_review": 0, "n_id_match": 1}


def test_headers():
    assert r.resolve_headers(["機械番号", "名　称", "台数", "台数 "], {"id": ["機器番号", "機械番号"], "name": ["名称"], "qty": ["台数"]}, {"id"}) == {"id": "機械番号", "name": "名　称", "qty": "台数 "}
    with pytest.raises(ValueError):
        r.resolve_headers(["x"], {"id": ["機器番号"]}, {"id"})
