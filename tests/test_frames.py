"""Situations of frames: labels and values, blocks, titles, codes, fallbacks, reading order."""

import pytest

from tessera.plans import frames
from tessera.plans.frames import Segment
from tessera.plans.pages import Word


def seg(text, x0, y, x1=None, tall=20.0):
    return Segment(float(y), float(x0), float(x1 if x1 is not None else x0 + 20 * len(text)), y - tall / 2, y + tall / 2, text)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("電源電圧:DC24V消費電流 100mA", [("電源電圧", "DC24V"), ("消費電流", "100mA")]),
        ("消消費電力 5W 質★ 約120q", [("消費電力", "5W"), ("質量", "約120g")]),
        ("質量スイッチ10gマグネット5q", [("質量", "スイッチ10gマグネット:5g")]),
        ("材質 ABS 材質", [("材質", "ABS材質")]),
        ("材質本体:ABS材質カバー:PC", [("材質", "本体:ABS カバー:PC")]),
        ("材貝質鋼板(焼付塗装)", [("材質", "鋼板(焼付塗装)")]),
        ("塗色（スイッチ）黑", [("塗色（スイッチ）", "黒")]),
        ("カメラ 1/4型CMOS", [("カメラ", "1/4型CMOS")]),
        ("カメラ台", []),
        ("考 なし", [("備考", "なし")]),
        ("", []),
    ],
)
def test_labels_and_values(text, wanted):
    assert frames.label_value_pairs(text) == wanted


def test_codes_and_titles():
    assert [frames.code_in(t) for t in ("型番 AB-12+C-3トク", "(商品コード:1234)", "商品コード 99-88a", "特注品です", "x")] == ["AB-12+C-3トク", "(商品コード:1234)", "商品コード:99-88a", "特注品", ""]
    assert [frames.is_title(t) for t in ("ロビーインターホン", "質量", "約10個の箱", "重さ10kg品", "AB-1機", "（注）機器", "機", "abcdef")] == [True] + [False] * 7
    assert [frames.normal_title(t) for t in ("[A1住戸用スピーカ(大)]", "◎・@増幅器+", "12|カメラ")] == ["住戸用スピーカー（大）", "増幅器＋", "カメラ"]


def table(x, y):
    return [seg("電源電圧DC24V", x, y), seg("質量約2kg", x, y + 40), seg("(本体のみ)", x, y + 75)]


def test_a_frame_with_title_code_and_continuation():
    found = [seg("ロビーインターホン", 100, 100), seg("VH-12", 110, 140), *table(100, 400)]
    (f,) = frames.frames_of(found)
    assert f.values == ["ロビーインターホン", "VH-12", "電源電圧", "DC24V", "質量", "約2kg(本体のみ)"]


def test_titles_without_tables():
    both = [seg("ロビーインターホン", 100, 100), seg("VH-12", 110, 140), *table(100, 400), seg("非常ボタン", 1500, 100), seg("EB-3", 1510, 150)]
    assert [f.values for f in frames.frames_of(both)][-1] == ["ロビーインターホン", "VH-12", "電源電圧", "DC24V", "質量", "約2kg(本体のみ)"]
    assert ["非常ボタン", "EB-3"] in [f.values for f in frames.frames_of(both)]
    assert [f.values for f in frames.frames_of([seg("集合玄関機", 100, 100), seg("AA-1", 110, 200), seg("別の何か", 900, 100)])] == [["集合玄関機", "AA-1"]]
    assert [f.values for f in frames.frames_of([seg("集合玄関機", 100, 100)])] == [["集合玄関機"]]
    assert frames.frames_of([]) == []


def test_rows_of_two_columns():
    found = [seg("集合玄関機", 100, 100), seg("◎寸度高", 100, 300), seg("120mm", 260, 302), seg("動作温度", 100, 340), seg("0〜40℃", 260, 338), seg("余り", 100, 700)]
    (f,) = frames.frames_of(found)
    assert f.pairs == [("寸度高", "120mm"), ("動作温度", "0〜40℃")]
    used = frames.column_pairs([seg("甲乙", 100, 300), seg("丙丁", 150, 310, 190), seg("5mm", 210, 305)])
    assert [(p[2], p[3]) for p in used] == [("甲乙", "5mm")]


def test_widest_blocks_go():
    blocks = [frames.Block([seg("x", x, 10, x + w)]) for x, w in ((0, 100), (200, 110), (400, 300))]
    assert frames.without_widest(blocks) == blocks[:2] and frames.without_widest(blocks[2:]) == blocks[2:]


def test_titles_above_several_blocks():
    one, two = frames.Block([seg("x", 0, 300, 200)]), frames.Block([seg("x", 300, 300, 500)])
    title = seg("ロビーインターホン住戸用受話器", 0, 100, 500)
    assert frames.split_title(title, [two, one]) == [(one, "ロビーインターホン"), (two, "住戸用受話器")]
    assert frames.split_title(seg("親機・子機", 0, 100, 500), [one, two]) == [(one, "親機・子機"), (two, "")]
    marked = seg("A1親機B2子機", 0, 100, 500)
    assert [frames.title_text(marked, b) for b in (one, two)] == ["親機", "子機"]


def test_the_overlapping_code_wins():
    block = frames.Block([seg("x", 100, 400, 300)])
    codes = [seg("ZZ-9", 420, 121, 500), seg("AA-1", 150, 140, 250), seg("質量BB-2", 150, 125, 250)]
    assert frames.code_of(block, 100.0, codes) == "AA-1"
    assert frames.code_of(block, 100.0, [seg("AA-1", 150, 289, 250)]) == "AA-1"
    assert frames.code_of(block, 100.0, [seg("AA-1長い説明がここに続いているので", 150, 289, 250)]) == ""


def test_reading_order_and_examples():
    make = lambda title, top, x0, pairs=(): frames.Frame(top, x0, title, "c", list(pairs))
    rows = [make("下", 400.0, 0.0), make("右", 90.0, 500.0), make("左", 200.0, 0.0)]
    assert [f.title for f in frames.reading_order(rows)] == ["左", "右", "下"]
    shown = [make("マグネットセンサーB", 100.0, 0.0), make("通線孔付", 600.0, 300.0, [("備考", "取付")]), make("マグネットセンサー", 2000.0, 0.0, [("備考", "取付")]), make("埋込ボックス", 150.0, 900.0, [("備考", "x")])]
    frames.name_examples(shown)
    assert [f.values for f in shown] == [["マグネットセンサーB", "c"], ["マグネットセンサーB取付参考例"], ["マグネットセンサー取付参考例"], ["埋込ボックス", "c", "備考", "x"]]


def test_pages(spark):
    def words(*items):
        return [Word(t, x + 10.0 * len(t), float(y), float(x), y - 10.0, x + 20.0 * len(t), y + 10.0) for t, x, y in items]

    own = words(("ロビー", 100, 100), ("インターホン", 165, 100), ("VH-12", 110, 140), ("電源電圧", 100, 400), ("DC24V", 190, 400), ("質量", 100, 440), ("2kg", 150, 440))
    rows = [(p, k, *vars(w).values()) for p in (1, 2) for k, w in enumerate(own)]
    found = frames.page_frames(spark.createDataFrame(rows, "page long, ord long, text string, cx double, cy double, x0 double, y0 double, x1 double, y1 double")).orderBy("page", "place").collect()
    assert [(r.page, r.cells) for r in found] == [(p, ["ロビーインターホン", "VH-12", "電源電圧", "DC24V", "質量", "2kg"]) for p in (1, 2)]
