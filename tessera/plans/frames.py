"""Frames on drawings: a title, a code and a table of labels and values each. Words are as in `pages`.

A page's words become segments, runs of a row without a wide gap. Segments that hold labels grow into blocks, first fit in
reading order; a block takes what continues it, the title above it and the code below that title. Where no label
stands, rows of two columns do for tables, and titles with a code below them for frames.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import JAPANESE
from tessera.plans.pages import Word, bare, by_page, lines_of, parts_of, plain

#: Labels of frames, labels that only count at a segment's start, beginnings of values that hold a label.
LABELS = ("電源電圧", "入力電圧", "出力電圧", "出力電流", "消費電流", "消費電力", "質量", "材質", "形状", "色調", "塗色", "塗装", "備考")
INLINE_LABELS = ("カメラ",)
PAINTS = ("焼付", "焼付け", "焼き付け", "電着", "粉体", "吹付")
NOT_TITLES = (*LABELS, "寸法", "注記", "取付参考例", "図面", "縮尺")
#: What is read wrongly in labels, as pattern and what stands there.
LABEL_REPAIRS = (("^質$", "質量"), ("電電源電圧", "電源電圧"), ("消消費電流", "消費電流"), ("消消費電力", "消費電力"), ("質[★＊*]+", "質量"), ("^質本体", "質量本体"), ("^質最", "質量"), ("材貝質", "材質"), ("形備状", "形状"), ("形備", "形状"), ("^考", "備考"))
#: Patterns of codes, and words that stand for one.
CODE = r"[A-Z]{1,4}-[A-Z0-9]{1,}(?:\+[A-Z0-9-]+)?(?:トク)?"
PRODUCT, PRODUCT_IN_BRACKETS = r"商品コード[:：]?\s*([0-9A-Za-z-]{4,})", r"\(商品コード[:：]?[0-9A-Za-z-]{4,}\)"
PRODUCT_MARK, SPECIAL_CODES = "商品コード", ("特注品",)
HEADER_MARK = r"[A-Z]{1,3}\d{1,3}"
BULLETS = "◎○●◯◇◆□■△▲▽▼⊙⊗◉"
#: Words before which a title that spans blocks is cut; words of titles without a table, and of none.
CUT_WORDS = ("セキュリティ", "ロビーインターホン", "住戸", "マグネット", "カメラ", "電源")
LONE_TITLES = ("センサー", "アダプタ", "アダプター", "インターホン", "コントローラ", "ユニット", "取付具", "増幅器", "ボタン", "スピーカー", "キーボックス", "パワーユニット")
NOT_LONE = ("参考図", "施工", "金具", "通線孔", "コンクリート", "公衆回線", "内蔵")
MOUNTING, EXAMPLE, SENSOR, WIRE_HOLE, BOX = "取付", "取付参考例", "マグネットセンサー", "通線孔", "ボックス"
#: Fixed values in pixels. Rows, and the gaps that part segments of tables, titles and codes.
ROW_GAP, TABLE_GAP, TITLE_GAP, CODE_GAP = 12.0, 70.0, 40.0, 20.0
#: Blocks: how far below one a segment may stand, least overlap; continuation: reach above and below, overlap, side reach.
BLOCK_DY, BLOCK_OVERLAP, MORE_ABOVE, MORE_BELOW, MORE_OVERLAP, MORE_RIGHT, NEXT_ROW = 140.0, 0.18, 8.0, 40.0, 0.35, 420.0, 45.0
WIDEST = 2.1
#: Rows of two columns: tolerance, gap between the columns, factor of the row's difference, rows and gap of a block.
PAIR_DY, PAIR_LEAST, PAIR_MOST, PAIR_FACTOR, PAIR_ROWS, PAIR_BLOCK_DY = 22.0, 12.0, 360.0, 8.0, 2, 120.0
#: Header rows of codes: tolerance, least number of codes, and how far below a title they stand.
CODE_ROW, CODE_ROW_LEAST, TITLE_ABOVE = 24.0, 3, (25.0, 70.0)
TITLE_REACH, TITLE_PAD, HEADER_OFFSET, NO_HEADER, HEADER_NEAR = 900.0, 140.0, 47.0, 420.0, 150.0
#: Codes of a title: rows below it, pads of the block, scores.
CODE_BELOW, CODE_PADS, CODE_LIMIT, PRODUCT_LIMIT, SOFT_MARGIN, SOFT_OVERLAP = (18.0, 190.0), (140.0, 220.0), 420.0, 520.0, 40.0, 0.70
BAND, SIBLING_DY, WIRE_HOLE_DY = 140.0, 220.0, 620.0


@dataclass(frozen=True)
class Segment:
    row_y: float
    x0: float
    x1: float
    top: float
    bottom: float
    text: str

    @property
    def center(self) -> float:
        return (self.x0 + self.x1) / 2


@dataclass
class Block:
    """Segments that make a table, with the box about them."""

    segments: list[Segment]
    x0: float = 0.0
    x1: float = 0.0
    top: float = 0.0
    bottom: float = 0.0
    pairs: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        s = self.segments[0]
        self.x0, self.x1, self.top, self.bottom = s.x0, s.x1, s.top, s.bottom
        for other in self.segments[1:]:
            self.grow(other)

    def grow(self, s: Segment) -> None:
        self.x0, self.x1, self.top, self.bottom = min(self.x0, s.x0), max(self.x1, s.x1), min(self.top, s.top), max(self.bottom, s.bottom)

    def add(self, s: Segment) -> None:
        self.segments.append(s)
        self.grow(s)

    @property
    def center(self) -> float:
        return (self.x0 + self.x1) / 2


@dataclass
class Frame:
    top: float
    x0: float
    title: str
    code: str
    pairs: list[tuple[str, str]]

    @property
    def values(self) -> list[str]:
        return [v for v in (self.title, self.code, *(x for pair in self.pairs for x in pair)) if v]


def segments(words: list[Word], gap: float) -> list[Segment]:
    """Runs of words in a row without a gap wider than `gap`, in order of row and place."""
    found = []
    for line in lines_of(words, ROW_GAP):
        for part in parts_of(line, gap):
            text = bare(" ".join(t for w in part.words if (t := plain(w.text).strip()))).strip("|")
            if text:
                x0, top, x1, bottom = part.box
                found.append(Segment(line.y, x0, x1, top, bottom, text))
    return sorted(found, key=lambda s: (s.row_y, s.x0))


def overlap(a0: float, a1: float, b0: float, b1: float) -> float:
    """Shared width over the narrower one's."""
    return max(0.0, min(a1, b1) - max(a0, b0)) / min(max(1.0, a1 - a0), max(1.0, b1 - b0))


def label_text(text: str) -> str:
    """A text as labels are looked for in it: without blanks, with their common misreadings repaired."""
    shown = bare(text).strip("|")
    for wrong, right in LABEL_REPAIRS:
        shown = re.sub(wrong, right, shown)
    return shown


def has_label(text: str) -> bool:
    return any(label in text for label in LABELS)


def clean_value(value: str) -> str:
    return value.strip("|:：- ").replace("　", "").replace("黑", "黒")


def _repaired(label: str, value: str) -> str:
    """Weights: a g that was read as q, a colon that is missing before the number."""
    if label != "質量":
        return value
    return re.sub(r"(スイッチ|マグネット)(?![:：])(?=\d+(?:\.\d+)?g\b)", r"\1:", re.sub(r"(\d)q\b", r"\1g", value, flags=re.I), flags=re.I)


def _qualifier(value: str) -> tuple[str, str]:
    """What stands in brackets at a value's start, and the rest."""
    found = re.match(r"[(（]([^()（）]{1,12})[)）](.*)$", bare(value))
    return (found[1], clean_value(found[2])) if found else ("", bare(value))


def _promoted(label: str, value: str) -> tuple[str, str]:
    """A colour's qualifier belongs to its label."""
    qualifier, rest = _qualifier(value) if label == "塗色" else ("", value)
    return (f"{label}（{qualifier}）", rest) if qualifier else (label, value)


def inline_pair(text: str) -> list[tuple[str, str]]:
    """The pair of a label that only counts at the start, if its value has a digit, a letter or a slash."""
    shown = label_text(text)
    for label in INLINE_LABELS:
        value = clean_value(shown[len(label) :]) if shown.startswith(label) else ""
        if re.search(r"[\dA-Za-z/／]", value):
            return [(label, value)]
    return []


def label_value_pairs(text: str) -> list[tuple[str, str]]:
    """All labels of a text from left to right with what stands up to the next one; equal neighbours are one pair."""
    shown = label_text(text)
    hits = [m for m in re.finditer("|".join(map(re.escape, LABELS)), shown) if not (m[0] == "塗装" and shown[: m.start()].endswith(PAINTS))]
    if not hits:
        return inline_pair(shown)
    if len(hits) > 1 and hits[-1].end() == len(shown) and hits[-1][0] == hits[-2][0]:
        hits.pop()  # a label that comes again at the end is part of the value
    ends = [m.start() for m in hits[1:]] + [len(shown)]
    found: list[tuple[str, str]] = []
    for m, end in zip(hits, ends):
        label, value = m[0], _repaired(m[0], clean_value(shown[m.end() : end]))
        if found and found[-1][0] == label:
            before = found[-1][1]
            both = _repaired(label, clean_value(f"{before} {value}")) if before and value else value or clean_value(before)
            found[-1] = (label, both)
        else:
            found.append((label, value))
    return [_promoted(*pair) for pair in found]


def code_in(text: str) -> str:
    """The first code of a text, a product code, or a word that stands for one."""
    if m := re.search(CODE, text) or re.search(PRODUCT_IN_BRACKETS, text):
        return m[0]
    if m := re.search(PRODUCT, text):
        return f"{PRODUCT_MARK}:{m[1]}"
    return next((w for w in SPECIAL_CODES if w in text), "")


def _continues_with_code(text: str) -> bool:
    """Whether a value goes on with a code and a colon."""
    shown = label_text(text)
    return PRODUCT_MARK not in shown and bool(re.match(r"(?:\([^)]+\)|（[^）]+）)?[A-Z]{1,4}-[A-Z0-9-]{1,}[:：]", shown))


def continues(text: str) -> bool:
    """Whether a text can go on a value: no label, no code of its own, not too long, with a letter or a digit."""
    shown = label_text(text)
    if not shown or len(shown) > 80 or re.search(CODE, shown) and not _continues_with_code(shown) or label_value_pairs(shown):
        return False
    return bool(re.search(JAPANESE, shown) or re.search(r"\d", shown))


def is_title(text: str) -> bool:
    """Whether a segment may be a title: Japanese, of some length, without codes, labels, measures or brackets before it."""
    if not 3 <= len(text) <= 48 or re.search(CODE, text) or not re.search(JAPANESE, text):
        return False
    if PRODUCT_MARK in text or any(w in text for w in (*SPECIAL_CODES, *NOT_TITLES)) or text.startswith(("(", "（", "<", "＜", "[")):
        return False
    return not ("約" in text and re.search(r"\d", text)) and not re.search(r"\d+(?:\.\d+)?(?:kg|g|v|a|w|hz|φ)", text.lower())


def normal_title(title: str) -> str:
    """A title without marks, bullets and the letters of its frame, with full-width brackets and plus signs."""
    shown = re.sub(r"^\d+\|", "", title.strip("[]|"))
    for letters in (r"^[A-Za-z]{1,4}\d{0,3}", r"^[A-Za-z]{1,4}"):
        shown = re.sub(letters + r"(?=[ぁ-んァ-ン一-龥（(])", "", shown)
    shown = re.sub(f"^[{BULLETS}]+", "", shown).lstrip("|・").lstrip("@")
    return re.sub(r"スピーカ(?!ー)", "スピーカー", shown).translate(str.maketrans("()+", "（）＋")).strip()


def table_blocks(found: list[Segment]) -> list[Block]:
    """Blocks of segments with labels: each joins the first block that it overlaps and that doesn't end too far above it."""
    blocks: list[Block] = []
    for s in found:
        if not has_label(label_text(s.text)):
            continue
        home = next((b for b in blocks if s.row_y <= b.bottom + BLOCK_DY and overlap(s.x0, s.x1, b.x0, b.x1) >= BLOCK_OVERLAP), None)
        if home:
            home.add(s)
        else:
            blocks.append(Block([s]))
    return blocks


def _beside(s: Segment, block: Block, blocks: list[Block], shared: float) -> bool:
    """Whether a segment with a label of its own that barely overlaps a block belongs to it and to no other one."""
    if s.x0 > block.x1 + MORE_RIGHT:
        return False
    near = [b for b in blocks if b.top - MORE_ABOVE <= s.row_y <= b.bottom + MORE_BELOW]
    if not near:
        return True
    best = max(overlap(s.x0, s.x1, b.x0, b.x1) for b in near)
    if best >= MORE_OVERLAP:
        return shared + 1e-6 >= best
    return min(near, key=lambda b: abs(b.center - s.center)) is block


def attach(blocks: list[Block], found: list[Segment]) -> None:
    """Add to each block the segments beside and below its rows that go on its values."""
    for block in blocks:
        known = set(block.segments)
        for s in found:
            if s in known or not block.top - MORE_ABOVE <= s.row_y <= block.bottom + MORE_BELOW:
                continue
            inline = bool(inline_pair(s.text)) or label_text(s.text) in INLINE_LABELS
            shared = overlap(s.x0, s.x1, block.x0, block.x1)
            if shared < MORE_OVERLAP and not (inline and _beside(s, block, blocks, shared)):
                continue
            if (re.search(HEADER_MARK, s.text) or code_in(s.text)) and not _continues_with_code(s.text):
                continue
            if not inline and (is_title(s.text) and s.x0 <= block.x0 + 60 or not continues(s.text)):
                continue
            block.add(s)
            known.add(s)


def block_pairs(block: Block) -> list[tuple[str, str]]:
    """The pairs of a block row by row; a row without labels goes on the value before it or is that of a label alone."""
    pairs: list[tuple[str, str]] = []
    waiting, before = "", None
    for s in sorted(block.segments, key=lambda s: (s.row_y, s.x0)):
        close = before is None or s.row_y - before <= NEXT_ROW
        before = s.row_y
        if detected := label_value_pairs(s.text):
            pairs += detected
            waiting = ""
        elif label_text(s.text) in INLINE_LABELS:
            waiting = label_text(s.text)
        elif waiting and close and continues(s.text):
            if value := clean_value(s.text):
                pairs.append((waiting, value))
            waiting = ""
        elif pairs and close and continues(s.text):
            label, value = pairs[-1]
            more = s.text
            if label == "塗色" and (found := _qualifier(more))[0]:
                label, more = f"{label}（{found[0]}）", found[1]
            pairs[-1] = _promoted(label, _repaired(label, clean_value(value + more)))
        else:
            waiting = ""
    return [p for p in pairs if p[0]]


def without_widest(blocks: list[Block]) -> list[Block]:
    """Blocks that aren't much wider than the middle one."""
    widths = sorted(max(1.0, b.x1 - b.x0) for b in blocks)
    return [b for b in blocks if max(1.0, b.x1 - b.x0) <= WIDEST * widths[len(widths) // 2]] if len(blocks) > 1 else blocks


def is_column_label(text: str) -> bool:
    """Whether a segment may name a row of two columns."""
    number = re.fullmatch(r"[0-9０-９]+(?:[.,][0-9０-９]+)?(?:mm|cm|m|kg|g|v|a|w|hz|℃|%|φ)?", text, re.I)
    return 2 <= len(text) <= 24 and not code_in(text) and not has_label(label_text(text)) and not number and bool(re.search(JAPANESE, text))


def is_column_value(text: str) -> bool:
    return 0 < len(text) <= 80 and not code_in(text) and not re.fullmatch(f"[{BULLETS}]+", text)


def column_pairs(found: list[Segment]) -> list[tuple[Segment, Segment, str, str]]:
    """(left, right, label, value): each label with the nearest value to its right in its row; a value serves the first label only."""
    values = [s for s in found if is_column_value(s.text) and (not is_column_label(s.text) or re.search(r"\d|[%℃°/()（）~〜]", s.text))]
    pairs, used = [], set()
    for left in found:
        if not is_column_label(left.text):
            continue
        near = [s for s in values if s.x0 > left.x1 and abs(s.row_y - left.row_y) <= PAIR_DY and PAIR_LEAST <= s.x0 - left.x1 <= PAIR_MOST]
        right = min(near, key=lambda s: s.x0 - left.x1 + PAIR_FACTOR * abs(s.row_y - left.row_y), default=None)
        if right is None or right in used:
            continue
        label = re.sub(f"^[{BULLETS}]+", "", bare(left.text).strip("|:：- "))
        value = _repaired(label, clean_value(right.text))
        if label and value:
            used.add(right)
            pairs.append((left, right, label, value))
    return pairs


def column_blocks(found: list[Segment]) -> list[Block]:
    """Blocks of rows of two columns that stand below each other, two rows or more."""
    blocks: list[tuple[Block, list[float]]] = []
    for left, right, label, value in sorted(column_pairs(found), key=lambda p: (p[0].row_y, p[0].x0)):
        for block, at in blocks:
            shift = abs(left.x0 - at[0])
            if left.row_y <= block.bottom + PAIR_BLOCK_DY and shift <= 260 and abs(right.x0 - at[1]) <= 360 and (shift <= 180 or overlap(left.x0, right.x1, block.x0, block.x1) >= 0.05):
                n = len(block.pairs)
                at[:] = [(at[0] * n + left.x0) / (n + 1), (at[1] * n + right.x0) / (n + 1)]
                block.add(left)
                block.add(right)
                block.pairs.append((label, value))
                break
        else:
            block = Block([left, right])
            block.pairs.append((label, value))
            blocks.append((block, [left.x0, right.x0]))
    return [block for block, _ in blocks if len(block.pairs) >= PAIR_ROWS]


def code_rows(found: list[Segment]) -> list[float]:
    """Heights of rows in which three codes or more stand on their own."""
    ys = sorted(s.row_y for s in found if (c := code_in(s.text)) and not has_label(s.text) and len(s.text) <= len(c) + 14)
    groups: list[list[float]] = []
    for y in ys:
        if groups and y - groups[-1][-1] <= CODE_ROW:
            groups[-1].append(y)
        else:
            groups.append([y])
    return [sum(g) / len(g) for g in groups if len(g) >= CODE_ROW_LEAST]


def title_of(block: Block, titles: list[Segment], least: float) -> Segment | None:
    """The nearest title above a block that overlaps it and its margins."""
    near = [s for s in titles if s.row_y < block.top <= s.row_y + TITLE_REACH and overlap(s.x0, s.x1, block.x0 - TITLE_PAD, block.x1 + TITLE_PAD) >= least]
    return min(near, key=lambda s: block.top - s.row_y + 0.2 * abs(s.center - block.center), default=None)


def code_at(x0: float, x1: float, y: float, reach: float, codes: list[Segment], pads: tuple[float, float] = (200.0, 300.0), least: float = 0.01) -> str:
    """The code that stands best below a place."""
    scored = []
    for s in codes:
        shared = overlap(s.x0, s.x1, x0 - pads[0], x1 + pads[1])
        if y <= s.row_y <= y + reach and shared >= least:
            scored.append((1.2 * (s.row_y - y) + abs(s.center - (x0 + x1) / 2) + 120 * (1 - shared), code_in(s.text)))
    return min(scored, key=lambda c: c[0], default=(0, ""))[1]


def code_of(block: Block, title_y: float, codes: list[Segment]) -> str:
    """The code of a block's title: the best below it, unless even that scores too badly."""
    low, high = title_y + CODE_BELOW[0], title_y + CODE_BELOW[1]
    scored = []
    for s in codes:
        code, shared = code_in(s.text), overlap(s.x0, s.x1, block.x0 - CODE_PADS[0], block.x1 + CODE_PADS[1])
        if not low <= s.row_y <= high or has_label(s.text) or shared <= 0:
            continue
        spoken = re.search(r"[ぁ-んァ-ン一-龥:：]", s.text) and f"{PRODUCT_MARK}:" not in code and code not in SPECIAL_CODES
        penalty = 120 * (len(s.text) > len(code) + 12) + 80 * bool(spoken) + 200 * (s.row_y > 3000) + 220 * (1 - shared)
        scored.append((abs(s.center - block.center) + 2 * (s.row_y - low) + penalty, code, shared))
    if not scored:
        return ""
    score, code, shared = min(scored, key=lambda c: c[0])
    product = f"{PRODUCT_MARK}:" in code
    limit = PRODUCT_LIMIT if product else CODE_LIMIT
    return code if score <= limit or not product and shared >= SOFT_OVERLAP and score <= limit + SOFT_MARGIN else ""


def title_text(title: Segment, block: Block) -> str:
    """A title's part above a block, if frame marks part it, else all of it."""
    marks = list(re.finditer(HEADER_MARK, title.text))
    parts = [p for m, after in zip(marks, [*marks[1:], None]) if (p := title.text[m.end() : after.start() if after else len(title.text)].strip(" |・"))] if len(marks) > 1 else []
    if not parts:
        return normal_title(title.text)
    share = min(max((block.center - title.x0) / max(1.0, title.x1 - title.x0), 0.0), 0.999999)
    return normal_title(parts[min(int(share * len(parts)), len(parts) - 1)])


def _cut(text: str, at: int) -> int:
    """The start of a word near a cut, or the cut itself."""
    starts = [m.start() for word in CUT_WORDS for m in re.finditer(f"(?={word})", text)] if 0 < at < len(text) else []
    return min((s for s in starts if abs(s - at) <= 10), key=lambda s: abs(s - at), default=at)


def split_title(title: Segment, blocks: list[Block]) -> list[tuple[Block, str]]:
    """A title that stands above several blocks, cut between them; whole for the first one if a part gets too short."""
    text, ordered = normal_title(title.text), sorted(blocks, key=lambda b: b.x0)
    if len(ordered) == 1 or not text:
        return [(ordered[0], text)]
    width = max(1.0, title.x1 - title.x0)
    cuts = [0]
    for a, b in zip(ordered, ordered[1:]):
        share = ((a.x1 + b.x0) / 2 - title.x0) / width
        cuts.append(_cut(text, round(min(1.0, max(0.0, share)) * len(text))))
    cuts.append(len(text))
    for k in range(1, len(cuts)):
        cuts[k] = max(cuts[k], cuts[k - 1] + 1)
    cuts[-1] = len(text)
    parts = [normal_title(text[i:j].strip()) for i, j in zip(cuts, cuts[1:])]
    if any(len(p) < 4 for p in parts):
        parts = [text] + [""] * (len(ordered) - 1)
    return list(zip(ordered, parts))


def reading_order(frames: list[Frame]) -> list[Frame]:
    """By bands of similar height, then from left to right; a frame joins the first band whose mean is near."""
    bands: list[list[float]] = []
    keyed = []
    for f in sorted(frames, key=lambda f: (f.top, f.x0)):
        k = next((k for k, b in enumerate(bands) if abs(f.top - b[0]) <= BAND), len(bands))
        if k == len(bands):
            bands.append([f.top, 1.0])
        else:
            bands[k] = [(bands[k][0] * bands[k][1] + f.top) / (bands[k][1] + 1), bands[k][1] + 1]
        keyed.append((k, f.x0, f.top, f))
    return [f for *_, f in sorted(keyed, key=lambda x: x[:3])]


def name_examples(frames: list[Frame]) -> None:
    """Frames that show how something is mounted are named after the sensor to their left, without code and pairs."""
    for f in frames:
        f.title = normal_title(f.title)
    for f in frames:
        if EXAMPLE not in f.title:
            if MOUNTING not in "".join(v for _, v in f.pairs):
                continue
            if f.title == SENSOR or WIRE_HOLE in f.title or f.title.endswith(BOX):
                reach = WIRE_HOLE_DY if WIRE_HOLE in f.title else SIBLING_DY
                near = [o for o in frames if o.title.startswith(SENSOR) and abs(o.top - f.top) <= reach and o.x0 < f.x0]
                if near:
                    f.title = min(near, key=lambda o: abs(o.x0 - f.x0)).title + EXAMPLE
                elif f.title == SENSOR:
                    f.title += EXAMPLE
        if EXAMPLE in f.title:
            f.code, f.pairs = "", []


def frames_of(found: list[Segment], title_source: list[Segment] | None = None, code_source: list[Segment] | None = None) -> list[Frame]:
    """A page's frames in reading order, equal ones once. Titles and codes may come from segments that are parted otherwise."""
    blocks = table_blocks(found)
    attach(blocks, found)
    codes = [s for s in (found if code_source is None else code_source) if code_in(s.text)]
    every = [s for s in (found if title_source is None else title_source) if is_title(s.text)]
    rows = code_rows(codes)
    titles = [s for s in every if any(TITLE_ABOVE[0] <= y - s.row_y <= TITLE_ABOVE[1] for y in rows)] or every
    for b in blocks:
        b.pairs = block_pairs(b)
    tables = without_widest([b for b in blocks if b.pairs]) or without_widest(column_blocks(found))
    tables.sort(key=lambda b: (b.top, b.x0))
    owner = {id(b): title_of(b, titles, 0.15) or title_of(b, every, 0.05) for b in tables}
    text: dict[int, str] = {}
    for title in dict.fromkeys(t for t in owner.values() if t):
        own = [b for b in tables if owner[id(b)] == title]
        text |= {id(b): t for b, t in ([(own[0], title_text(title, own[0]))] if len(own) == 1 else split_title(title, own))}
    frames, used = [], set()
    for b in tables:
        title, shown = owner[id(b)], text.get(id(b), "")
        if title:
            used.add(title)
        if not shown:
            above = [y for y in rows if y < b.top + 40]
            header = max(above) - HEADER_OFFSET if above else max(0.0, b.top - NO_HEADER)
            near = [s for s in every if s.row_y < b.top and abs(s.row_y - header) <= HEADER_NEAR]
            if spare := title_of(b, near or every, 0.02):
                title, shown = spare, title_text(spare, b)
                used.add(spare)
        if shown:
            code = (code_of(b, title.row_y, codes) or code_at(b.x0, b.x1, title.row_y, 220.0, codes, (80.0, 120.0), 0.35)) if title else ""
            frames.append(Frame(b.top, b.x0, shown, code, b.pairs))
    for s in titles:
        shown = normal_title(s.text)
        if s not in used and not shown.startswith(("備考", "考")) and not any(w in shown for w in NOT_LONE) and any(w in shown for w in LONE_TITLES):
            used.add(s)
            frames.append(Frame(s.top, s.x0, shown, code_at(s.x0, s.x1, s.row_y, 140.0, codes, (40.0, 180.0), 0.55), []))
    if not frames:
        for s in titles:
            code = code_at(s.x0, s.x1, s.row_y, 260.0, codes) if s not in used else ""
            if s not in used and (code or len(titles) == 1 and not blocks):
                frames.append(Frame(s.top, s.x0, normal_title(s.text), code, []))
    frames = [f for f in frames if f.values]
    name_examples(frames)
    kept: dict[tuple[str, ...], Frame] = {}
    for f in reading_order(frames):
        kept.setdefault(tuple(f.values), f)
    return list(kept.values())


FRAME_SCHEMA = "page long, place long, top double, x0 double, title string, code string, pairs array<struct<label:string,value:string>>, cells array<string>"


def _page_frames(page: int, words: list[Word], _: dict) -> list[dict]:
    own = [segments(words, gap) for gap in (TABLE_GAP, TITLE_GAP, CODE_GAP)]
    found = reading_order(frames_of(*own))
    return [{"page": page, "place": k, "top": f.top, "x0": f.x0, "title": f.title, "code": f.code, "pairs": [{"label": a, "value": b} for a, b in f.pairs], "cells": f.values} for k, f in enumerate(found)]


def page_frames(words: DataFrame) -> DataFrame:
    """The frames of all pages, to be shown in order of page and place: title, code, pairs, and cells, the row that is written."""
    return by_page(words, FRAME_SCHEMA, _page_frames)


def pairs_of(text: Column) -> Column:
    """array of struct(label, value): label_value_pairs of a text column, by Arrow batches, as its repairs look back and ahead."""

    @F.pandas_udf("array<struct<label:string,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"label": a, "value": b} for a, b in label_value_pairs(t or "")])

    return run(text)
