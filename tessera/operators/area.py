"""Floor areas: extraction from text, arithmetic, and checks of room tables. Rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the three areas, units, factors, and the keys that show a room's finish.
LABELS = {
    "exclusive_area_m2": ("専有面積", "専用面積", "住戸専用面積", "住戸面積"),
    "balcony_area_m2": ("バルコニー面積", "バルコニー", "ベランダ", "テラス"),
    "total_area_m2": ("延床面積", "床面積合計", "合計面積"),
}
SQUARE_METRES = ("m²", "㎡", "平米", "Ｍ２", "ｍ２")
TEXT_TSUBO, TOOL_TSUBO, TATAMI = 3.31, 3.30579, 1.62
FINISHES = ("floor", "wall", "ceiling", "baseboard", "床", "壁", "天井", "巾木")
SUM_TOLERANCE = 0.5


def normalize(text: Column) -> Column:
    """Plain digits, points and commas, and one spelling of square metres."""
    plain = F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９．，", "0123456789.,")
    for unit in SQUARE_METRES:
        plain = F.replace(plain, F.lit(unit), F.lit("m2"))
    return plain


def _shown(number: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", number), r"0+$", ""), r"\.$", "")


def summary_areas(text: Column) -> list[Column]:
    """The first area after each kind of label, in square metres as text; null where there is none."""
    plain, found = normalize(text), []
    for name, labels in LABELS.items():
        pattern = rf"(?:{'|'.join(labels)})\s*[:：]?\s*(\d+(?:\.\d+)?)\s*(m2|坪)"
        number, unit = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
        found.append(F.when(unit != "", _shown(number.try_cast("double") * F.when(unit == "坪", TEXT_TSUBO).otherwise(1.0))).alias(name))
    return found


def rectangle(width: Column, height: Column) -> Column:
    return F.round(width * height, 2)


def tsubo_to_m2(tsubo: Column) -> Column:
    return F.round(tsubo * TOOL_TSUBO, 2)


def tatami_to_m2(tatami: Column) -> Column:
    return F.round(tatami * TATAMI, 2)


def room_area(width_mm: Column, depth_mm: Column) -> Column:
    """struct(width_m, depth_m, area_m2, tatami)."""
    w, d = F.round(width_mm / 1000, 3), F.round(depth_mm / 1000, 3)
    whole = F.round(w * d, 2)
    return F.struct(w.alias("width_m"), d.alias("depth_m"), whole.alias("area_m2"), F.round(whole / TATAMI, 1).alias("tatami"))


def composite_area(pieces: Column) -> Column:
    """Area of an array of struct(width_mm, depth_mm, operation); only `subtract` is taken off."""
    return F.round(
        F.aggregate(
            pieces,
            F.lit(0.0),
            lambda total, p: total + F.when(F.lower(F.coalesce(p["operation"], F.lit("add"))) == "subtract", -1.0).otherwise(1.0) * room_area(F.coalesce(p["width_mm"], F.lit(0.0)), F.coalesce(p["depth_mm"], F.lit(0.0)))["area_m2"],
        ),
        2,
    )


def check_sum(areas: Column, expected: Column) -> Column:
    """struct(actual_sum, difference, is_valid) of an array of areas against a total."""
    actual = F.round(F.aggregate(areas, F.lit(0.0), lambda t, x: t + x), 2)
    diff = F.round(F.abs(actual - expected), 2)
    return F.struct(actual.alias("actual_sum"), diff.alias("difference"), (diff < SUM_TOLERANCE).alias("is_valid"))


def extract_json(text: Column) -> Column:
    """A text that is JSON, else what stands from its first to its last brace if that is, else null."""
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # the parser stops after the first value, so a bracket around it makes sure that nothing follows
    whole = lambda x: (x != "") & F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))).isNotNull()
    return F.when(whole(text), text).when(whole(inner), inner)


def _empty(value: Column) -> Column:
    return F.coalesce(F.trim(value).isin("", "-", "－", "—"), F.lit(True))


def room_warnings(rooms: DataFrame, diagram_type: str = "diagram_type") -> DataFrame:
    """rooms (room_name, area_m2, calculation, tatami and the finish columns it has) and `warning`: why an empty area is suspect, or null."""
    finishes = [~_empty(F.col(f"`{c}`")) for c in FINISHES if c in rooms.columns]
    any_finish = F.lit(False)
    for f in finishes:
        any_finish = any_finish | f
    kind = F.when(~_empty(F.col("area_m2")), None).when(F.trim(F.coalesce("calculation", F.lit(""))) != "", "calculation").when(~_empty(F.col("tatami")), "tatami")
    kind = kind.when((F.lower(F.trim(F.col(diagram_type))) == "detailed") & any_finish, "finish")
    return rooms.filter(F.trim(F.coalesce("room_name", F.lit(""))) != "").withColumn("warning", kind)


#: What is said of a room whose area is empty, before and after its name, and after what speaks for an area.
ROOM = ("部屋「", "」")
SAID = {"calculation": ("に計算根拠（", "）がありますが、area_m2が空欄です。"), "tatami": ("に帖数（", "）がありますが、area_m2が空欄です。")}
SAID_OF_FINISH = "は仕上表に記載されていますが、area_m2が空欄です。寸法を読み取って計算してください。"


def room_messages(rooms: DataFrame) -> DataFrame:
    """The rooms of room_warnings with `message`, the warning in words, or null."""
    name = F.concat(F.lit(ROOM[0]), F.trim("room_name"), F.lit(ROOM[1]))
    said = F.when(F.col("warning") == "finish", F.concat(name, F.lit(SAID_OF_FINISH)))
    for kind, (before, after) in SAID.items():
        said = said.when(F.col("warning") == kind, F.concat(name, F.lit(before), F.trim(F.col(kind)) if kind == "calculation" else F.col(kind), F.lit(after)))
    return rooms.withColumn("message", said)
