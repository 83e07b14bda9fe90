"""Line-first quality rules, with DataFrame functions only.

Every line is judged on its own: symbol-heavy punctuation, navigation bars and boilerplate notices fail.
Failing lines are removed, and a document that loses too much of its text is rejected, as is one that
fails the base counts. All work stays in its row: nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols, marks of shouting or markup, notices.
SYMBOLS = "[#*$%&|<>]"
MARKS = "[#*$%&|<>!]"
NOTICES = ("cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "click here", "sign up", "log in", "add to cart")
#: White space between words but the blank and the line end.
_OTHER_SPACE = r"[\t\x0B\f\r]"

#: A line fails with one mark for so many words or more, or one bar for so many words or more.
WORDS_PER_MARK = 2
WORDS_PER_BAR = 5
#: A line with a notice fails if it has at most so many words; one with fewer than STUB_WORDS needs an end mark.
NOTICE_WORDS = 20
STUB_WORDS = 3
#: A document stays if its remaining lines hold so many hundredths of its characters in words.
LEAST_LEFT = 50
MIN_WORDS = 50
MOST_REPEATED = 50


def _count(text: Column, chars: str) -> Column:
    """Number of characters of a class. A regular expression's pass costs a tenth of translate's."""
    return F.length(text) - F.length(F.regexp_replace(text, chars, ""))


def _lines(text: Column) -> Column:
    """(line, words) of every line with a word."""
    spaced = F.split(F.regexp_replace(text, _OTHER_SPACE, " "), "\n")
    lines = F.zip_with(F.split(text, "\n"), spaced, lambda line, flat: F.struct(line.alias("line"), F.filter(F.split(flat, " "), lambda w: w != "").alias("words")))
    return F.filter(lines, lambda x: F.size(x["words"]) > 0)


def line_passes(line: Column, words: Column, marks: Column) -> Column:
    """Whether a line of so many words and marks passes the punctuation, navigation and boilerplate rules."""
    bars = _count(line, "[|]")
    lowered = F.lower(line)
    notice = F.lit(False)
    for phrase in NOTICES:
        notice = notice | F.contains(lowered, F.lit(phrase))
    punctuation = (marks > 1) & (marks * WORDS_PER_MARK >= words)
    navigation = (marks > 1) & (bars >= 2) & (bars * WORDS_PER_BAR >= words)
    stub = (words < STUB_WORDS) & ~F.rtrim(line).rlike("[.!?:;\"'”»)…]$")
    return ~(punctuation | navigation | stub | ((words <= NOTICE_WORDS) & notice))


def _ordered(hashes: Column) -> Column:
    """(hash, position) of every window in order of the hashes."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeat_starts(ordered: Column) -> Column:
    """Sorted positions of the windows whose hash equals a neighbour's in this order."""
    pairs = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, verdict and cleaned text of every row of docs, whose other columns are kept under `row`.

    Null text counts as empty: no words, base_failed. Repeated rows and null or repeated ids are judged alike, each on
    its own. A text's lines, words and window hashes are arrays in its row, about 60 bytes a word while it is judged, so a
    task needs some 60 MB for each million words of its longest text.
    3-word windows are compared by 64-bit hash, within one text only. An empty table gives an empty one.
    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines,
    left_chars, base_failed, kept, clean_text, row.
    """
    whole = F.coalesce(F.col("_text"), F.lit(""))
    frame = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    frame = frame.withColumn("_lines", _lines(whole))
    frame = frame.withColumn("_words", F.flatten(F.transform("_lines", lambda x: x["words"])))
    frame = frame.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    frame = frame.withColumn("n_words", F.size("_words").cast("long"))
    hashes = F.col("_hashes")
    n = F.size(hashes)
    # no lambda refers to a column here or below: if the optimizer moves such an expression, it runs once for each element
    after = F.zip_with(F.slice(hashes, F.lit(2), n), F.slice(hashes, F.lit(3), n), lambda b, c: F.struct(b.alias("b"), c.alias("c")))
    window = F.slice(F.zip_with(hashes, after, lambda a, x: F.xxhash64(a, x["b"], x["c"])), F.lit(1), F.greatest(n - 2, F.lit(0)))
    frame = frame.withColumn("_windows", window)
    frame = frame.withColumn("_counted", F.transform("_lines", lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("words"), _count(x["line"], MARKS).alias("marks"))))
    frame = frame.withColumn("_raw", F.transform("_counted", lambda x: x["line"]))
    frame = frame.withColumn("_passed", F.transform(F.filter("_counted", lambda x: line_passes(x["line"], x["words"], x["marks"])), lambda x: x["line"]))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    frame = frame.withColumn("_ordered", F.when(repeats, _ordered(F.col("_windows"))))
    frame = frame.withColumn("_starts", _repeat_starts(F.col("_ordered")))
    starts = F.col("_starts")
    covered = F.aggregate(F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda total, x: total + x)
    frame = frame.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count(whole, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(starts) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        (F.size("_lines") - F.size("_passed")).cast("long").alias("n_failed_lines"),
        F.array_join("_passed", "\n").alias("clean_text"),
        "row",
        # a filter on a verdict isn't moved below this column, so the counts above are made once
        F.monotonically_increasing_id().alias("_fence"),
    )
    left = F.length(F.regexp_replace("clean_text", r"[ \n\t\x0B\f\r]+", "")).cast("long")
    frame = frame.withColumn("left_chars", F.when(F.col("n_failed_lines") == 0, F.col("word_chars")).otherwise(left))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED) | (F.col("_fence") < 0)
    return frame.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("left_chars") * 100 >= F.col("word_chars") * LEAST_LEFT)).drop("_fence")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns as they were.

    Null and empty texts go, as they have no words; repeated rows stay or go together; an empty table gives an empty one.
    """
    return quality_rules(docs, doc_id, text).filter("kept").select("row.*")


def keep_clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows that keep_good keeps, without their failing lines; `n_chars`, if docs have it, counts what is left.

    A text whose lines all pass stays as it is; of others, blank lines go too. Null, empty, repeated and long texts and
    empty tables are as in keep_good; columns may have any names.
    """
    judged = quality_rules(docs, doc_id, text).filter("kept")
    whole = F.when(F.col("n_failed_lines") == 0, F.col(f"row.`{text}`")).otherwise(F.col("clean_text"))
    length = F.when(F.col("n_failed_lines") == 0, F.col(f"row.`{n_chars}`")).otherwise(F.length("clean_text")).cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None
    own = {text: whole, n_chars: length}
    return judged.select(*((own[c] if c in own else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
