"""Exact dedup by two Bloom passes, with DataFrame functions only.

Pass one maps every text's 64-bit hash to a slot of a bit table and sets the slots that two or more rows
share; for that count every row's slot is shuffled, but no text. Pass two reads the texts again and tests each row's slot: a row whose slot is clear has no equal
anywhere and passes straight through; the others are grouped by SHA-256. A wrong hit costs a little
shuffling and never changes a result, so the bit table has a fixed largest size and the result is exact
at every input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize

#: Bits of the table for each row, and the table's largest size, which bounds the broadcast.
BITS_PER_ROW = 32
MAX_FILTER_BYTES = 64 << 20


def _slot(text: Column, bits: int) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit((1 << bits) - 1))


def repeated_slots(texts: Column, docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): the slots that two or more rows of docs share, 32,768 to a bitmap."""
    slots = docs.select(_slot(texts, bits).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def with_maybe_repeated(docs: DataFrame, text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """docs and a column maybe_repeated; false only where no other row of docs has the same text."""
    bits = min(max(15, (BITS_PER_ROW * docs.count()).bit_length()), (8 * max_filter_bytes).bit_length() - 1)
    whole = F.coalesce(F.col(text), F.lit(""))
    filled = F.broadcast(materialize(repeated_slots(whole, docs, bits), "bloom"))
    slot = _slot(whole, bits)
    place = F.expr("bitmap_bit_position(_slot)")
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0
    probed = docs.withColumn("_slot", slot).withColumn("_bucket", F.expr("bitmap_bucket_number(_slot)"))
    probed = probed.join(filled, F.col("_bucket") == F.col("bucket"), "left")
    return probed.withColumn("maybe_repeated", F.coalesce(is_set, F.lit(False))).drop("_slot", "_bucket", "bucket", "bitmap")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest doc_id
    stays, a null doc_id being the smallest; of rows equal in both, one stays. An empty table gives an
    empty one, and other columns are ignored. A text may have any length: only its hashes are kept.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    seen = with_maybe_repeated(own, "_text", max_filter_bytes)
    sha = F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256)
    seen = materialize(seen.select("doc_id", sha.alias("text_sha256"), "maybe_repeated", F.monotonically_increasing_id().alias("_row")), "exact-dedup")
    alone = seen.filter("NOT maybe_repeated").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = seen.filter("maybe_repeated").select("doc_id", "_row", "text_sha256")
    groups = hits.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "_row")).alias("_last"), F.count(F.lit(1)).alias("group_size"))
    found = lookup(hits, groups, "text_sha256", "group_size", seen.count())
    found = found.select("doc_id", F.col("_last.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_last._row")).alias("kept"), "text_sha256")
    return alone.unionByName(found)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns.

    Rows whose hash is not repeated keep their place; only the others are shuffled, with texts of any length. Null counts
    as empty, but the row that stays is as it was; of repeated rows one stays; a null doc_id is the smallest; an
    empty table gives an empty one; columns may have any names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("_id"), whole.alias("_whole"))
    seen = with_maybe_repeated(rows, "_whole", max_filter_bytes)
    seen = seen.withColumn("_sha", F.when(F.col("maybe_repeated"), F.sha2("_whole", 256)))
    keys = materialize(seen.filter("maybe_repeated").select("_id", "_sha"), "copies")
    last = keys.groupBy("_sha").agg(F.max(F.struct("_id")).alias("_last")).select(F.col("_sha").alias("_key"), F.col("_last._id").alias("_keep"))
    alone = seen.filter("NOT maybe_repeated").select("row.*")
    # only rows with the largest id of their group survive the join, so the distinct below sees no large group
    stays = seen.filter("maybe_repeated").join(last, (F.col("_sha") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_keep")), "left_semi")
    return alone.unionByName(stays.dropDuplicates(["_sha"]).select("row.*"))
