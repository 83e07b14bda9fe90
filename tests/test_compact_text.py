import unicodedata

import duckdb

from tessera.functions.text import WHITE, compare_key
from tessera.plans.catalogue import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    return unicodedata.normalize("NFKC", text or "").strip(WHITE).replace(" ", "").replace("\u3000", "").lower()


def test_compact_text_reads_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    found = sorted((r.doc_id, r.key) for r in QUERIES["compact_text"](spark, FOLDER).collect())
    assert found == sorted((d, plain(t)) for d, t in rows)
    assert any("\n" in key for _, key in found)


def test_compare_key_normalizes_unicode(spark):
    texts = ["ＥＦ－１\nＡ\u00a0b ﬁn", "Cafe\u0301\n ÉTÉ \u3000x", None, "", "\n a\n b \n"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    found = [r.key for r in frame.select("i", compare_key(frame.x).alias("key")).orderBy("i").collect()]
    assert found == [plain(t) for t in texts] and found[0] == "ef-1\nabfin"
