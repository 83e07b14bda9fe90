"""The queries of this subpackage: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import sql
from tessera.llm.bpe import bpe_digest
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.license_scan import license_scan
from tessera.llm.ngram_join import ngram_components
from tessera.llm.packing import pack
from tessera.llm.quality_classifier import quality_scores, train_on
from tessera.llm.quality_rules import quality_rules
from tessera.llm.secret_scan import secret_scan
from tessera.llm.token_store import read_tokens, token_folder, write_tokens
from tessera.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), count_links=True)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), token_folder(docs), end_id=2)
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("row", "clean_text", "left_chars")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_scores(docs, train_on(docs, _table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_store": op2_token_store,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_secret_scan": op9_secret_scan,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL = {
    "op4_exact_dedup": sql.EXACT_DEDUP,
    "op5_quality_rules": sql.QUALITY_RULES,
}
