"""A corpus pipeline of five stages: quality rules, exact dedup, near dedup, secret redaction, packing.

Every stage takes any table with doc_id, text, source and n_chars, whatever other columns it has, and returns the same
columns but for the last. Null and empty texts fail the quality rules and so go in the first stage; given to a later stage
they are equal to each other, link with nothing, hold no secret and pack as a closing id. Of repeated rows one
stays after the second stage. Very long texts are whole in every stage. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import forget, forget_since, made_so_far, materialize
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.ngram_join import drop_near_copies
from tessera.llm.packing import pack
from tessera.llm.quality_rules import keep_clean
from tessera.llm.secret_scan import redact

TOKENIZER, END_ID = "byte_bpe_50k.json", 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return keep_clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar texts join, the one with the smallest doc_id."""
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced in their texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of token ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL has no byte-pair encoder, automata or packing, so tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage's result being written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = made_so_far()
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        forget_since(mark, keep=docs)
        if name != STAGES[0][0]:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
