"""The corpus pipeline: documents become clean, distinct, redacted and packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; what it returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import langid, minhash_dedup, packing, pii, suffix_dedup
from evispark.llm.common import discard, materialise, table

#: Bytes of a repeated string that the third stage removes, as in op6: more than 50 words, blanks between them, never have fewer.
REPEAT_BYTES = suffix_dedup.MIN_BYTES


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go."""
    return langid.accept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar five-word shingles the first stays."""
    return minhash_dedup.keep_first(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that an earlier document has as well are cut out; all documents stay."""
    return suffix_dedup.without_repeats(docs, REPEAT_BYTES)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data of every text gives way to tags; all documents stay."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of fixed length."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("pii", redact), ("packing", pack)]
#: SQL has neither these filters nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # a stage reads nothing but its predecessor's table
    return STAGES[-1][1](spark, docs, sf_dir)
