"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``documents``, whatever
their names; an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterloom.llm import decontam, nearjoin, packing, quality, suffix
from utterloom.llm.queries import tokenizer_path
from utterloom.llm.shared import discard, free_name, stored, table, with_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Nulls and empty texts are judged like any other, repeated rows alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the first by doc_id, then text; rows without words stay. Repeated and missing ids
    are rows of their own: each row has a key here, which is its doc_id where that is one."""
    key = free_name(docs.columns, "key")
    rows = with_key(docs, key)
    classes = nearjoin.near_classes(rows.select(F.col(key).alias("doc_id"), "text"))
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that also start earlier; those of which nothing is left go, empty ones stay. Rows that share an id are
    ordered by text."""
    return suffix.dedup_texts(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item, with or without an id."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_stage),
    ("suffix array", suffix_stage),
    ("decontamination", decontam_stage),
    ("packing", packing_stage),
]

#: Training and text alignment have no SQL; ``tests/llm`` compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
