"""The corpus pipeline: rules, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes what the one before it kept, written as Parquet and read again; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import decontaminate, packing, quality_rules, simhash, suffix_dedup
from changelens.llm.common import prepared, table
from changelens.llm.queries import vocabulary
from changelens.scratch import settle


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_rejected(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which nothing is left are dropped; ``n_chars`` follows the text."""
    prepared(spark)
    cut = suffix_dedup.cut_repeats(docs)
    left = cut.filter((F.col("cut_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        shorter = F.when(F.col("cut_words") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", shorter)
    return left.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return packing.pack(docs, vocabulary(), with_ids=False)


STAGES = [
    ("quality rules", reject_by_rules),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The learned rules, component search and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
