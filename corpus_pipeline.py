"""The corpus pipeline: stages over `documents`, each one's rows written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionloom.llm import decontamination, language_id, near_dedup, packing, repeated_spans
from opinionloom.llm.common import NO_ID, document_key, free_names, stored

#: About 50 words of five letters, blanks included, less the spread of word lengths: passages of over 50 words go.
REPEAT_BYTES = 256
REPEAT_GRAM = 96
#: Numbers of rows that have no doc_id of their own begin here.
ABOVE_IDS = 1 << 62


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models know; letterless and empty ones go."""
    keyed, keys = document_key(docs)
    judged = language_id.identify(docs).where("rejected")
    gone = judged.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(keys[0]), F.coalesce("name", F.lit(0)).alias(keys[1])).distinct()
    return keyed.join(gone, keys, "left_anti").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates.

    Rows without a doc_id, or that share one, are documents of their own: they get numbers above all doc_ids, so
    they go only where a near copy stays.
    """
    shared = docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").select("doc_id")
    if shared.isEmpty():
        kept = near_dedup.near_duplicates(docs).where("kept OR n_shingles = 0").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    number, flag, same = free_names(docs, "row_number", "is_shared", "same_id")
    marked = docs.join(shared.select(F.col("doc_id").alias(same), F.lit(True).alias(flag)), F.col("doc_id").eqNullSafe(F.col(same)), "left")
    numbered = F.when(F.col(flag), F.lit(ABOVE_IDS) + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    rows = stored(marked.select(*docs.columns, numbered.alias(number)), "numbered")
    kept = near_dedup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).where("kept OR n_shingles = 0")
    return rows.join(kept.select(F.col("doc_id").alias(number)), number, "left_semi").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of REPEAT_BYTES or more that repeat anywhere."""
    return repeated_spans.cut_repeats(docs, REPEAT_BYTES, REPEAT_GRAM)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; a document that is mostly benchmark goes."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Character models and tokenizers are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
