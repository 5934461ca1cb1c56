"""The corpus pipeline: five stages from raw documents to a mixed training set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, language_id, line_join, minhash_join, raking

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a sure language, with the language found as `lang`; those without letters, or in none of the languages, go."""
    found = language_id.documents_with_language(docs, language_id.fit(docs))
    other = found.where(language_id.rejected() | ~F.col("declared").eqNullSafe(F.col("lang_found")))
    other = other.groupBy(F.col("row_key").alias("_key")).agg(F.max(language_id.rejected()).alias("_gone"), F.max("lang_found").alias("_found"))
    kept = docs.join(other, language_id.row_key() == F.col("_key"), "left").where(~F.coalesce("_gone", F.lit(False)))
    return kept.withColumn("lang", F.coalesce("_found", language_id.code(F.col("lang").cast("string")))).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier too, nearly the same; those that keep no line of what they had go."""
    out = line_join.dedup_lines(docs, others=("lang", "source", "n_chars"))
    out = out.where((F.length("kept_text") > 0) | (F.col("n_removed") == 0))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    found = minhash_join.near_duplicates(docs, 80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_key")), "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    gone = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("text_key").alias("_key"))
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(gone, own == F.col("_key"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose expected tokens meet the target shares of sources, languages and topics."""
    return raking.sampled(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: No stage but the last two can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
