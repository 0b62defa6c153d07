"""A training-data pipeline over ``documents``, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.language import identify_language, language_dictionaries
from rankfold.llm.lines import dedup_lines
from rankfold.llm.minhash import near_duplicates
from rankfold.llm.mixing import mixed_documents
from rankfold.llm.packing import pack_sequences
from rankfold.llm.stages import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters or with a narrow margin go."""
    docs = docs.select(*COLUMNS)
    return identify_language(docs, language_dictionaries(docs), keep=tuple(COLUMNS)).where("not lang_rejected").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; n_chars is counted anew."""
    kept = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard 0.8 or more), that of the smallest id."""
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, percent=SIMILAR_PERCENT).where("not kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; one without a word, as line dedup may leave it, adds nothing."""
    return mixed_documents(docs.select(*COLUMNS).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return pack_sequences(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
