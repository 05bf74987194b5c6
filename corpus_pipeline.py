"""Corpus pipeline: language identification, exact dedup, n-gram Jaccard join, mixing to target weights, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs; all but the last return the columns of documents. Rows that a stage drops are those that its operator decides against:
texts whose language is unknown or narrow, later copies, all but one of each group of near copies, documents that the mix
leaves out (those that it takes several times come as several rows). The last stage returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from namewright import reach_workers
from namewright.llm import compression_language, grace_dedup, mixture, packing, partenum
from namewright.llm.shared import fresh_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is found by a narrow margin."""
    reach_workers(spark)
    return compression_language.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    reach_workers(spark)
    return grace_dedup.keep_first(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.75 or more connect, the one with the smallest doc_id stays."""
    reach_workers(spark)
    return partenum.keep_one(docs)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    reach_workers(spark)
    return mixture.repeat_rows(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 1024 tokens."""
    import public_tokenizers

    reach_workers(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mixture", mixture_stage),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the first stage nor tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
