"""A corpus from raw documents to packed bins: five stages, each the next one's input, written as Parquet in between.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents, but for the
last, which returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protospark.llm import langid, mixing, packing, quality, simhash
from protospark.llm.common import cut, discard, word_count


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return langid.keep_identified(docs, langid.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules stay."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays, the one with the least doc_id, nulls last.

    Rows are told apart by doc_id and text together, so a null or repeated doc_id costs no document of its own.
    """
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    sized = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.emit(mixing.mix(sized)).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, and pieces of long ones, in bins; a word counts as a token, and each document has an end token."""
    cluster = F.xxhash64(F.coalesce("text", F.lit("")))
    return packing.pack(docs, word_count(F.col("text")) + 1, F.col("source"), cluster).withColumnRenamed("key", "doc_id")


STAGES = [("language", language), ("quality", good), ("simhash", distinct), ("mixing", mixed), ("packing", packed)]
#: Trained models and fingerprints aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's table is deleted once the next one's is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
