"""From documents to packed training windows, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import langmix, lines, minhash, packing
from spindrift.llm.workspace import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling keeps, with all their columns. Null,
    empty and blank texts go; rows that repeat a doc_id or have none are judged
    each by its text; an empty table stays empty."""
    return lines.keep_content(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language holds at least half, with all their
    columns. Texts that are null or have no letter go, and all do where no
    language can be learned; an empty table stays empty."""
    return langmix.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the
    least doc_id, with all its columns. Texts without words and rows without a
    doc_id stay; of rows that repeat a doc_id all stay or all go; an empty table
    stays empty."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in windows of 2048 tokens. A null or empty
    text is its end id alone; rows that repeat a doc_id, or have none, are
    documents of their own; an empty table gives no pieces."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("language", language), ("near_dedup", near_dedup), ("packing", pack)]

#: The verdicts of the first two stages are models', and packing needs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
