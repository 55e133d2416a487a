"""A corpus from raw documents to token ids, one operator a stage.

Each stage reads what its predecessor wrote as Parquet. All but the last give rows of
``documents``; the last gives a row of ids for each row that it reads.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, line_dedup, mixing, near_dedup, quality_rules
from ledgerloom.llm.common import DOCUMENT
from ledgerloom.scratch import checkpoint_root

RANKS = "byte_bpe_multi_50k.tiktoken"


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing_documents(docs.select(*DOCUMENT))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs; those with no word left go."""
    cut = line_dedup.delete_repeated_lines(docs.select(*DOCUMENT))
    worded = (F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.filter(worded).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs.select(*DOCUMENT))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs.select(*DOCUMENT))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", rules),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("source_mixing", mix),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: The MCD verdict and the library's token ids have no SQL form.
ORACLE_SQL = None
