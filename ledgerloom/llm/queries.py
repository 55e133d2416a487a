"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (
    bpe,
    embedding_dedup,
    language_id,
    line_dedup,
    lm_scoring,
    merkle,
    mixing,
    near_dedup,
    prefix_trie,
    quality_cotraining,
    quality_rules,
    token_counts,
    toxicity,
)
from ledgerloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark, sf_dir):
    cut = line_dedup.delete_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "text", "n_deleted")


@query
def op2_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_cotraining.score_quality(documents(spark, sf_dir), labels)


@query
def op3_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir))


@query
def op5_byte_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(
        documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, with_ids=False
    )


@query
def op6_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(documents(spark, sf_dir), labels)


@query
def op7_embedding_dedup(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return embedding_dedup.near_duplicate_vectors(vectors)


@query
def op8_minhash_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(
        documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op10_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(documents(spark, sf_dir))


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query
def op12_merkle_manifest(spark, sf_dir):
    return merkle.tampered_proofs(documents(spark, sf_dir))


@query
def op13_language_id(spark, sf_dir):
    return language_id.identify_languages(documents(spark, sf_dir))
