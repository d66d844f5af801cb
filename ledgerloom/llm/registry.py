"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm import decontam, langid, mixing, oracles, quality, sharding, token_counts, topk, warc
from ledgerloom.llm.common import table
from ledgerloom.llm.ngram_join import ngram_classes
from ledgerloom.llm.token_binary import token_binary


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies; LEDGERLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("LEDGERLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leak_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_query(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.section_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_sharding, op3_quality, op4_decontamination, op5_warc, op6_language, op7_token_counts, op8_token_binary, op9_topk, op10_ngram_join)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": oracles.DECONTAMINATION, "op5_warc": oracles.WARC, "op9_topk": oracles.TOPK, "op10_ngram_join": oracles.NGRAM_JOIN}
