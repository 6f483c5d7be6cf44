"""The ten operators on their whole tables with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glintframe.llm import chat_format, exact_dedup, langid, piece_codec, secret_scan, simhash, source_mix, suffix_dedup, token_binary, winnowing
from glintframe.llm.common import documents, staged

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = staged(token_binary.tokenize(documents(spark, sf_dir)))
    return token_binary.encode(tokens, token_binary.train_dictionary(tokens))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_language_id,
            op2_exact_dedup,
            op3_suffix_dedup,
            op4_chat_format,
            op5_token_binary,
            op6_winnowing,
            op7_sentencepiece,
            op8_simhash_near_dedup,
            op9_source_mix,
            op10_secret_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.SQL,
        "op3_suffix_dedup": suffix_dedup.SQL,
        "op4_chat_format": chat_format.SQL,
        "op6_winnowing": winnowing.SQL,
        "op8_simhash_near_dedup": simhash.SQL,
    }
