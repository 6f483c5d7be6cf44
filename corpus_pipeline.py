"""Corpus pipeline: language identification, exact dedup, near dedup, source mixing and tokenization, in this order.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame. All but the
last return the columns of documents, and any others that docs has, whatever their names. ``run`` writes each stage's
result to the shared folder and reads it again, so no stage is computed twice and lost executors cost one stage at
most; what a stage wrote for itself is deleted when its result stands.

Cases that all stages share: an empty table gives an empty result. Null and empty texts go in the first stage; given
to a later one, null texts are no copies of each other and empty ones are, neither is near anything, both have no
mass in the mix, and they have null ids (null text) or none (empty text) in the last. Very long texts are worked on
whole. Null ids, langs and sources stay; a null source is a source of its own. Repeated rows, and rows that tie in
text, are copies: one is left. Rows that share an id but not a text are told apart by exact dedup; near dedup and the
mix keep, drop or repeat rows of one id (and source) together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glintframe.llm import exact_dedup, langid, piece_codec, simhash, source_mix
from glintframe.llm.common import documents, staged
from glintframe.sources.shared import forget_tables, tables_written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the labelled languages; the others, and those without a text, go. Where no
    document is labelled only those without a text go."""
    return langid.keep_identified(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest id (null ids last); null texts all stay."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; null ids and texts without a word stay."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, and at least once."""
    return source_mix.apply_mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of each row."""
    return piece_codec.encode(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("source_mix", mix), ("sentencepiece", pieces)]

#: SQL can't express training and convolution, the rounding draws and piece encoding: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs, mark = documents(spark, sf_dir), tables_written(spark)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        forget_tables(spark, mark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
