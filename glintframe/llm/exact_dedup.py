"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Texts are counted by their length in bytes; lengths that occur once drop out.
2. Of the texts left, pairs of length and hash of the first characters are counted; those that occur once drop out.
3. Only the texts of the groups left are hashed as a whole, by SHA-256.

Each level reads the table again and finds its rows by a bitmap of the level before (``common.sieved``), so that
only lengths, hashes and ids are shuffled, never a text. A bitmap lets some more rows pass than survive: 6 % of the
others, and more beyond 67 million groups, where its size is bounded. They are hashed and found to be alone.

Null text: unknown content, never a copy of anything. Empty texts are copies of each other. Very long texts are
hashed as a whole. Null ids: such rows sort last, so they are kept only if all rows of their group have none. Ties
(rows of one text and id) and repeated rows count as copies of each other, and one row is kept. Rows that share an
id but not the text are told apart: only the copies among them go. Columns other than the two named are ignored by
``exact_duplicates`` and passed through by ``drop_exact_duplicates``, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm.common import BROADCAST_BYTES, fresh, measured_bytes, named, sieved, staged

PREFIX_CHARS = 256


def _prefix_hash(text: F.Column, prefix_chars: int) -> F.Column:
    return F.xxhash64(F.substring(text, 1, prefix_chars))


def _full_hash(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(text, 256))


def survivors(docs: DataFrame, doc_id: str, text: str, prefix_chars: int) -> DataFrame:
    """(_id, _len, _prefix, _text) of the rows whose whole text has to be hashed."""
    rows = docs.where(named(text).isNotNull()).select(named(doc_id).alias("_id"), F.octet_length(named(text)).cast("long").alias("_len"), named(text).alias("_text"))
    lengths = staged(rows.groupBy("_len").count().where("count > 1").select("_len"))
    second = sieved(rows, lengths, ["_len"]).select("_id", "_len", _prefix_hash(F.col("_text"), prefix_chars).alias("_prefix"), "_text")
    groups = staged(second.groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix"))
    return sieved(second, groups, ["_len", "_prefix"])


def _ranked(docs: DataFrame, doc_id: str, text: str, prefix_chars: int) -> DataFrame:
    """Rows that may be copies: _id, the group's key, its kept id and the row's place in it."""
    hashed = survivors(docs, doc_id, text, prefix_chars).select("_id", "_len", "_prefix", _full_hash(F.col("_text")).alias("_full"))
    w = Window.partitionBy("_len", "_prefix", "_full").orderBy(F.col("_id").asc_nulls_last())
    return hashed.select("*", F.row_number().over(w).alias("_place"), F.first("_id").over(w).alias("_keep"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each row to drop: its id and, as duplicate_of, the smallest id with the same text."""
    return _ranked(docs, doc_id, text, prefix_chars).where("_place > 1").select(F.col("_id").alias("doc_id"), F.col("_keep").alias("duplicate_of"))


def drop_exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The input without the rows of ``exact_duplicates``; columns and their order stay.

    Beyond broadcast_bytes of rows to drop, only the rows that share an id with one of them are shuffled.
    """
    dropped = staged(_ranked(docs, doc_id, text, prefix_chars).where("_place > 1"))
    # A row is dropped by its id and text if the id is not its group's kept one. Rows that share an id with the kept
    # row of their text, or have none, can't be told apart by these: they are reduced by the text itself.
    drop, size, prefix, full, again, place = fresh(docs, "_drop", "_size", "_prefix", "_full", "_again", "_place")
    gone = staged(dropped.where("_id is not null and _id <> _keep").select("_id", "_len", "_prefix", "_full").distinct().toDF(drop, size, prefix, full))
    unclear = staged(dropped.where("_id is null or _id = _keep").select(F.col("_keep").alias(again)).distinct())
    same_text = (
        (F.octet_length(named(text)).cast("long") == F.col(size))
        & (_prefix_hash(named(text), prefix_chars) == F.col(prefix))
        # A range, since an equality would become a join key, and every text would be hashed.
        & _full_hash(named(text)).between(F.col(full), F.col(full))
    )
    same_id = named(doc_id) == F.col(drop)
    if measured_bytes(gone) <= broadcast_bytes:
        rest = docs.join(F.broadcast(gone), same_id & same_text, "left_anti")
    else:
        touched, others = _by_ids(docs, doc_id, gone.select(F.col(drop)))
        rest = others.unionByName(touched.join(gone, same_id & same_text, "left_anti"))
    if unclear.isEmpty():
        return rest
    no_text, some = rest.where(named(text).isNull()), rest.where(named(text).isNotNull())
    touched, others = _by_ids(some.where(named(doc_id).isNotNull()), doc_id, unclear.where(F.col(again).isNotNull()))
    w = Window.partitionBy(F.sha2(named(text), 256)).orderBy(named(doc_id).asc_nulls_last())
    # Of rows that only may be meant, those with another id are each the only one of their text that is left.
    once = touched.unionByName(some.where(named(doc_id).isNull())).withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
    return others.unionByName(no_text).unionByName(once)


def _by_ids(docs: DataFrame, doc_id: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with an id that may be among these, and all others; neither side shuffles docs."""
    (key,) = fresh(docs, "_key")
    marked = docs.withColumn(key, named(doc_id))
    wanted = ids.toDF(key)
    return sieved(marked, wanted, [key]).drop(key), sieved(marked, wanted, [key], passing=False).drop(key)


SQL = """
SELECT doc_id, keep AS duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep FROM documents WHERE text IS NOT NULL
) WHERE doc_id <> keep
"""
