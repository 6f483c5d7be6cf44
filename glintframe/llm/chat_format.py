"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant. The
others are users with their names. The mask names the characters that the assistant is trained on: its own texts
with their end marks, as "start-end" pairs (0-based, end excluded) joined by commas. Places are prefix sums: those
of the dialogue with users only, and for each speaker what its own heads differ by.

Speakers are the distinct roles other than "system"; system turns are rendered as such in every perspective. Turns
are in the order of turn (null last), then of the speaker and the text as they are rendered, so ties and repeated
rows have a defined place. Null or blank roles are the speaker "unknown". Null and empty texts are empty turns;
very long texts and conversations are rendered whole, in time linear in the turns for each participant. "<|" within
a text or a name becomes "< |", so that no text can forge a mark. Rows without a conv_id belong to no conversation
and are left out, as are conversations that have only system turns. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm.common import named

SYSTEM = "system"
END = "<|end|>\n"
ASSISTANT = "<|assistant|>\n"


def perspectives(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, perspective, rendered, mask): one row for each conversation and participant; one shuffle by conv_id."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    rows = turns.where(named(conv_id).isNotNull()).select(
        named(conv_id).alias("conv_id"),
        named(turn).alias("turn"),
        plain(F.coalesce(F.nullif(F.trim(named(role)), F.lit("")), F.lit("unknown"))).alias("who"),
        plain(F.coalesce(named(text), F.lit(""))).alias("body"),
    ).withColumn("rest", F.concat("body", F.lit(END)))
    who = F.col("who")
    head = F.when(who == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), who, F.lit("|>\n")))
    # One exchange by conv_id serves the order of turns, both running sums and the collection.
    order = [F.col("turn").asc_nulls_last(), who, F.col("body")]
    whole, own = Window.partitionBy("conv_id").orderBy(*order), Window.partitionBy("conv_id", "who").orderBy("n")
    sums = whole.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("head", head)
        .withColumn("n", F.row_number().over(whole))
        .withColumn("end", F.sum((F.length("head") + F.length("rest")).cast("long")).over(sums))
        .withColumn("less", F.sum((F.length("head") - F.lit(len(ASSISTANT))).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    )
    end = F.col("end") - F.col("less")
    span = F.concat((end - F.length("rest")).cast("string"), F.lit("-"), end.cast("string"))
    turns_of = placed.select("conv_id", F.struct("n", "who", "head", "rest", span.alias("span")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    each = turns_of.select("conv_id", "t", F.explode(F.array_distinct(F.filter(F.col("t.who"), lambda w: w != SYSTEM))).alias("perspective"))
    me = F.col("perspective")
    return each.select(
        "conv_id",
        "perspective",
        F.array_join(F.transform("t", lambda x: F.concat(F.when(x["who"] == me, F.lit(ASSISTANT)).otherwise(x["head"]), x["rest"])), "").alias("rendered"),
        F.array_join(F.transform(F.filter("t", lambda x: x["who"] == me), lambda x: x["span"]), ",").alias("mask"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(nullif(trim(role), ''), 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, body) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
r AS (
  SELECT conv_id, perspective, n, who = perspective AS mine, body || '<|end|>' || chr(10) AS rest,
         CASE WHEN who = 'system' THEN '<|system|>' WHEN who = perspective THEN '<|assistant|>' ELSE '<|user name=' || who || '|>' END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, perspective ORDER BY n)::BIGINT AS e FROM r)
SELECT conv_id, perspective, string_agg(head || rest, '' ORDER BY n) AS rendered,
       coalesce(string_agg((e - length(rest))::VARCHAR || '-' || e::VARCHAR, ',' ORDER BY n) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
