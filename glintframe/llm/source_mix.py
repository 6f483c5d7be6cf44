"""Mixing sources to target weights by pivotal dependent rounding.

A source's mass is the number of characters of its texts. Its target weight is proportional to mass ** ALPHA, so
that small sources gain. Each document of a source gets the same expected number of copies, the source's rate;
rates have the ratio that the weights ask for, and the smallest is 1, so no document is lost: large sources are
kept once and small ones repeated.

The whole part of a rate is sure. The fractions are rounded so that each source has the sum of its fractions,
rounded up or down, as extra copies: two open units of a source transfer mass at random, until one is 0 or 1, and
go on. With fractions a and b below 1 together, one gets 0 and the other a + b; the one that keeps it is drawn
with a probability proportional to its fraction. Otherwise one gets 1 and the other a + b - 1; the one that goes
on is drawn in proportion to what it lacks. Expectations stay. A bucket of units leaves at most one open unit of a
source; those are combined in a reduction tree over the buckets, and a draw settles the last. Draws come from a
hash of the seed and the units, so a lost task gives the same result when it runs again.

Units are the distinct pairs of id and source: rows that repeat one, and so texts that share an id, are copied
alike. Ties (equal fractions) are settled by the draws. A null source is a source of its own, null ids of a source
are one unit. Null and empty texts have no mass; very long texts count whole. Without weights, a source without mass
is kept once. With weights, a source that they don't name, or give null, zero or less, has no share of the mix: its
rate is 0 and its documents have no copy; one with a weight but without mass is kept once. Other columns are ignored
(``mix``) or passed through (``apply_mix``). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import fresh, mix64, named, small_enough, staged, tidy

ALPHA = 0.85
SEED = 20240229
#: Units of a bucket, and buckets or residuals that one task of the tree combines.
BUCKET_UNITS = 32_768
FAN_IN = 16
#: Tasks of one level; each takes several buckets beyond it.
MOST_TASKS = 100_000


def rates(docs: DataFrame, text: str = "text", source: str = "source", alpha: float = ALPHA, weights: DataFrame | None = None) -> DataFrame:
    """(source, rate): expected copies of each document. weights (source, weight) replaces mass ** alpha."""
    mass = docs.groupBy(named(source).alias("source")).agg(F.sum(F.coalesce(F.length(named(text)), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        raw = mass.withColumn("raw", F.pow("mass", F.lit(alpha - 1.0))).withColumn("out", F.lit(False))
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        named_ones = mass.join(w, F.col("source").eqNullSafe(F.col("_s")), "left")
        raw = named_ones.withColumn("raw", F.try_divide("_w", "mass")).withColumn("out", ~F.coalesce(F.col("_w") > 0, F.lit(False)))
    raw = staged(raw.withColumn("raw", F.when((F.col("mass") > 0) & ~F.col("out"), F.col("raw"))).select("source", "raw", "out"))
    least = raw.agg(F.min("raw").alias("least"))  # one row
    rate = F.when(F.col("out"), F.lit(0.0)).otherwise(F.coalesce(F.round(F.col("raw") / F.col("least"), 12), F.lit(1.0)))
    return raw.crossJoin(F.broadcast(least)).select("source", rate.alias("rate"))


def pivotal(p: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round fractions one after the other: extra copies of each, -1 for the unit left open, and that unit or -1.

    The unit that is open at the end has its fraction in p.
    """
    n = len(p)
    out = np.full(n, -1, np.int8)
    draw = (mix64(key.view(np.uint64) ^ np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    fractions, draws = p.tolist(), draw.tolist()
    open_, a = -1, 0.0
    for i in range(n):
        b = fractions[i]
        if b <= 0.0 or b >= 1.0:
            out[i] = int(b >= 1.0)
            continue
        if open_ < 0:
            open_, a = i, b
            continue
        total = a + b
        if total < 1.0:
            stays, goes = (open_, i) if draws[i] * total < a else (i, open_)
            out[goes], open_, a = 0, stays, total
        else:
            rest = total - 1.0
            stays, goes = (open_, i) if draws[i] * (2.0 - total) < 1.0 - a else (i, open_)
            out[goes], open_, a = 1, stays, rest
            if rest <= 1e-12:
                out[open_], open_ = 0, -1
    if open_ >= 0:
        p[open_] = a
    return out, open_


_SCHEMA = "node bigint, source string, unit bigint, key bigint, p double, extra tinyint"


def _round_groups(rows: DataFrame, seed: int) -> DataFrame:
    """Pivotal rounding within each (node, source); extra is null for the one open unit, p its fraction."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        node, key = t.column("node").to_numpy(), t.column("key").to_numpy()
        code = t.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        unit = t.column("unit").to_numpy()
        order = np.lexsort((unit, key, code, node))
        p = t.column("p").to_numpy().copy()[order]
        new = np.flatnonzero(np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (code[order][1:] != code[order][:-1])]))
        extra = np.empty(len(p), np.int8)
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(p)], strict=True):
            part = p[a:b]
            extra[a:b], _ = pivotal(part, key[order][a:b], seed)
        t = t.take(pa.array(order))
        out = pa.table({"node": t["node"], "source": t["source"], "unit": t["unit"], "key": t["key"], "p": pa.array(p), "extra": pa.array(extra, mask=extra < 0)})
        yield from out.to_batches()

    return rows.mapInArrow(tidy(work), _SCHEMA)


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    alpha: float = ALPHA,
    weights: DataFrame | None = None,
    seed: int = SEED,
    bucket_units: int = BUCKET_UNITS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(doc_id, source, copies) for each unit."""
    rate = staged(rates(docs, text, source, alpha, weights).select(F.col("source").alias("_s"), "rate"))
    units = docs.select(named(doc_id).alias("doc_id"), named(source).alias("source")).distinct()
    joined = units.join(small_enough(rate), F.col("source").eqNullSafe(F.col("_s")))
    # Two hashes of its id and source stand for a unit, the same whatever the partitions are.
    text_id, text_source = F.col("doc_id").cast("string"), F.col("source").cast("string")
    key, unit = F.xxhash64(text_id, text_source, F.lit(seed)), F.xxhash64(F.lit(seed + 1), text_source, text_id)
    listed = staged(joined.select("doc_id", "source", key.alias("key"), unit.alias("unit"), F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p")))
    open_units = listed.where("p > 0")
    n = open_units.count()
    buckets = max(1, -(-n // bucket_units))
    parts = max(1, min(buckets, MOST_TASKS))
    rows = open_units.select(
        F.pmod(F.col("key"), F.lit(buckets)).alias("node"), F.col("source").cast("string").alias("source"), "unit", "key", "p"
    ).repartition(parts, "node")
    level = staged(_round_groups(rows, seed))
    decided = [level.where("extra is not null")]
    nodes = buckets
    while nodes > 1:
        nodes = -(-nodes // fan_in)
        up = level.where("extra is null").select(F.floor(F.col("node") / fan_in).cast("long").alias("node"), "source", "unit", "key", "p")
        level = staged(_round_groups(up.repartition(max(1, min(nodes, MOST_TASKS)), "node"), seed ^ nodes))
        decided.append(level.where("extra is not null"))
    last = level.where("extra is null").withColumn(
        "extra", (F.pmod(F.xxhash64(F.col("key"), F.lit(seed), F.lit("last")), F.lit(1 << 40)) < F.col("p") * float(1 << 40)).cast("tinyint")
    )
    all_decided = last
    for d in decided:
        all_decided = all_decided.unionByName(d)
    extra = all_decided.select("key", "unit", "extra")
    sure = listed.where("p <= 0").select("doc_id", "source", F.col("base").alias("copies"))
    drawn = (
        open_units.join(extra, ["key", "unit"])
        .select("doc_id", "source", (F.col("base") + F.col("extra")).cast("int").alias("copies"))
    )
    return sure.unionByName(drawn)


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The input with each row as often as its unit has copies; columns stay."""
    d, s, n, again = fresh(docs, "_d", "_s", "_n", "_again")
    copies = staged(mix(docs, doc_id, text, source, **options).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("copies").alias(n)))
    # Most units of large sources have one copy: only the others are joined.
    other = copies.where(F.col(n) != 1)
    same = named(doc_id).eqNullSafe(F.col(d)) & named(source).eqNullSafe(F.col(s))
    joined = docs.join(small_enough(other), same, "left")
    times = F.explode(F.array_repeat(F.lit(0), F.coalesce(F.col(n), F.lit(1))))
    return joined.select(*[named(c) for c in docs.columns], times.alias(again)).drop(again)
