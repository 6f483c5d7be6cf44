"""Queries on two movies at once, in frame arrays: the lines of even and odd suppliers are two fields of view, part
numbers give the columns. The SQL is that of one movie, once for each field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import frames as fr
from glintframe.plans import movie_queries as mq
from glintframe.plans.catalog import register
from glintframe.sources.shared import checkpointed

H, W, FIELDS = 7, 100, 2
RANGES = mq.RANGES


def _sql(head: str, columns: str, tail: str) -> str:
    """A query of one movie on each field."""
    parts = []
    for k in range(FIELDS):
        one = head.replace("l_quantity::INT - 1 AS c", f"l_partkey::INT % {W} AS c").replace("FROM lineitem GROUP", f"FROM lineitem WHERE l_suppkey % {FIELDS} = {k} GROUP").replace(f"{mq.W} - 2", f"{W} - 2")
        parts.append(f"SELECT * FROM (WITH {one} SELECT {k}::INT AS fov, {columns} FROM {tail})")
    return " UNION ALL ".join(parts)


def fields(spark: SparkSession, sf: str, fov: Column | None = None) -> DataFrame:
    """(fov, t, px) of the lines; missing pixels are 0."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    fov = (F.col("l_suppkey") % FIELDS).cast("int") if fov is None else fov
    cell = li.groupBy(
        fov.alias("fov"), ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int").alias("t"), ((F.col("l_linenumber") - 1) * W + F.col("l_partkey") % W).cast("int").alias("i")
    ).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("v"))
    rows = cell.groupBy("fov", "t").agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))

    def dense(batches):
        for pdf in batches:
            px = np.zeros((len(pdf), H * W))
            for k, (i, v) in enumerate(zip(pdf["i"], pdf["v"], strict=True)):
                px[k, i] = v
            yield pd.DataFrame({"fov": pdf["fov"], "t": pdf["t"], "px": list(px)})

    return rows.mapInPandas(dense, "fov int, t int, px array<double>")


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@register("fields_movie", _sql(mq.MOVIE, "t, r, c, v", "g"))
def fields_movie(spark: SparkSession, sf: str) -> DataFrame:
    return fr.to_long(fields(spark, sf), W)


@register("fields_reference", _sql(mq._CORR, "r, c, round(i.v, 6) AS mean, round(greatest(corr.v, 0) / (SELECT max(greatest(v, 0)) FROM corr), 8) AS corr, round(i.v * greatest(corr.v, 0) / (SELECT max(greatest(v, 0)) FROM corr), 3) AS reference", "corr JOIN i USING (r, c)"))
def fields_reference(spark: SparkSession, sf: str) -> DataFrame:
    images = fr.images_to_long(fr.reference_images(fields(spark, sf), H, W), W, "mean", "corr", "reference")
    return _rounded(_rounded(_rounded(images, 6, "mean"), 8, "corr"), 3, "reference")


@register("fields_motion", _sql(mq._MOTION, "t, r, c, round(v - gx * dx - gy * dy, 4) AS v", "g JOIN d USING (r, c) JOIN h USING (t)"))
def fields_motion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(fr.to_long(fr.motion_correct(fields(spark, sf), H, W), W), 4, "v")


@register("fields_background", _sql(mq._BACKGROUND, f"g.t, g.r, g.c, {mq._LESS}", mq._BACKGROUND_FROM).replace(", 8) AS v", ", 6) AS v"))
def fields_background(spark: SparkSession, sf: str) -> DataFrame:
    movie = fields(spark, sf)
    return _rounded(fr.to_long(fr.subtract_background(movie, fr.range_means(movie, RANGES), RANGES), W), 6, "v")


@register("fields_filter", _sql(mq._FILTERED, "t, r, c, round(v, 6) AS v", "f"))
def fields_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(fr.blocks_to_long(fr.filtered_blocks(fields(spark, sf), block=256), W, 256), 6, "v")


@register(
    "fields_noise",
    _sql(f"{mq._FILTERED}, {mq._SPANS}, q AS (SELECT r, c, 1.4826e0 * mad(v) AS s FROM f JOIN s ON t + 1 BETWEEN a AND b GROUP BY r, c)", "r, c, CASE WHEN (SELECT max(s) FROM q) > 0 THEN round(greatest(s, (SELECT quantile_cont(s, 0.05) FROM q WHERE s > 0)), 7) ELSE 1 END AS v", "q"),
)
def fields_noise(spark: SparkSession, sf: str) -> DataFrame:
    noise = fr.noise_blocks(fr.filtered_blocks(fields(spark, sf), block=256), RANGES)
    return _rounded(fr.blocks_to_long(noise, W, 256), 7, "v")


@register("fields_process")
def fields_process(spark: SparkSession, sf: str) -> DataFrame:
    """Background, motion, saturation and the temporal filter of as many fields as there are tens of suppliers."""
    movie = checkpointed(fields(spark, sf, F.floor((F.col("l_suppkey") - 1) / 10).cast("int")))
    return fr.process(movie, H, W, RANGES, mq.CLIP, block=256)
