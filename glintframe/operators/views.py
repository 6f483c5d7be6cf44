"""The tables behind plots: rescaled and thinned traces, footprint crops, region panels, and one explorer record a cell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rescale_traces(traces: DataFrame, drop_last: int = 100) -> DataFrame:
    """(cell_id, t, v) to [0, 1] by cell, without the last samples; constant traces become 0."""
    w = Window.partitionBy("cell_id")
    kept = traces.withColumn("_n", F.max("t").over(w) + 1).where((F.col("t") < F.col("_n") - drop_last) | (F.col("_n") <= drop_last))
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return kept.select("cell_id", "t", F.when(hi > lo, F.try_divide(F.col("v") - lo, hi - lo)).otherwise(0.0).alias("v"))


def percentile_clip(image: DataFrame, lo: float = 1.0, hi: float = 99.0) -> DataFrame:
    """To [0, 1] between two percentiles, cut beyond; unchanged if they are equal."""
    q = image.agg(F.percentile("v", lo / 100).alias("_a"), F.percentile("v", hi / 100).alias("_b"))
    scaled = F.least(F.greatest(F.try_divide(F.col("v") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)), F.lit(1.0))
    return image.crossJoin(F.broadcast(q)).select("r", "c", F.when(F.col("_b") > F.col("_a"), scaled).otherwise(F.col("v")).alias("v"))


def footprint_crops(footprint: DataFrame, height: int, width: int, pad: int = 2) -> DataFrame:
    """(cell_id, r0, c0, z): the weights within the box of the pixels that aren't 0, widened by pad, row by row."""
    f = footprint.where("w <> 0")
    box = f.groupBy("cell_id").agg(
        F.greatest(F.min("r") - pad, F.lit(0)).alias("r0"), F.least(F.max("r") + pad, F.lit(height - 1)).alias("r1"),
        F.greatest(F.min("c") - pad, F.lit(0)).alias("c0"), F.least(F.max("c") + pad, F.lit(width - 1)).alias("c1"),
        F.map_from_entries(F.collect_list(F.struct((F.col("r") * width + F.col("c")).alias("k"), F.round("w", 4).alias("v")))).alias("m"),
    )
    z = F.transform(F.sequence("r0", "r1"), lambda r: F.transform(F.sequence("c0", "c1"), lambda c: F.coalesce(F.element_at("m", r * width + c), F.lit(0.0))))
    return box.select("cell_id", "r0", "c0", z.alias("z"))


def region_panels(footprint: DataFrame, props: DataFrame) -> DataFrame:
    """(cell_id, region_id, footprint_diameter, region_diameter): the region under most pixels; diameters of circles
    of the area above half the largest weight, and of the region's area."""
    from glintframe.operators.relational import majority_region

    top = Window.partitionBy("cell_id")
    core = footprint.withColumn("_m", F.max("w").over(top)).where("_m > 0").groupBy("cell_id").agg(F.count(F.when(F.col("w") >= 0.5 * F.col("_m"), 1)).alias("n"))
    pixels = props.select("region_id", F.explode("pixels").alias("p")).select("region_id", (F.col("p.row") - 1).alias("r"), (F.col("p.col") - 1).alias("c"))
    own = majority_region(footprint.where("w > 0"), pixels).join(props.select("region_id", "area"), "region_id")
    d = lambda a: F.round(2 * F.sqrt(F.col(a) / math.pi), 2)
    return core.join(own, "cell_id", "left").select("cell_id", "region_id", d("n").alias("footprint_diameter"), d("area").alias("region_diameter"))


def explorer(traces: DataFrame, metrics: DataFrame, crops: DataFrame, panels: DataFrame, fps: float, drop_last: int = 100, max_points: int = 3500) -> DataFrame:
    """(cell_id, json): one record for each cell with times, thinned samples, measures, crop and diameters."""
    n = traces.agg((F.max("t") + 1).alias("_n"))
    end = F.when(F.col("_n") > drop_last, F.col("_n") - drop_last).otherwise(F.col("_n"))
    kept = traces.crossJoin(F.broadcast(n)).withColumn("_e", end).withColumn("_s", F.greatest(F.ceil(F.col("_e") / max_points), F.lit(1))).where("t < _e and t % _s = 0")
    y = F.array_sort(F.collect_list(F.struct("t", "v")))
    s = kept.groupBy("cell_id").agg(y.alias("_y")).select("cell_id", F.transform("_y", lambda x: F.round(x["t"] / fps, 4)).alias("t"), F.transform("_y", lambda x: F.round(x["v"], 3)).alias("Y"))
    m = metrics.select("cell_id", *[F.round(a, 6).alias(b) for a, b in (("noise_sigma", "ns"), ("snr_median", "sm"), ("spectral_hf_snr", "sh"))], F.col("n_spikes").alias("nsp"))
    out = s.join(m, "cell_id", "left").join(crops, "cell_id", "left").join(panels, "cell_id", "left")
    return out.select("cell_id", F.to_json(F.struct(*[c for c in out.columns if c != "cell_id"])).alias("json"))
