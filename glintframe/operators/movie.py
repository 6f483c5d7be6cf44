"""Movie operators on the long form: one row (t, r, c, v) for each frame and pixel, all 0-based.

Sums over time are partial aggregates by pixel; sums over a frame are partial aggregates by frame. Images are the
small side of every join with a movie.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = sys.float_info.epsilon
Ranges = tuple[tuple[int, int], ...]


def truncate_last(movie: DataFrame, n: int) -> DataFrame:
    last = movie.agg((F.max("t") - n).alias("_last"))
    return movie.crossJoin(F.broadcast(last)).where("t <= _last").drop("_last")


def first_frames(movie: DataFrame, n: int) -> DataFrame:
    return movie.where(F.col("t") < n)


def clip_saturation(movie: DataFrame, threshold: float) -> DataFrame:
    return movie.withColumn("v", F.when(F.col("v") > threshold, 0.0).otherwise(F.col("v")))


def mean_image(movie: DataFrame) -> DataFrame:
    return movie.groupBy("r", "c").agg(F.avg("v").alias("v"))


def range_table(movie: DataFrame, ranges: Ranges) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(ranges)]
    return movie.sparkSession.createDataFrame(rows, "range_id int, a int, b int")


def range_means(movie: DataFrame, ranges: Ranges) -> DataFrame:
    """Mean image of each 1-based inclusive range: (range_id, r, c, v). Frames in several ranges count in each."""
    spans = F.broadcast(range_table(movie, ranges))
    return movie.join(spans, (F.col("t") + 1).between(F.col("a"), F.col("b"))).groupBy("range_id", "r", "c").agg(F.avg("v").alias("v"))


def anchors(ranges: Ranges) -> list[float]:
    """Middle frames of the ranges, 1-based, halves rounded up."""
    return [float(int((a + b) / 2 + 0.5)) for a, b in ranges]


def background_weights(t: Column, at: list[float]) -> tuple[Column, Column, Column]:
    """Anchor before and after the 0-based frame, and the weight of the latter; clamped at both ends."""
    f, n = (t + 1).cast("double"), len(at)
    before, after, weight = F.lit(n - 1), F.lit(n - 1), F.lit(0.0)
    for k in range(n - 2, -1, -1):
        here = f < at[k + 1]
        before = F.when(here, F.lit(k)).otherwise(before)
        after = F.when(here, F.lit(k + 1)).otherwise(after)
        weight = F.when(here, (f - at[k]) / (at[k + 1] - at[k])).otherwise(weight)
    first = f <= at[0]
    return F.when(first, 0).otherwise(before), F.when(first, 0).otherwise(after), F.when(first, 0.0).otherwise(weight)


def subtract_background(movie: DataFrame, samples: DataFrame, ranges: Ranges) -> DataFrame:
    """Subtract the samples (range_id, r, c, v), interpolated between the ranges' middle frames.

    Samples become one row of values per pixel, so the movie is joined once and no background movie is built.
    """
    at = anchors(ranges)
    wide = samples.groupBy("r", "c").pivot("range_id", list(range(len(at)))).agg(F.first("v"))
    wide = wide.select("r", "c", F.array(*[F.col(str(k)) for k in range(len(at))]).alias("_b"))
    before, after, weight = background_weights(F.col("t"), at)
    value = (1 - weight) * F.get("_b", before) + weight * F.get("_b", after)
    return movie.join(wide, ["r", "c"]).select("t", "r", "c", (F.col("v") - value).alias("v"))


def gradients(image: DataFrame) -> DataFrame:
    """(r, c, gx, gy): central differences; edges take their neighbour's."""
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    g = image.select("r", "c", ((F.lead("v").over(row) - F.lag("v").over(row)) / 2).alias("gx"), ((F.lead("v").over(col) - F.lag("v").over(col)) / 2).alias("gy"))
    pick = lambda n, w: F.coalesce(F.col(n), F.lead(n).over(w), F.lag(n).over(w))
    return g.select("r", "c", pick("gx", row).alias("gx"), pick("gy", col).alias("gy"))


def motion_shifts(movie: DataFrame, truncate: int = 10) -> tuple[DataFrame, DataFrame]:
    """Least-squares shift of each frame along the gradients of the mean image, (t, dx, dy), and the gradients.

    Normal equations: three sums over the image once, two for each frame. A singular system gets the solution of
    least norm.
    """
    g = gradients(mean_image(truncate_last(movie, truncate)))
    a = g.agg(F.sum(F.col("gx") * F.col("gx")).alias("xx"), F.sum(F.col("gx") * F.col("gy")).alias("xy"), F.sum(F.col("gy") * F.col("gy")).alias("yy"))
    b = movie.join(g, ["r", "c"]).groupBy("t").agg(F.sum(F.col("gx") * F.col("v")).alias("bx"), F.sum(F.col("gy") * F.col("v")).alias("by"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    trace2 = F.pow(F.col("xx") + F.col("yy"), 2)
    full = det > trace2 * 1e-15
    # A of rank 1 is A = trace * u u', so its pseudoinverse is A / trace**2.
    dx = F.when(full, (F.col("yy") * F.col("bx") - F.col("xy") * F.col("by")) / det).when(trace2 > 0, (F.col("xx") * F.col("bx") + F.col("xy") * F.col("by")) / trace2)
    dy = F.when(full, (F.col("xx") * F.col("by") - F.col("xy") * F.col("bx")) / det).when(trace2 > 0, (F.col("xy") * F.col("bx") + F.col("yy") * F.col("by")) / trace2)
    return b.crossJoin(F.broadcast(a)).select("t", F.coalesce(dx, F.lit(0.0)).alias("dx"), F.coalesce(dy, F.lit(0.0)).alias("dy")), g


def motion_correct(movie: DataFrame, truncate: int = 10) -> DataFrame:
    """The movie less each frame's fit."""
    shifts, g = motion_shifts(movie, truncate)
    return movie.join(g, ["r", "c"]).join(shifts, "t").select("t", "r", "c", (F.col("v") - F.col("gx") * F.col("dx") - F.col("gy") * F.col("dy")).alias("v"))


def correlation_image(movie: DataFrame, width: int, eps: float = EPS) -> DataFrame:
    """Mean correlation of each inner pixel with its four neighbours; 0 at borders and for constant pixels.

    One window by frame, in row-major order, puts the right and the lower neighbour beside each sample (the movie is
    a full grid of this width). All correlations then come from sums by pixel; values are shifted by the pixel's
    mean first, which keeps the sums exact.
    """
    m = movie.join(mean_image(movie).withColumnRenamed("v", "_m"), ["r", "c"]).select("t", "r", "c", (F.col("v") - F.col("_m")).alias("v"))
    w = Window.partitionBy("t").orderBy("r", "c")
    m = m.withColumn("_x", F.lead("v", 1).over(w)).withColumn("_y", F.lead("v", width).over(w))
    s = m.groupBy("r", "c").agg(F.sum(F.col("v") * F.col("v")).alias("n2"), F.sum(F.col("v") * F.col("_x")).alias("x"), F.sum(F.col("v") * F.col("_y")).alias("y"))
    s = s.withColumn("n", F.sqrt("n2"))
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    pair = lambda dot, w: F.col(dot) / (F.col("n") * F.lead("n").over(w) + eps)
    s = s.withColumn("right", pair("x", row)).withColumn("down", pair("y", col))
    s = s.withColumn("left", F.lag("right").over(row)).withColumn("up", F.lag("down").over(col))
    four = (F.col("up") + F.col("down") + F.col("left") + F.col("right")) / 4
    return s.select("r", "c", F.when(F.col("n") > 0, F.coalesce(four, F.lit(0.0))).otherwise(0.0).alias("v"))


def reference_image(movie: DataFrame, width: int) -> DataFrame:
    """(r, c, v, corr): mean times the correlation image, which is cut at 0 and divided by its largest value."""
    corr = correlation_image(movie, width).select("r", "c", F.greatest("v", F.lit(0.0)).alias("corr"))
    top = corr.agg(F.max("corr").alias("_top"))
    corr = corr.crossJoin(F.broadcast(top)).select("r", "c", F.coalesce(F.try_divide("corr", "_top"), F.lit(0.0)).alias("corr"))
    return mean_image(movie).join(corr, ["r", "c"]).select("r", "c", (F.col("v") * F.col("corr")).alias("v"), "corr")


def temporal_filter(movie: DataFrame, window: int = 8) -> DataFrame:
    """Moving median of each pixel less the sample."""
    before = window // 2
    w = Window.partitionBy("r", "c").orderBy("t").rowsBetween(-before, window - 1 - before)
    return movie.select("t", "r", "c", (F.percentile("v", 0.5).over(w) - F.col("v")).alias("v"))


def pixel_noise_map(filtered: DataFrame, ranges: Ranges, floor_pct: float = 5.0) -> DataFrame:
    """Robust sigma of each pixel on the ranges, at least the floor percentile of the positive ones; 1 if none is."""
    spans = F.broadcast(range_table(filtered, ranges))
    base = filtered.join(spans, (F.col("t") + 1).between(F.col("a"), F.col("b"))).select("r", "c", "v")
    med = base.groupBy("r", "c").agg(F.percentile("v", 0.5).alias("_m"))
    sigma = base.join(med, ["r", "c"]).groupBy("r", "c").agg((F.percentile(F.abs(F.col("v") - F.col("_m")), 0.5) * 1.4826).alias("s"))
    floor = sigma.agg(F.percentile(F.when(F.col("s") > 0, F.col("s")), floor_pct / 100).alias("_f"))
    return sigma.crossJoin(F.broadcast(floor)).select("r", "c", F.when(F.col("_f").isNull(), 1.0).otherwise(F.greatest("s", "_f")).alias("v"))


def max_projection(movie: DataFrame) -> DataFrame:
    return movie.groupBy("r", "c").agg(F.max("v").alias("v"))


def smoothness(frames: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Score of each (nrow, ncol) for flat frames (t, i, v): mean over frames of the mean correlation of horizontal
    and vertical neighbours. Higher is likelier to be the true shape."""
    shapes = F.broadcast(frames.sparkSession.createDataFrame(pairs, "nrow int, ncol int"))
    cell = frames.crossJoin(shapes)
    w = Window.partitionBy("t", "nrow", "ncol").orderBy("i")
    # A lag by ncol depends on the shape, so the vertical neighbour is found by its column's order.
    col = Window.partitionBy("t", "nrow", "ncol", F.col("i") % F.col("ncol")).orderBy("i")
    cell = cell.withColumn("_h", F.when((F.col("i") + 1) % F.col("ncol") != 0, F.lead("v").over(w))).withColumn("_v", F.lead("v").over(col))
    h, v = F.corr(F.when(F.col("_h").isNotNull(), F.col("v")), "_h"), F.corr(F.when(F.col("_v").isNotNull(), F.col("v")), "_v")
    return cell.groupBy("t", "nrow", "ncol").agg(((h + v) / 2).alias("s")).groupBy("nrow", "ncol").agg(F.avg("s").alias("score"))
