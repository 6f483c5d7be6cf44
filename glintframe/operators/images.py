"""Image operators on the long form (r, c, v), complete grids: stencils, box means, grey opening, segmentation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stencil = list[tuple[int, int, float]]


def laplacian_stencil(alpha: float = 0.2) -> Stencil:
    d = alpha + 1
    return [(i, j, (-4.0 if not (i or j) else alpha if i and j else 1 - alpha) / d) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def gaussian_stencil(sigma: float) -> Stencil:
    """Radius ceil(2 sigma); weights sum to 1."""
    n = math.ceil(2 * sigma)
    k = [(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-n, n + 1) for j in range(-n, n + 1)]
    total = sum(w for *_, w in k)
    return [(i, j, w / total) for i, j, w in k]


def octagon(radius: int) -> list[tuple[int, int]]:
    """Places within the square of radius - 1 and the diamond of 4/3 radius."""
    n, b = radius - 1, round(radius * 4 / 3)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if abs(i) + abs(j) <= b]


def dog_kernel(sigma1: float = 1.0, sigma2: float = 3.0, width: int = 19) -> list[float]:
    """Difference of two Gaussians of equal area (trapezoids), scaled to a largest value of 1."""
    c = (1 + width) / 2
    g1, g2 = ([math.exp(-((x - c) ** 2) / (2 * s * s)) for x in range(1, width + 1)] for s in (sigma1, sigma2))
    area = lambda g: sum(g) - (g[0] + g[-1]) / 2
    d = [a - area(g1) / area(g2) * b for a, b in zip(g1, g2, strict=True)]
    return [x / max(d) for x in d]


def _clamp(x: Column, n: int) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))


def _reflect(x: Column, n: int) -> Column:
    """Mirror with the edge repeated, as often as needed."""
    m = F.pmod(x, F.lit(2 * n))
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def correlate(image: DataFrame, stencil: Stencil, height: int, width: int) -> DataFrame:
    """Weighted sum of neighbours, the border repeated outwards.

    Each pixel is sent to the places that it counts for: its weights for one place are summed before the shuffle.
    """
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in stencil])
    # Places r with clamp(r + i) = this row: r - i, and at a border all r beyond it.
    n = max(max(abs(i), abs(j)) for i, j, _ in stencil)
    pad = F.sequence(F.lit(-n), F.lit(n))
    row = F.filter(F.transform(pad, lambda k: F.col("r") + k), lambda x: ((F.col("r") == 0) & (x < 0)) | ((F.col("r") == height - 1) & (x >= height)) | (x == F.col("r")))
    col = F.filter(F.transform(pad, lambda k: F.col("c") + k), lambda x: ((F.col("c") == 0) & (x < 0)) | ((F.col("c") == width - 1) & (x >= width)) | (x == F.col("c")))
    spread = image.select("v", F.explode(row).alias("_r"), "c").select("v", "_r", F.explode(col).alias("_c"))
    sent = spread.select("v", "_r", "_c", F.explode(offsets).alias("o")).select((F.col("_r") - F.col("o.i")).alias("r"), (F.col("_c") - F.col("o.j")).alias("c"), (F.col("v") * F.col("o.w")).alias("v"))
    inside = F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)
    return sent.where(inside).groupBy("r", "c").agg(F.sum("v").alias("v"))


def box_mean(image: DataFrame, height: int, width: int, size_r: int, size_c: int) -> DataFrame:
    """Mean over a window of odd size, the border repeated; rows, then columns, each by a sliding window."""

    def along(df: DataFrame, by: str, other: str, n: int, size: int) -> DataFrame:
        k = size // 2
        w = Window.partitionBy(other).orderBy(by)
        first, last = F.first("v").over(Window.partitionBy(other).orderBy(by)), F.last("v").over(w.rowsBetween(0, Window.unboundedFollowing))
        inner = F.sum("v").over(w.rowsBetween(-k, k))
        lack_a, lack_b = F.greatest(k - F.col(by), F.lit(0)), F.greatest(F.col(by) + k - (n - 1), F.lit(0))
        return df.select("r", "c", ((inner + lack_a * first + lack_b * last) / size).alias("v"))

    return along(along(image, "c", "r", width, size_c), "r", "c", height, size_r)


def _extreme(image: DataFrame, se: list[tuple[int, int]], height: int, width: int, least: bool) -> DataFrame:
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in se])
    need = image.select("r", "c", F.explode(offsets).alias("o")).select(
        F.col("r").alias("_r"), F.col("c").alias("_c"), _reflect(F.col("r") + F.col("o.i"), height).cast("int").alias("r"), _reflect(F.col("c") + F.col("o.j"), width).cast("int").alias("c")
    )
    f = F.min("v") if least else F.max("v")
    return need.join(image, ["r", "c"]).groupBy(F.col("_r").alias("r"), F.col("_c").alias("c")).agg(f.alias("v"))


def grey_opening(image: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Smallest, then largest value over the octagon, borders mirrored. For small radii; see kernels for large ones."""
    se = octagon(radius)
    return _extreme(_extreme(image, se, height, width, True), se, height, width, False)


def normalise(image: DataFrame) -> DataFrame:
    """To [0, 1] by the smallest and largest value; a constant image becomes 0."""
    s = image.agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    return image.crossJoin(F.broadcast(s)).select("r", "c", F.when(F.col("_b") > F.col("_a"), (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0).alias("v"))


def adaptive_threshold(image: DataFrame, height: int, width: int, scale: float = 1.5) -> DataFrame:
    """1.5 times the local mean over 2 * (size // 16) + 1 pixels a side."""
    return box_mean(image, height, width, 2 * (height // 16) + 1, 2 * (width // 16) + 1).select("r", "c", (F.col("v") * scale).alias("v"))


def binarise(image: DataFrame, height: int, width: int, sigma: float = 0.1) -> DataFrame:
    """Pixels above the local threshold of the smoothed image; the image compared is not smoothed."""
    n = normalise(image)
    thr = adaptive_threshold(correlate(n, gaussian_stencil(sigma), height, width), height, width).withColumnRenamed("v", "_t")
    return n.join(thr, ["r", "c"]).where("v > _t").select("r", "c")


def components(pixels: DataFrame, width: int) -> DataFrame:
    """8-connected components of (r, c): (r, c, label), the label being the smallest r * width + c.

    Rows are cut into runs of neighbouring pixels by one window; only runs that touch are linked, and the links'
    components are found by alternating large and small stars, which takes few rounds on long shapes. Rounds are
    cut by reliable checkpoints.
    """
    from glintframe.sources.shared import checkpointed

    w = Window.partitionBy("r").orderBy("c")
    run = F.sum(F.when(F.col("c") - F.lag("c").over(w) == 1, 0).otherwise(1)).over(w)
    numbered = checkpointed(pixels.select("r", "c", run.alias("k")))
    runs = numbered.groupBy("r", "k").agg(F.min("c").alias("a"), F.max("c").alias("b")).withColumn("id", (F.col("r") * width + F.col("a")).cast("long"))
    up = runs.select((F.col("r") + 1).alias("r"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("v"))
    links = runs.join(up, "r").where("a <= b2 + 1 and a2 <= b + 1").select(F.col("id").alias("u"), "v")
    label = connected(links).withColumnRenamed("u", "id")
    named = runs.join(label, "id", "left").select("r", "k", F.coalesce("m", "id").alias("label"))
    return numbered.join(named, ["r", "k"]).select("r", "c", "label")


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, m) for every node of the links (u, v) that isn't its component's smallest, m: that smallest node."""
    from glintframe.sources.shared import checkpointed

    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        edges = checkpointed(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select("u", F.col("v").alias("m"))
        last = now
    raise RuntimeError("components did not settle")


def region_props(labels: DataFrame, min_area: int = 1) -> DataFrame:
    """One row for each component of at least min_area pixels: region_id in order of the first pixel, area, centroid
    and box as [col, row] from 1, the box corner half a pixel out, and the pixels by column, then row."""
    g = labels.groupBy("label").agg(
        F.count("*").alias("area"),
        (F.avg("c") + 1).alias("cx"),
        (F.avg("r") + 1).alias("cy"),
        (F.min("c") + 0.5).cast("double").alias("x_ul"),
        (F.min("r") + 0.5).cast("double").alias("y_ul"),
        (F.max("c") - F.min("c") + 1).alias("w"),
        (F.max("r") - F.min("r") + 1).alias("h"),
        F.array_sort(F.collect_list(F.struct((F.col("c") + 1).alias("col"), (F.col("r") + 1).alias("row")))).alias("pixels"),
    )
    big = g.where(F.col("area") >= min_area)
    # Regions are few beside pixels: their ids are ranks in one small partition.
    return big.select((F.row_number().over(Window.orderBy("label")) - 1).alias("region_id"), *[c for c in big.columns if c != "label"])


def compute_patch(regions: DataFrame, patch_rows: int, patch_cols: int, height: int, width: int) -> DataFrame:
    """1-based inclusive row0, row1, col0, col1 of each region's patch: a fixed size or its box, within the image."""
    lo = lambda c, p, u: F.greatest(F.least(F.floor(F.col(c) - p * 0.5), F.floor(F.col(u) + 0.5)), F.lit(1))
    hi = lambda c, p, u, s, n: F.least(F.greatest(F.floor(F.col(c) + p * 0.5), F.floor(F.col(u) + 0.5 + F.col(s))), F.lit(n))
    # Rows take the second size, columns the first.
    return regions.select(
        "region_id",
        lo("cy", patch_cols, "y_ul").cast("int").alias("row0"), hi("cy", patch_cols, "y_ul", "h", height).cast("int").alias("row1"),
        lo("cx", patch_rows, "x_ul").cast("int").alias("col0"), hi("cx", patch_rows, "x_ul", "w", width).cast("int").alias("col1"),
    )


def sharpen(image: DataFrame, height: int, width: int, disk_radius: int = 15, sigma: float = 1.75, alpha: float = 0.2, k: float = 2.25) -> DataFrame:
    """(r, c, bkg, i2, blurred, log, log_norm, sharpened): opening, Gaussian, Laplacian, and the image less k times
    the Laplacian scaled to the image's standard deviation."""
    from glintframe.operators.blocks import opening_kernel

    bkg = opening_kernel(image, disk_radius, height, width).withColumnRenamed("v", "bkg")
    i2 = image.join(bkg, ["r", "c"]).select("r", "c", "bkg", (F.col("v") - F.col("bkg")).alias("i2"))
    blurred = correlate(i2.select("r", "c", F.col("i2").alias("v")), gaussian_stencil(sigma), height, width)
    log = correlate(blurred, laplacian_stencil(alpha), height, width).withColumnRenamed("v", "log")
    s = log.agg(F.max(F.abs("log")).alias("_m")).crossJoin(i2.agg(F.stddev_samp("i2").alias("_s")))
    norm = F.when(F.col("_m") > 0, F.col("log") / F.col("_m") * F.col("_s")).otherwise(0.0)
    joined = i2.join(blurred.withColumnRenamed("v", "blurred"), ["r", "c"]).join(log, ["r", "c"]).crossJoin(F.broadcast(s)).withColumn("log_norm", norm)
    return joined.select("r", "c", "bkg", "i2", "blurred", "log", "log_norm", (F.col("i2") - k * F.col("log_norm")).alias("sharpened"))
