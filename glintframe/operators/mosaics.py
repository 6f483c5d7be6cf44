"""Stage orientation and mosaics from tiles (tile, r, c, v) and their stage positions (tile, x_pos, y_pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import relational as rel

Axes = tuple[int, int, bool]


def stage_affine(px: float, axes: Axes, row_min: float, col_min: float, size: int) -> list[list[float]]:
    """Matrix from stage to the mosaic's (x, y) of a tile's centre."""
    sx, sy, swap = axes
    a, b = sx / px, sy / px
    half = (size - 1) / 2
    return [[0.0, a, half - col_min] if swap else [a, 0.0, half - col_min], [b, 0.0, half - row_min] if swap else [0.0, b, half - row_min], [0, 0, 1]]


def build_mosaic(tiles: DataFrame, meta: DataFrame, px: float, size: int, axes: Axes, integer: bool = True) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """The averaged mosaic, the offsets of the tiles that have pixels, and the stage's matrix.

    All positions set the origin, also those of tiles without pixels.
    """
    r, c = rel.stage_rc(F.col("x_pos"), F.col("y_pos"), px, axes)
    low = meta.agg(F.min(r), F.min(c)).first()
    offsets = rel.tile_offsets(meta, px, axes).join(tiles.select("tile").distinct(), "tile", "left_semi")
    return rel.mosaic_average(tiles, offsets, integer), offsets, stage_affine(px, axes, low[0], low[1], size)


def affine_residual(meta: DataFrame, offsets: DataFrame, m: list[list[float]], size: int) -> DataFrame:
    """One row: the largest distance, on either axis, of a placed tile's centre from where the matrix puts it."""
    half = (size - 1) / 2
    at = rel.apply_affine(meta, m, "x_pos", "y_pos").join(offsets, "tile")
    d = F.greatest(F.abs(F.col("x_out") - F.col("col0") - half), F.abs(F.col("y_out") - F.col("row0") - half))
    return at.agg(F.max(d).alias("residual"))


def orientation_scores(tiles: DataFrame, meta: DataFrame, px: float, size: int, ds: int = 16, n_pairs: int = 6, bins: int = 180) -> DataFrame:
    """(ordinal, sx, sy, swap, roughness, ncc) of the eight orientations: how ragged the whole well's rim is, and how
    neighbouring tiles agree where they overlap. Tiles are downscaled once for all."""
    from glintframe.sources.shared import checkpointed

    small = tiles.groupBy("tile", F.floor(F.col("r") / ds).cast("int").alias("r"), F.floor(F.col("c") / ds).cast("int").alias("c")).agg((F.sum("v") / (ds * ds)).alias("v"))
    small = checkpointed(small)
    present = meta.join(small.select("tile").distinct(), "tile", "left_semi")
    xy = present.select(F.col("tile").alias("id"), F.col("x_pos").alias("x"), F.col("y_pos").alias("y"))
    pairs = rel.neighbour_pairs(xy, n_pairs, px * size) if present.count() > 1 else None
    spark, rows = tiles.sparkSession, None
    for k, axes in enumerate(rel.AXES):
        r, c = rel.stage_rc(F.col("x_pos"), F.col("y_pos"), px, axes)
        at = present.select("tile", r.alias("_r"), c.alias("_c"))
        low = at.agg(F.min("_r").alias("_r0"), F.min("_c").alias("_c0"))
        off = at.crossJoin(F.broadcast(low)).select("tile", F.rint((F.col("_r") - F.col("_r0")) / ds).cast("int").alias("row0"), F.rint((F.col("_c") - F.col("_c0")) / ds).cast("int").alias("col0"))
        one = rel.roughness(rel.mosaic_average(small, off, integer=False), bins).select(F.lit(k).alias("ordinal"), F.lit(axes[0]).alias("sx"), F.lit(axes[1]).alias("sy"), F.lit(axes[2]).alias("swap"), "roughness")
        rows = one if rows is None else rows.unionAll(one)
    if pairs is None:
        return rows.withColumn("ncc", F.lit(None).cast("double"))
    hyp = F.broadcast(spark.createDataFrame([(k, *a) for k, a in enumerate(rel.AXES)], "ordinal int, sx int, sy int, swap boolean"))
    a = pairs.select(F.col("id").alias("a"), F.col("other").alias("b"))
    pos = lambda n: present.select(F.col("tile").alias(n), F.col("x_pos").alias(f"x{n}"), F.col("y_pos").alias(f"y{n}"))
    d = a.join(pos("a"), "a").join(pos("b"), "b").crossJoin(hyp)
    dx, dy = (F.col("xb") - F.col("xa")) / px, (F.col("yb") - F.col("ya")) / px
    shift = d.select("ordinal", "a", "b", F.rint(F.col("sy") * F.when(F.col("swap"), dx).otherwise(dy)).cast("int").alias("dr"), F.rint(F.col("sx") * F.when(F.col("swap"), dy).otherwise(dx)).cast("int").alias("dc"))
    area = F.greatest(size - F.abs("dr"), F.lit(0)) * F.greatest(size - F.abs("dc"), F.lit(0))
    shift = shift.where(area >= 0.03 * size * size)
    left = tiles.select(F.col("tile").alias("a"), "r", "c", F.col("v").alias("va"))
    right = tiles.select(F.col("tile").alias("b"), "r", "c", F.col("v").alias("vb")).join(shift, "b").select("ordinal", "a", "b", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "vb")
    score = rel.ncc(right.join(left, ["a", "r", "c"]), ["ordinal", "a", "b"], "va", "vb").where("ncc > -1").groupBy("ordinal").agg(F.avg("ncc").alias("ncc"))
    return rows.join(score, "ordinal", "left")


def recover_axes(scores: DataFrame, n_tiles: int) -> Axes:
    """The orientation of the least ragged well, the first on ties; the best agreement if no rim was found; plain
    under four tiles."""
    if n_tiles < 4:
        return (1, 1, False)
    best = scores.orderBy("roughness", "ordinal").first()
    if best["roughness"] == float("inf"):
        agreed = scores.where(F.col("ncc").isNotNull()).orderBy(F.col("ncc").desc(), "ordinal").first()
        best = agreed or best
    return best["sx"], best["sy"], best["swap"]


def anchor_methods(ch: DataFrame, stain: DataFrame) -> dict[str, DataFrame]:
    """The anchor images (r, c, v) of each single-cycle method, lazily."""
    return {"raw": ch, "winsorize": rel.winsorise(ch), "log": rel.log_anchor(ch), "stain": rel.down_weight(ch, stain)}


def compare_methods(fovs: DataFrame, anchors: dict[str, DataFrame], f: int, scales: tuple[float, ...]) -> DataFrame:
    """(method, op, margin, mean_ncc, scale_cv): for each anchor image the best operation of the first field, its lead
    over the second best, and over all fields the mean score and the variation of the scale."""
    from glintframe.operators import registration as rg

    out, spark = [], fovs.sparkSession
    first = fovs.orderBy("fov").limit(1)
    for name, img in anchors.items():
        small = rg.small_mosaic(img, f)
        ranked = rg.recover_dihedral(first, small, f, scales).take(2)
        s = rg.localize(fovs, small, f, (ranked[0]["op"],), scales).agg(F.avg("ncc"), F.stddev_pop("scale") / (F.avg("scale") + 1e-9)).first()
        out.append((name, ranked[0]["op"], ranked[0]["ncc"] - ranked[1]["ncc"], s[0], s[1]))
    return spark.createDataFrame(out, "method string, op string, margin double, mean_ncc double, scale_cv double")
