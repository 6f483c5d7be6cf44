"""Joins, placements, mosaics, neighbour pairs, fits and summaries on tables."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.kernels import space
from glintframe.kernels.arrays import signed_rank_p

GENOTYPE_PREFIXES = ("cell_barcode_", "gene_symbol_", "gene_id_")
TILE_KEYS = ("plate", "well", "tile", "cell")
#: Places that a task searches at once, and most places that the parts are laid by.
PART = 1 << 14
SAMPLE = 1 << 19


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def genotype_join(info: DataFrame, cells: DataFrame, keys: tuple[str, ...] = TILE_KEYS, prefixes: tuple[str, ...] = GENOTYPE_PREFIXES) -> DataFrame:
    """Every row of info with the columns of cells whose names begin with a prefix, null where there is no match."""
    take = [c for c in cells.columns if c.startswith(prefixes)]
    return info.join(cells.select(*keys, *take), list(keys), "left")


def with_genotype(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def place_cells(cells: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add i_mos and j_mos, the tile's offset (tile, row0, col0) plus i and j; cells of other tiles go."""
    return cells.join(offsets, "tile").select(*cells.columns, (F.col("i") + F.col("row0")).cast("double").alias("i_mos"), (F.col("j") + F.col("col0")).cast("double").alias("j_mos"))


def same_sets(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct values stand in only one of the two."""
    left, right = a.select(column).distinct(), b.select(column).distinct()
    only = left.exceptAll(right).select(F.lit("a").alias("side")).unionAll(right.exceptAll(left).select(F.lit("b").alias("side")))
    return only.agg(F.count(F.when(F.col("side") == "a", 1)).alias("only_a"), F.count(F.when(F.col("side") == "b", 1)).alias("only_b"))


def stage_rc(x: Column, y: Column, px: float, axes: tuple[int, int, bool]) -> tuple[Column, Column]:
    """Row and column in pixels of a stage position under signs and swap of the axes."""
    sx, sy, swap = axes
    a, b = (y, x) if swap else (x, y)
    return sy * b / px, sx * a / px


#: All eight of them; the sign of x changes fastest, the swap last.
AXES = [((1, -1)[k & 1], (1, -1)[k >> 1 & 1], k >= 4) for k in range(8)]


def tile_offsets(meta: DataFrame, px: float, axes: tuple[int, int, bool] = (1, 1, False)) -> DataFrame:
    """(tile, row0, col0): rounded (halves to even) distances from the smallest row and column."""
    r, c = stage_rc(F.col("x_pos"), F.col("y_pos"), px, axes)
    at = meta.select("tile", r.alias("_r"), c.alias("_c"))
    low = at.agg(F.min("_r").alias("_r0"), F.min("_c").alias("_c0"))
    return at.crossJoin(F.broadcast(low)).select("tile", F.rint(F.col("_r") - F.col("_r0")).cast("int").alias("row0"), F.rint(F.col("_c") - F.col("_c0")).cast("int").alias("col0"))


def mosaic_average(pixels: DataFrame, offsets: DataFrame, integer: bool = True) -> DataFrame:
    """Tiles (tile, r, c, v) laid at their offsets; overlaps averaged, for integer output cut to whole numbers."""
    v = F.avg("v")
    placed = pixels.join(offsets, "tile").select((F.col("r") + F.col("row0")).alias("r"), (F.col("c") + F.col("col0")).alias("c"), "v")
    return placed.groupBy("r", "c").agg((F.floor(v).cast("int") if integer else v).alias("v"))


def block_downscale(image: DataFrame, f: int) -> DataFrame:
    """Means of f by f blocks; what lacks at the far edges counts as 0."""
    if f == 1:
        return image.select("r", "c", F.col("v").cast("double").alias("v"))
    return image.groupBy(F.floor(F.col("r") / f).cast("int").alias("r"), F.floor(F.col("c") / f).cast("int").alias("c")).agg((F.sum("v") / (f * f)).alias("v"))


def ncc(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Correlation of the finite pairs of each key; -1 for under 16 pairs or a constant side."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))
    x, y = F.when(ok, F.col(a)), F.when(ok, F.col(b))
    n = F.count(F.when(ok, 1))
    return pairs.groupBy(*keys).agg(F.when(n < 16, -1.0).otherwise(F.coalesce(F.nanvl(F.corr(x, y), F.lit(-1.0)), F.lit(-1.0))).alias("ncc"))


def overlap_ncc(image_a: DataFrame, image_b: DataFrame, shifts: DataFrame, size: int, min_frac: float = 0.03) -> DataFrame:
    """(dr, dc, ncc) for square images of this size, b lying (dr, dc) from a; -1 for too small an overlap."""
    at = shifts.select(F.rint("dr").cast("int").alias("dr"), F.rint("dc").cast("int").alias("dc")).distinct()
    area = F.greatest(size - F.abs("dr"), F.lit(0)) * F.greatest(size - F.abs("dc"), F.lit(0))
    sent = image_b.crossJoin(F.broadcast(at)).select("dr", "dc", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), F.col("v").alias("b"))
    both = sent.join(image_a.select("r", "c", F.col("v").alias("a")), ["r", "c"])
    score = ncc(both, ["dr", "dc"])
    return at.join(score, ["dr", "dc"], "left").select("dr", "dc", F.when(area < min_frac * size * size, -1.0).otherwise(F.coalesce("ncc", F.lit(-1.0))).alias("ncc"))


def nearest(points: DataFrame, cell: float | None = None, part: int = PART) -> DataFrame:
    """(id, other, d): each point's nearest other point, the smallest id on ties. Points without finite coordinates are
    left out. cell, once the width of a first grid, isn't needed.

    Points at one place are each other's nearest; each place is then searched once. The plane is halved, at medians of a
    bounded sample of the places, into parts of about so many of them, however dense they lie. A task finds the nearest
    within its part; only places whose circle of that radius leaves the part are sent to the other parts that it meets.
    """
    from glintframe.sources.shared import checkpointed

    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))
    kind = points.schema["id"].dataType.simpleString()
    pts = checkpointed(points.select("id", F.col("x").cast("double"), F.col("y").cast("double")).where(finite("x") & finite("y")))
    spots = checkpointed(pts.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n = spots.count()
    crowd = pts.join(spots.where("n > 1").select("x", "y", F.col("id").alias("first")), ["x", "y"]).where("id <> first")
    same = crowd.select("id", F.col("first").alias("other")).unionAll(crowd.groupBy("first").agg(F.min("id").alias("other"))).withColumn("d", F.lit(0.0))
    if n < 2:
        return same
    count = -(-n // part)
    share = min(64 * 1024 / part, SAMPLE / n * 1024, 1024)
    sample = spots.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)) < int(share * 1024)).select("x", "y").toPandas().to_numpy(float) if count > 1 else np.zeros((0, 2))
    nodes = space.split_plane(sample, count)

    @F.pandas_udf("int")
    def part_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(space.part_of(nodes, np.stack([x, y], 1)), dtype="int32")

    def xy(table: pa.Table) -> np.ndarray:
        return np.stack([table["x"].to_numpy(), table["y"].to_numpy()], 1)

    def within(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        p = xy(table)
        d, who = space.lowest(space.Tree(p), p, own=np.arange(len(p)))
        own = table["part"][0].as_py()
        open_ = np.flatnonzero(table["n"].to_numpy() == 1)
        rows, met = space.parts_met(nodes, p[open_], d[open_, 0])
        rows, met = rows[met != own], met[met != own]
        at = np.searchsorted(np.sort(rows), np.arange(len(open_) + 1))
        ends = np.zeros(len(p) + 1, np.int32)
        ends[open_ + 1] = np.diff(at)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(met[np.argsort(rows, kind="stable")], pa.int32()))
        other = table["id"].combine_chunks().take(pa.array(who[:, 0], mask=who[:, 0] < 0))
        return pa.table({"id": table["id"], "n": table["n"], "x": table["x"], "y": table["y"], "part": table["part"], "other": other, "d": pa.array(d[:, 0]), "met": lists})

    def beyond(sent: pa.Table, there: pa.Table) -> pa.Table:
        there = there.rename_columns({"_id": "id", "_x": "x", "_y": "y", "_part": "part"}) if there.num_rows else there
        if not sent.num_rows or not there.num_rows:
            ids = (sent if sent.num_rows else there).schema.field("id").type
            return pa.table({"id": pa.array([], ids), "other": pa.array([], ids), "d": pa.array([], pa.float64())})
        there = there.sort_by("id")
        q = xy(sent)
        # Up to the distance found, itself included: an equal one may have a smaller id.
        d, who = space.lowest(space.Tree(xy(there)), q, bound=np.nextafter(sent["d"].to_numpy(), np.inf))
        ok = np.flatnonzero(who[:, 0] >= 0)
        return pa.table({"id": sent["id"].combine_chunks().take(pa.array(ok)), "other": there["id"].combine_chunks().take(pa.array(who[ok, 0])), "d": pa.array(d[ok, 0])})

    placed = spots.withColumn("part", part_of("x", "y"))
    first = placed.groupBy("part").applyInArrow(within, f"id {kind}, n long, x double, y double, part int, other {kind}, d double, met array<int>")
    if count == 1:
        return first.where("n = 1").select("id", "other", "d").unionAll(same)
    first = checkpointed(first)
    sent = first.where("n = 1").select("id", "x", "y", "d", F.explode("met").alias("part"))
    # Names of its own on each side: a cogroup of a table with itself loses columns else.
    there = first.select(*[F.col(c).alias(f"_{c}") for c in ("id", "x", "y", "part")])
    more = sent.groupBy("part").cogroup(there.groupBy("_part")).applyInArrow(beyond, f"id {kind}, other {kind}, d double")
    found = first.where("n = 1 and other is not null").select("id", "other", "d").unionAll(more)
    return found.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.other", "m.d").unionAll(same)


def neighbour_pairs(points: DataFrame, limit: int, cell: float) -> DataFrame:
    """Nearest neighbours within 1.3 of the median distance that lie along an axis (3 to 1), tightest first."""
    from glintframe.sources.shared import checkpointed

    near = checkpointed(nearest(points, cell))
    xy = points.select("id", "x", "y")
    pitch = near.agg(F.percentile("d", 0.5).alias("_p"))
    j = near.join(xy, "id").join(xy.select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2")), "other")
    dx, dy = F.abs(F.col("x2") - F.col("x")), F.abs(F.col("y2") - F.col("y"))
    keep = (F.col("d") <= 1.3 * F.col("_p")) & (F.greatest(dx, dy) >= 3 * F.least(dx, dy))
    return j.crossJoin(F.broadcast(pitch)).where(keep).orderBy("d", "id").limit(limit).select("id", "other", "d")


def isolated(boxes: DataFrame, cell: int = 64) -> DataFrame:
    """(id, isolated): whether a box (id, r0, r1, c0, c1), ends included, meets no other. Null boxes are empty: they
    are isolated and block none. Boxes are matched through the grid cells that they touch, not all with all."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    full = boxes.where(F.col("r0").isNotNull())
    grid = full.select("*", span("r0", "r1").alias("gr")).select("*", span("c0", "c1").alias("gc"))
    other = grid.select(*[F.col(c).alias(f"{c}_") if c not in ("gr", "gc") else F.col(c) for c in grid.columns])
    hit = grid.join(other, ["gr", "gc"]).where("id <> id_ and r0 <= r1_ and r0_ <= r1 and c0 <= c1_ and c0_ <= c1").select("id").distinct()
    return boxes.join(hit.withColumn("_hit", F.lit(True)), "id", "left").select("id", F.col("_hit").isNull().alias("isolated"))


def apply_affine(df: DataFrame, m: list[list[float]], x: str = "x", y: str = "y") -> DataFrame:
    a, b = m[0], m[1]
    return df.withColumns({"x_out": a[0] * F.col(x) + a[1] * F.col(y) + a[2], "y_out": b[0] * F.col(x) + b[1] * F.col(y) + b[2]})


def fit_similarity(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(a, b, tx, ty) of x' = a x - b y + tx, y' = b x + a y + ty by least squares over (x, y, u, v); proper
    similarities only; null for points that all coincide. Scale is sqrt(a² + b²), rotation atan2(b, a)."""
    cov, var = F.covar_pop, F.var_pop
    s = var("x") + var("y")
    g = (pairs.groupBy(*keys) if keys else pairs.groupBy()).agg(
        F.try_divide(cov("x", "u") + cov("y", "v"), s).alias("a"), F.try_divide(cov("x", "v") - cov("y", "u"), s).alias("b"), F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.avg("u").alias("_u"), F.avg("v").alias("_v")
    )
    tx = F.col("_u") - F.col("a") * F.col("_x") + F.col("b") * F.col("_y")
    ty = F.col("_v") - F.col("b") * F.col("_x") - F.col("a") * F.col("_y")
    return g.select(*(keys or []), "a", "b", tx.alias("tx"), ty.alias("ty"))


def fit_affine(pairs: DataFrame) -> DataFrame:
    """(a, b, tx, c, d, ty) of x' = a x + b y + tx, y' = c x + d y + ty by least squares, from second moments."""
    cov, var = F.covar_pop, F.var_pop
    m = pairs.agg(
        var("x").alias("xx"), var("y").alias("yy"), cov("x", "y").alias("xy"), cov("x", "u").alias("xu"), cov("y", "u").alias("yu"), cov("x", "v").alias("xv"), cov("y", "v").alias("yv"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p, q: (F.try_divide(F.col("yy") * F.col(p) - F.col("xy") * F.col(q), det), F.try_divide(F.col("xx") * F.col(q) - F.col("xy") * F.col(p), det))
    (a, b), (c, d) = solve("xu", "yu"), solve("xv", "yv")
    m = m.withColumns({"a": a, "b": b, "c": c, "d": d})
    return m.select("a", "b", (F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("tx"), "c", "d", (F.col("mv") - F.col("c") * F.col("mx") - F.col("d") * F.col("my")).alias("ty"))


#: Row and column after each operation of the square, from those before and the image's height and width.
DIHEDRAL = {
    "identity": lambda r, c, h, w: (r, c),
    "rot90": lambda r, c, h, w: (w - 1 - c, r),
    "rot180": lambda r, c, h, w: (h - 1 - r, w - 1 - c),
    "rot270": lambda r, c, h, w: (c, h - 1 - r),
    "fliplr": lambda r, c, h, w: (r, w - 1 - c),
    "flipud": lambda r, c, h, w: (h - 1 - r, c),
    "transpose": lambda r, c, h, w: (c, r),
    "anti_transpose": lambda r, c, h, w: (w - 1 - c, h - 1 - r),
}


def dihedral(image: DataFrame, op: str, height: int, width: int) -> DataFrame:
    r, c = DIHEDRAL[op](F.col("r"), F.col("c"), height, width)
    return image.select(r.alias("r"), c.alias("c"), *[x for x in image.columns if x not in ("r", "c")])


def clean_cycles(barcode: Column, n_cycles: int, bases: tuple[str, ...] = ("T", "G")) -> Column:
    """0-based cycles, in order, whose base is one of these."""
    n = F.least(F.lit(n_cycles), F.coalesce(F.length(barcode), F.lit(0)))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substring(barcode, i + 1, F.lit(1)).isin(*bases))


def clean_cycle_anchor(cycles: DataFrame, mask: DataFrame, barcodes: DataFrame, n_cycles: int) -> DataFrame:
    """(r, c, v): the value of the first clean cycle of the pixel's cell; elsewhere the smallest of all cycles.

    cycles (cycle, r, c, v), mask (r, c, cell), barcodes (cell, barcode). At least two cycles are needed.
    """
    if n_cycles < 2:
        raise ValueError("an anchor from clean cycles needs at least two")
    first = barcodes.select("cell", F.try_element_at(clean_cycles(F.col("barcode"), n_cycles), F.lit(1)).alias("_first"))
    chosen = mask.where("cell <> 0").join(first, "cell").select("r", "c", "_first")
    g = cycles.join(chosen, ["r", "c"], "left").groupBy("r", "c")
    return g.agg(F.coalesce(F.max(F.when(F.col("cycle") == F.col("_first"), F.col("v"))), F.min("v")).alias("v"))


def winsorise(image: DataFrame, pct: float = 99.0) -> DataFrame:
    cap = image.agg(F.percentile("v", pct / 100).alias("_cap"))
    return image.crossJoin(F.broadcast(cap)).select("r", "c", F.least("v", "_cap").alias("v"))


def log_anchor(image: DataFrame) -> DataFrame:
    return image.select("r", "c", F.log1p(F.greatest(F.col("v"), F.lit(0.0))).alias("v"))


def down_weight(image: DataFrame, stain: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The image less alpha times its part within the stain, cut between the stain's median and 99th percentile."""
    q = stain.agg(F.percentile("v", 0.5).alias("_lo"), F.percentile("v", 0.99).alias("_hi"))
    m = F.least(F.greatest((F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9), F.lit(0.0)), F.lit(1.0))
    return image.join(stain.withColumnRenamed("v", "_s"), ["r", "c"]).crossJoin(F.broadcast(q)).select("r", "c", (F.col("v") * (1 - alpha * m)).alias("v"))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median, mean and interquartile range of the finite values."""
    x = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*keys).agg(F.count(x).alias("n"), q.alias("_q"), F.avg(x).alias("mean"))
    return g.select(*keys, "n", F.get("_q", F.lit(1)).alias("median"), "mean", (F.get("_q", F.lit(2)) - F.get("_q", F.lit(0))).alias("iqr"))


def signed_ranks(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Of the pairs' differences that aren't 0, by keys: how many, the rank sum of the positive ones, the number of
    distinct magnitudes and the sum of m³ - m over ties. Ties have the mean of their ranks.

    Magnitudes are counted first, so only distinct ones are sorted.
    """
    d = F.col(a) - F.col(b)
    mags = df.where(d != 0).groupBy(*keys, F.abs(d).alias("_mag")).agg(F.count("*").alias("_m"), F.sum((d > 0).cast("long")).alias("_up"))
    below = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_mag").rowsBetween(Window.unboundedPreceding, 0))
    ranked = mags.withColumn("_rank", below - (F.col("_m") - 1) / 2)
    return ranked.groupBy(*keys).agg(
        F.sum("_m").alias("differ"), F.sum(F.col("_rank") * F.col("_up")).alias("rank_sum"), F.count("*").alias("distinct"), F.sum(F.pow("_m", F.lit(3)) - F.col("_m")).alias("ties")
    )


def paired_summary(df: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """n, both medians, the share of a > b and the signed-rank p of the pairs with both values; p needs 8 pairs."""

    @F.pandas_udf("double")
    def p_value(n: pd.Series, differ: pd.Series, rank_sum: pd.Series, distinct: pd.Series, ties: pd.Series) -> pd.Series:
        rows = zip(n, differ, rank_sum, distinct, ties, strict=True)
        return pd.Series([signed_rank_p(int(k), float(w), float(t), k == m == u) if m >= 8 and k > 0 else None for m, k, w, u, t in rows], dtype="float64")

    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    g = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile(a, 0.5).alias("a_median"), F.percentile(b, 0.5).alias("b_median"), F.avg((F.col(a) > F.col(b)).cast("double")).alias("a_gt_b_frac")
    )
    ranks = signed_ranks(ok, keys, a, b).select(*[F.col(k).alias(f"_{k}") for k in keys], "differ", "rank_sum", "distinct", "ties")
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    p = p_value(F.col("n").cast("double"), zero("differ"), zero("rank_sum"), zero("distinct"), zero("ties"))
    return g.join(ranks, same, "left").select(*keys, "n", "a_median", "b_median", "a_gt_b_frac", p.alias("wilcoxon_p"))


def cutoffs(metrics: DataFrame, max_noise: float | None = None, min_snr: float | None = None, min_spectral: float | None = None) -> DataFrame:
    """Rows that meet every cut-off that is set; an undefined value fails a set one only."""
    for name, limit, most in (("noise_sigma", max_noise, True), ("snr_median", min_snr, False), ("spectral_hf_snr", min_spectral, False)):
        if limit is not None:
            metrics = metrics.where(F.col(name) <= limit if most else F.col(name) >= limit)
    return metrics


def majority_region(footprints: DataFrame, regions: DataFrame) -> DataFrame:
    """(cell_id, region_id) of the region that shares most pixels with a footprint, the smallest id on ties."""
    n = footprints.join(regions, ["r", "c"]).groupBy("cell_id", "region_id").agg(F.count("*").alias("n"))
    return n.groupBy("cell_id").agg(F.min(F.struct(-F.col("n"), F.col("region_id"))).alias("m")).select("cell_id", "m.region_id")


def gate(records: DataFrame, min_ncc: float = 0.30, scale_tol: float = 0.5) -> DataFrame:
    """Add passed and reason to (fov, ncc, scale): the score, then the scale about the median of those that score."""
    expected = records.where(F.col("ncc") >= min_ncc).agg(F.percentile("scale", 0.5).alias("expected"))
    low, high = F.col("expected") / (1 + scale_tol), F.col("expected") * (1 + scale_tol)
    reason = (
        F.when(F.col("ncc") < min_ncc, F.format_string(f"ncc %.3f < min_ncc {min_ncc:.2f}", "ncc"))
        .when(~((F.col("scale") > low) & (F.col("scale") < high)), F.format_string("scale %.3f outside (%.3f, %.3f)", "scale", low, high))
        .otherwise("")
    )
    return records.crossJoin(F.broadcast(expected)).withColumn("reason", reason).withColumn("passed", F.col("reason") == "")


def roughness(image: DataFrame, bins: int = 180, pct: float = 97.0) -> DataFrame:
    """One row: circular variation over the mean of the outer radius (90th percentile) by angle of the brightest
    pixels; infinite if too few pixels or bins."""
    pos = image.where("v > 0")
    cut = pos.agg(F.percentile("v", pct / 100).alias("_q"), F.count("*").alias("_n"))
    bright = image.crossJoin(F.broadcast(cut)).where("v > _q and _n >= 100").select("r", "c")
    mid = bright.agg(F.avg("r").alias("_r"), F.avg("c").alias("_c"), F.count("*").alias("_m"))
    y, x = F.col("r") - F.col("_r"), F.col("c") - F.col("_c")
    angle = F.atan2(y, x)
    b = bright.crossJoin(F.broadcast(mid)).where(F.col("_m") >= bins).select(F.floor((angle + F.lit(3.141592653589793)) / (2 * 3.141592653589793 / bins)).cast("int").alias("bin"), F.sqrt(x * x + y * y).alias("rad"))
    prof = b.where(F.col("bin") < bins).groupBy("bin").agg(F.count("*").alias("n"), F.percentile("rad", 0.9).alias("p")).where("n >= 2")
    # At most as many rows as bins: one task orders them.
    w = Window.orderBy("bin")
    near = prof.select("p", F.coalesce(F.lead("p").over(w), F.first("p").over(w)).alias("q"))
    s = near.agg(F.count("*").alias("k"), F.avg(F.abs(F.col("q") - F.col("p"))).alias("tv"), F.avg("p").alias("m"))
    return s.select(F.when(F.col("k") < bins * 0.7, float("inf")).otherwise(F.col("tv") / (F.col("m") + 1e-9)).alias("roughness"))


def spread(df: DataFrame, value: str) -> DataFrame:
    """Coefficient of variation, and the best value less the second best."""
    top = df.select(F.col(value).alias("_v")).orderBy(F.col("_v").desc()).limit(2)
    return df.agg(F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv")).crossJoin(top.agg((F.max("_v") - F.min("_v")).alias("margin")))
