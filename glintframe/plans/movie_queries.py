"""Queries on a movie made of ``lineitem``: months are frames, line numbers rows, quantities columns, sums of cents
values; missing cells are 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import blocks, movie as mv, images as im
from glintframe.plans.catalog import register
from glintframe.sources.shared import checkpointed

H, W = 7, 50
RANGES = ((1, 12), (30, 40), (60, 80))
CLIP = 100_000.0

MOVIE = """l AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS t, l_linenumber - 1 AS r, l_quantity::INT - 1 AS c, sum(round(l_extendedprice * 100)::BIGINT) / 100.0::DOUBLE AS v FROM lineitem GROUP BY ALL),
g AS (SELECT tt.t::INT AS t, rr.r::INT AS r, cc.c::INT AS c, coalesce(l.v, 0)::DOUBLE AS v FROM (SELECT DISTINCT t FROM l) tt CROSS JOIN (SELECT DISTINCT r FROM l) rr CROSS JOIN (SELECT DISTINCT c FROM l) cc LEFT JOIN l ON l.t = tt.t AND l.r = rr.r AND l.c = cc.c)"""
MEAN = f"{MOVIE}, i AS (SELECT r, c, avg(v) AS v FROM g GROUP BY r, c)"


def grid_movie(spark: SparkSession, sf: str) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    cell = li.groupBy(
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("t"), (F.col("l_linenumber") - 1).alias("r"), (F.col("l_quantity").cast("int") - 1).alias("c")
    ).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0).alias("v"))
    # The grid's axes come from one pass over the aggregated cells.
    grid = cell.agg(*[F.collect_set(a).alias(f"{a}s") for a in "trc"]).select(F.explode("ts").alias("t"), "rs", "cs").select("t", F.explode("rs").alias("r"), "cs").select("t", "r", F.explode("cs").alias("c"))
    return grid.join(cell, ["t", "r", "c"], "left").select("t", "r", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def mean(spark: SparkSession, sf: str) -> DataFrame:
    return mv.mean_image(grid_movie(spark, sf))


def _rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    names = names or ("v",)
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


@register("grid_movie", f"WITH {MOVIE} SELECT * FROM g")
def grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid_movie(spark, sf)


@register("truncate", f"WITH {MOVIE} SELECT * FROM g WHERE t <= (SELECT max(t) FROM g) - 10")
def truncate(spark: SparkSession, sf: str) -> DataFrame:
    return mv.truncate_last(grid_movie(spark, sf), 10)


@register("first_frames_mean", f"WITH {MOVIE} SELECT r, c, round(avg(v), 6) AS v FROM g WHERE t < 24 GROUP BY r, c")
def first_frames_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.mean_image(mv.first_frames(grid_movie(spark, sf), 24)))


@register("clip_saturation", f"WITH {MOVIE} SELECT t, r, c, CASE WHEN v > {CLIP} THEN 0 ELSE v END AS v FROM g")
def clip_saturation(spark: SparkSession, sf: str) -> DataFrame:
    return mv.clip_saturation(grid_movie(spark, sf), CLIP)


@register("mean_image", f"WITH {MEAN} SELECT r, c, round(v, 6) AS v FROM i")
def mean_image(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mean(spark, sf))


@register("max_projection", f"WITH {MOVIE} SELECT r, c, max(v) AS v FROM g GROUP BY r, c")
def max_projection(spark: SparkSession, sf: str) -> DataFrame:
    return mv.max_projection(grid_movie(spark, sf))


_CORR = f"""{MEAN}, d AS (SELECT g.t, g.r, g.c, g.v - i.v AS v FROM g JOIN i USING (r, c)),
n AS (SELECT r, c, sqrt(sum(v * v)) AS n FROM d GROUP BY r, c),
o(dr, dc) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
x AS (SELECT a.r, a.c, o.dr, o.dc, sum(a.v * b.v) AS s FROM d a CROSS JOIN o JOIN d b ON b.t = a.t AND b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY ALL),
k AS (SELECT x.r, x.c, sum(x.s / (p.n * q.n + {mv.EPS!r}::DOUBLE)) / 4 AS v, count(*) AS m FROM x JOIN n p ON p.r = x.r AND p.c = x.c JOIN n q ON q.r = x.r + dr AND q.c = x.c + dc GROUP BY x.r, x.c),
corr AS (SELECT n.r, n.c, CASE WHEN k.m = 4 AND n.n > 0 THEN k.v ELSE 0 END AS v FROM n LEFT JOIN k USING (r, c))"""


@register("correlation_image", f"WITH {_CORR} SELECT r, c, round(v, 9) AS v FROM corr")
def correlation_image(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.correlation_image(grid_movie(spark, sf), W), 9)


@register("reference_image", f"WITH {_CORR} SELECT r, c, round(i.v * greatest(corr.v, 0) / (SELECT max(greatest(v, 0)) FROM corr), 4) AS v, round(greatest(corr.v, 0) / (SELECT max(greatest(v, 0)) FROM corr), 9) AS corr FROM corr JOIN i USING (r, c)")
def reference_image(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rounded(mv.reference_image(grid_movie(spark, sf), W), 4), 9, "corr")


_SPANS = "s(range_id, a, b) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(RANGES)) + ")"
_RANGE = f"{MOVIE}, {_SPANS}, k AS (SELECT range_id, r, c, avg(v) AS v FROM g JOIN s ON t + 1 BETWEEN a AND b GROUP BY ALL)"


@register("range_mean", f"WITH {_RANGE} SELECT range_id, r, c, round(v, 6) AS v FROM k")
def range_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.range_means(grid_movie(spark, sf), RANGES))


_BACKGROUND = f"""{_RANGE}, a AS (SELECT range_id AS k, floor((a + b) / 2.0 + 0.5) AS f, lead(floor((a + b) / 2.0 + 0.5)) OVER (ORDER BY range_id) AS g FROM s),
w AS (SELECT t, coalesce(max(CASE WHEN t + 1 > f THEN k END), 0) AS k FROM (SELECT DISTINCT t FROM g) CROSS JOIN a GROUP BY t),
z AS (SELECT w.t, w.k, CASE WHEN a.g IS NULL OR w.t + 1 <= a.f THEN 0 ELSE (w.t + 1 - a.f)::DOUBLE / (a.g - a.f) END AS q FROM w JOIN a USING (k))"""
_LESS = "round(g.v - ((1 - q) * b.v + q * coalesce(e.v, 0)), 8) AS v"
_BACKGROUND_FROM = "g JOIN z ON z.t = g.t JOIN k b ON b.range_id = z.k AND b.r = g.r AND b.c = g.c LEFT JOIN k e ON e.range_id = z.k + 1 AND e.r = g.r AND e.c = g.c"


@register("background_interp", f"WITH {_BACKGROUND} SELECT g.t, g.r, g.c, {_LESS} FROM {_BACKGROUND_FROM}")
def background_interp(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    return _rounded(mv.subtract_background(m, mv.range_means(m, RANGES), RANGES), 8)


_MOTION = f"""{MOVIE}, f AS (SELECT r, c, avg(v) AS v FROM g WHERE t <= (SELECT max(t) FROM g) - 10 GROUP BY r, c),
d AS (SELECT a.r, a.c, (e.v - w.v) / 2 AS gx, (s.v - n.v) / 2 AS gy FROM f a JOIN f w ON w.r = a.r AND w.c = least(greatest(a.c, 1), {W} - 2) - 1 JOIN f e ON e.r = a.r AND e.c = w.c + 2 JOIN f n ON n.c = a.c AND n.r = least(greatest(a.r, 1), {H} - 2) - 1 JOIN f s ON s.c = a.c AND s.r = n.r + 2),
m AS (SELECT sum(gx * gx) AS xx, sum(gx * gy) AS xy, sum(gy * gy) AS yy FROM d),
b AS (SELECT t, sum(gx * v) AS b1, sum(gy * v) AS b2 FROM g JOIN d USING (r, c) GROUP BY t),
h AS (SELECT t, (yy * b1 - xy * b2) / (xx * yy - xy * xy) AS dx, (xx * b2 - xy * b1) / (xx * yy - xy * xy) AS dy FROM b, m)"""


@register("motion_lsq", f"WITH {_MOTION} SELECT t, round(dx, 8) AS dx, round(dy, 8) AS dy FROM h")
def motion_lsq(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.motion_shifts(grid_movie(spark, sf))[0], 8, "dx", "dy")


@register("motion_residual", f"WITH {_MOTION} SELECT t, r, c, round(v - gx * dx - gy * dy, 5) AS v FROM g JOIN d USING (r, c) JOIN h USING (t)")
def motion_residual(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.motion_correct(grid_movie(spark, sf)), 5)


_FILTERED = f"{MOVIE}, f AS (SELECT t, r, c, quantile_cont(v, 0.5) OVER (PARTITION BY r, c ORDER BY t ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) - v AS v FROM g)"


@register("temporal_median_grid", f"WITH {_FILTERED} SELECT t, r, c, round(v, 6) AS v FROM f")
def temporal_median_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.temporal_filter(grid_movie(spark, sf)))


@register("temporal_median_arrays", f"WITH {_FILTERED} SELECT r * {W} + c AS pix, list(round(v, 6) ORDER BY t) AS y FROM f GROUP BY r, c")
def temporal_median_arrays(spark: SparkSession, sf: str) -> DataFrame:
    out = blocks.filter_pixels(blocks.to_pixel_major(grid_movie(spark, sf), W))
    return out.select("pix", F.transform("y", lambda x: F.round(x, 6)).alias("y"))


@register(
    "pixel_noise_map",
    f"WITH {_FILTERED}, {_SPANS}, q AS (SELECT r, c, 1.4826e0 * mad(v) AS s FROM f JOIN s ON t + 1 BETWEEN a AND b GROUP BY r, c) SELECT r, c, round(greatest(s, (SELECT quantile_cont(s, 0.05) FROM q WHERE s > 0)), 8) AS v FROM q",
)
def pixel_noise_map(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mv.pixel_noise_map(mv.temporal_filter(grid_movie(spark, sf)), RANGES), 8)


def _stencil_sql(st: im.Stencil, source: str) -> str:
    rows = ", ".join(f"({i}, {j}, {w!r}::DOUBLE)" for i, j, w in st)
    return f"SELECT a.r, a.c, sum(k.w * b.v) AS v FROM {source} a CROSS JOIN (VALUES {rows}) k(i, j, w) JOIN {source} b ON b.r = least(greatest(a.r + k.i, 0), {H - 1}) AND b.c = least(greatest(a.c + k.j, 0), {W - 1}) GROUP BY a.r, a.c"


@register("gaussian_blur", f"WITH {MEAN}, o AS ({_stencil_sql(im.gaussian_stencil(1.75), 'i')}) SELECT r, c, round(v, 5) AS v FROM o")
def gaussian_blur(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(im.correlate(mean(spark, sf), im.gaussian_stencil(1.75), H, W), 5)


@register("laplacian", f"WITH {MEAN}, o AS ({_stencil_sql(im.laplacian_stencil(0.2), 'i')}) SELECT r, c, round(v, 5) AS v FROM o")
def laplacian(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(im.correlate(mean(spark, sf), im.laplacian_stencil(0.2), H, W), 5)


@register(
    "box_mean",
    f"WITH {MEAN} SELECT a.r, a.c, round(avg(b.v), 6) AS v FROM i a CROSS JOIN range(-1, 2) p(dr) CROSS JOIN range(-3, 4) q(dc) JOIN i b ON b.r = least(greatest(a.r + dr, 0), {H - 1}) AND b.c = least(greatest(a.c + dc, 0), {W - 1}) GROUP BY a.r, a.c",
)
def box_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(im.box_mean(mean(spark, sf), H, W, 3, 7))


def _reflect_sql(x: str, n: int) -> str:
    m = f"((({x}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


def _extreme_sql(source: str, f: str) -> str:
    rows = ", ".join(f"({i}, {j})" for i, j in im.octagon(3))
    return f"SELECT a.r, a.c, {f}(b.v) AS v FROM {source} a CROSS JOIN (VALUES {rows}) k(i, j) JOIN {source} b ON b.r = {_reflect_sql('a.r + k.i', H)} AND b.c = {_reflect_sql('a.c + k.j', W)} GROUP BY a.r, a.c"


_OPEN = f"WITH {MEAN}, e AS ({_extreme_sql('i', 'min')}), o AS ({_extreme_sql('e', 'max')}) SELECT r, c, round(v, 6) AS v FROM o"


@register("opening_small", _OPEN)
def opening_small(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(im.grey_opening(mean(spark, sf), 3, H, W))


@register("opening_kernel", _OPEN)
def opening_kernel(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(blocks.opening_kernel(mean(spark, sf), 3, H, W))


_SEG = f"""{MEAN}, n AS (SELECT r, c, (v - (SELECT min(v) FROM i)) / (SELECT max(v) - min(v) FROM i) AS v FROM i),
u AS ({_stencil_sql(im.gaussian_stencil(0.1), 'n')}),
m AS (SELECT a.r, a.c, 1.5e0 * avg(b.v) AS t FROM u a CROSS JOIN range(-3, 4) q(dc) JOIN u b ON b.r = a.r AND b.c = least(greatest(a.c + dc, 0), {W - 1}) GROUP BY a.r, a.c),
bw AS (SELECT n.r, n.c FROM n JOIN m USING (r, c) WHERE n.v > m.t)"""
#: The mean image is too even for 1.5 times the local mean, so components are those of a plain cut.
_BRIGHT = f"{MEAN}, bw AS (SELECT r, c FROM i WHERE v > (SELECT quantile_cont(v, 0.6) FROM i))"
_LABEL = f"""{_BRIGHT}, e AS (SELECT a.r * {W} + a.c AS x, b.r * {W} + b.c AS y FROM bw a JOIN bw b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
z(x, y) AS (SELECT x, y FROM e UNION SELECT z.x, e.y FROM z JOIN e ON e.x = z.y),
lb AS (SELECT (x // {W})::INT AS r, (x % {W})::INT AS c, min(y)::BIGINT AS label FROM z GROUP BY x)"""


@register("adaptive_threshold", f"WITH {_SEG} SELECT r, c, round(t, 8) AS v FROM m")
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    n = im.normalise(mean(spark, sf))
    return _rounded(im.adaptive_threshold(im.correlate(n, im.gaussian_stencil(0.1), H, W), H, W), 8)


@register("binarise", f"WITH {_SEG} SELECT r, c FROM bw")
def binarise(spark: SparkSession, sf: str) -> DataFrame:
    return im.binarise(mean(spark, sf), H, W)


def bright(spark: SparkSession, sf: str) -> DataFrame:
    i = checkpointed(mean(spark, sf))
    cut = i.agg(F.percentile("v", 0.6).alias("_q"))
    return i.crossJoin(F.broadcast(cut)).where("v > _q").select("r", "c")


@register("segment_components", f"WITH RECURSIVE {_LABEL} SELECT r, c, label FROM lb")
def segment_components(spark: SparkSession, sf: str) -> DataFrame:
    return im.components(bright(spark, sf), W)


_PROPS = f"""{_LABEL}, p AS (SELECT label, count(*) AS area, avg(c) + 1 AS cx, avg(r) + 1 AS cy, min(c) + 0.5::DOUBLE AS x_ul, min(r) + 0.5::DOUBLE AS y_ul, max(c) - min(c) + 1 AS w, max(r) - min(r) + 1 AS h FROM lb GROUP BY label HAVING count(*) >= 3),
rp AS (SELECT row_number() OVER (ORDER BY label) - 1 AS region_id, * FROM p)"""


@register("region_props", f"WITH RECURSIVE {_PROPS} SELECT region_id, area, round(cx, 8) AS cx, round(cy, 8) AS cy, x_ul, y_ul, w, h FROM rp")
def region_props(spark: SparkSession, sf: str) -> DataFrame:
    p = im.region_props(im.components(bright(spark, sf), W), 3).drop("pixels")
    return _rounded(p, 8, "cx", "cy").withColumn("region_id", F.col("region_id").cast("bigint"))


@register(
    "compute_patch",
    f"""WITH RECURSIVE {_PROPS} SELECT region_id, greatest(least(floor(cy - 3.5), floor(y_ul + 0.5)), 1)::INT AS row0, least(greatest(floor(cy + 3.5), floor(y_ul + 0.5 + h)), {H})::INT AS row1,
greatest(least(floor(cx - 2.5), floor(x_ul + 0.5)), 1)::INT AS col0, least(greatest(floor(cx + 2.5), floor(x_ul + 0.5 + w)), {W})::INT AS col1 FROM rp""",
)
def compute_patch(spark: SparkSession, sf: str) -> DataFrame:
    p = im.compute_patch(im.region_props(im.components(bright(spark, sf), W), 3), 5, 7, H, W)
    return p.withColumn("region_id", F.col("region_id").cast("bigint"))


_SHARP = f"""{MEAN}, e AS ({_extreme_sql('i', 'min')}), o AS ({_extreme_sql('e', 'max')}), i2 AS (SELECT i.r, i.c, o.v AS bkg, i.v - o.v AS v FROM i JOIN o USING (r, c)),
bl AS ({_stencil_sql(im.gaussian_stencil(1.75), 'i2')}), lo AS ({_stencil_sql(im.laplacian_stencil(0.2), 'bl')}),
ln AS (SELECT r, c, v AS log, v / (SELECT max(abs(v)) FROM lo) * (SELECT stddev_samp(v) FROM i2) AS log_norm FROM lo)"""


@register(
    "sharpen",
    f"WITH {_SHARP} SELECT r, c, round(bkg, 4) AS bkg, round(i2.v, 4) AS i2, round(bl.v, 4) AS blurred, round(log, 4) AS log, round(log_norm, 4) AS log_norm, round(i2.v - 2.25 * log_norm, 4) AS sharpened FROM i2 JOIN bl USING (r, c) JOIN ln USING (r, c)",
)
def sharpen(spark: SparkSession, sf: str) -> DataFrame:
    out = im.sharpen(mean(spark, sf), H, W, disk_radius=3)
    return _rounded(out, 4, *[c for c in out.columns if c not in "rc"])


@register(
    "smoothness",
    f"""WITH {MOVIE}, f AS (SELECT t, r * {W} + c AS i, v FROM g WHERE t < 5), p(nrow, ncol) AS (VALUES (7, 50), (50, 7), (14, 25), (25, 14), (10, 35), (35, 10)),
h AS (SELECT a.t, nrow, ncol, corr(a.v, b.v) AS s FROM p CROSS JOIN f a JOIN f b ON b.t = a.t AND b.i = a.i + 1 AND (a.i + 1) % ncol <> 0 GROUP BY ALL),
w AS (SELECT a.t, nrow, ncol, corr(a.v, b.v) AS s FROM p CROSS JOIN f a JOIN f b ON b.t = a.t AND b.i = a.i + ncol GROUP BY ALL)
SELECT nrow, ncol, round(avg((h.s + w.s) / 2), 8) AS score FROM h JOIN w USING (t, nrow, ncol) GROUP BY nrow, ncol""",
)
def smoothness(spark: SparkSession, sf: str) -> DataFrame:
    f = grid_movie(spark, sf).where("t < 5").select("t", (F.col("r") * W + F.col("c")).alias("i"), "v")
    return _rounded(mv.smoothness(f, [(7, 50), (50, 7), (14, 25), (25, 14), (10, 35), (35, 10)]), 8, "score")
