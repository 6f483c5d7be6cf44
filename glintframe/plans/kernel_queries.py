"""Queries whose operators are numpy kernels, and the cells' matrices, on embeddings and the grid movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import extraction as ex, images as im, movie as mv, registration as rg, snr
from glintframe.params import Params
from glintframe.plans.catalog import register
from glintframe.plans.movie_queries import MOVIE, H, W, bright, grid_movie
from glintframe.plans.pipelines import process_movie

FPS = 800.0
PARAMS = Params(threshold_factor=0.5, min_peak_interval=4, std_ranges=((1, 60),), bkg_ranges=((1, 12), (60, 70)), n_ref=24, disk_radius=3, patch_size=(7, 7), dbscan_eps=6.0, dbscan_min_pts=2, seg_region_size=1, saturation_clip=1e9)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("y"), "label")


@register("per_cell_snr")
def per_cell_snr(spark: SparkSession, sf: str) -> DataFrame:
    return snr.cell_metrics(_cells(spark, sf), FPS, k=1.5)


@register("highpass")
def highpass(spark: SparkSession, sf: str) -> DataFrame:
    return snr.highpass(_cells(spark, sf), FPS)


@register("welch")
def welch(spark: SparkSession, sf: str) -> DataFrame:
    return snr.spectra(_cells(spark, sf), FPS, 32)


@register("mean_spectrum")
def mean_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return snr.mean_spectrum(_cells(spark, sf), FPS, 32)


@register("notch")
def notch(spark: SparkSession, sf: str) -> DataFrame:
    return snr.notch_effect(_cells(spark, sf), FPS, k=1.5)


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd vectors are two runs of cells; the first two dimensions are their centres."""
    c = _cells(spark, sf).withColumns({"row": F.get("y", F.lit(0)) * 100, "col": F.get("y", F.lit(1)) * 100})
    return c.where("cell_id % 2 = 0"), c.where("cell_id % 2 = 1")


@register("cell_match")
def cell_match(spark: SparkSession, sf: str) -> DataFrame:
    return snr.match_cells(*_runs(spark, sf), 6.0)


@register("run_comparison")
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return snr.compare(a, a, b, b, FPS, k=1.5)[0]


@register("run_comparison_summary")
def run_comparison_summary(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return snr.compare(a, a, b, b, FPS, k=1.5)[1]


@register(
    "dbscan",
    """WITH RECURSIVE p AS (SELECT label AS key, vec_id AS id, embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 20 AS y FROM embeddings),
n AS (SELECT a.key, a.id, b.id AS other FROM p a JOIN p b ON a.key = b.key AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25e0),
core AS (SELECT key, id FROM n GROUP BY key, id HAVING count(*) >= 3),
e AS (SELECT n.key, n.id, n.other FROM n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.other),
w AS (SELECT key, id, id AS root FROM core UNION SELECT w.key, e.other, w.root FROM w JOIN e ON e.id = w.id WHERE w.root < e.other),
c AS (SELECT key, id, min(root) AS root FROM w GROUP BY key, id),
k AS (SELECT key, root, row_number() OVER (PARTITION BY key ORDER BY root) - 1 AS label FROM (SELECT DISTINCT key, root FROM c)),
m AS (SELECT n.key, n.id, min(k.label) AS label FROM n JOIN c ON c.id = n.other JOIN k ON k.key = c.key AND k.root = c.root GROUP BY n.key, n.id)
SELECT p.key, p.id, coalesce(m.label, -1)::INT AS label FROM p LEFT JOIN m ON m.id = p.id""",
)
def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    c = _cells(spark, sf)
    pts = c.select(F.col("label").alias("key"), F.col("cell_id").alias("id"), (F.get("y", F.lit(0)) * 20).alias("x"), (F.get("y", F.lit(1)) * 20).alias("y"))
    return ex.dbscan(pts, 1.5, 3)


_FOOT = f"{MOVIE}, foot AS (SELECT label AS cell_id, r, c, sum(v) AS w FROM (SELECT label, (vec_id % {H})::INT AS r, unnest(range({W}))::INT AS c, unnest(embedding[1:{W}])::DOUBLE AS v FROM embeddings) GROUP BY ALL)"


def _foot(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    px = e.select(F.col("label").alias("cell_id"), (F.col("vec_id") % H).cast("int").alias("r"), F.posexplode(F.slice("embedding", 1, W)).alias("c", "v"))
    return px.groupBy("cell_id", "r", "c").agg(F.sum(F.col("v").cast("double")).alias("w"))


@register("gram", f"WITH {_FOOT} SELECT a.cell_id AS i, b.cell_id AS j, round(sum(a.w * b.w), 8) AS g FROM foot a JOIN foot b USING (r, c) GROUP BY ALL")
def gram(spark: SparkSession, sf: str) -> DataFrame:
    return ex.gram(_foot(spark, sf)).select("i", "j", F.round("g", 8).alias("g"))


@register("dot_products", f"WITH {_FOOT} SELECT cell_id, t, round(-sum(w * v), 4) AS b FROM g JOIN foot USING (r, c) GROUP BY ALL")
def dot_products(spark: SparkSession, sf: str) -> DataFrame:
    return ex.projections(grid_movie(spark, sf), _foot(spark, sf)).select("cell_id", "t", F.round("b", 4).alias("b"))


@register("pinv_traces")
def pinv_traces(spark: SparkSession, sf: str) -> DataFrame:
    return ex.pinv_traces(grid_movie(spark, sf), _foot(spark, sf))


@register("gls_traces")
def gls_traces(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    return ex.gls_traces(m, _foot(spark, sf), mv.pixel_noise_map(mv.temporal_filter(m), ((1, 60),)))


_NOISE_VALUE = "(2 + r + c / 10e0)"
_PAIR = f"{_FOOT}, f AS (SELECT cell_id::INT AS cell_id, r, c, w FROM foot WHERE cell_id < 2 AND (cell_id = 0 OR c < 20))"


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    return _foot(spark, sf).where("cell_id < 2 and (cell_id = 0 or c < 20)").select(F.col("cell_id").cast("int").alias("cell_id"), "r", "c", "w")


def _two_cells(weight: str, ridge: str) -> str:
    """Traces of two cells from the inverse of their matrix written out."""
    return f"""WITH {_PAIR}, m AS (SELECT sum(w * w / {weight}) FILTER (cell_id = 0) AS a0, sum(w * w / {weight}) FILTER (cell_id = 1) AS d0 FROM f),
o AS (SELECT sum(x.w * y.w / {weight.replace("(2 + r", "(2 + x.r").replace("+ c /", "+ x.c /")}) AS b FROM f x JOIN f y ON x.r = y.r AND x.c = y.c AND x.cell_id = 0 AND y.cell_id = 1),
q AS (SELECT a0 + {ridge} * (a0 + d0) / 2 AS a, d0 + {ridge} * (a0 + d0) / 2 AS d, b FROM m, o),
p AS (SELECT t, -sum(w * v / {weight}) FILTER (cell_id = 0) AS p, -sum(w * v / {weight}) FILTER (cell_id = 1) AS q FROM g JOIN f USING (r, c) GROUP BY t),
s AS (SELECT t, (d * p.p - b * p.q) / (a * d - b * b) AS x, (a * p.q - b * p.p) / (a * d - b * b) AS y FROM p, q)
SELECT 0::INT AS cell_id, t, round(x, 4) AS v FROM s UNION ALL SELECT 1::INT, t, round(y, 4) FROM s"""


@register("pinv_two_cells", _two_cells("1", "0"))
def pinv_two_cells(spark: SparkSession, sf: str) -> DataFrame:
    return ex.pinv_traces(grid_movie(spark, sf), _pair(spark, sf)).select("cell_id", "t", F.round("v", 4).alias("v"))


@register("gls_two_cells", _two_cells(f"({_NOISE_VALUE} * {_NOISE_VALUE})", "0.001e0"))
def gls_two_cells(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    noise = m.select("r", "c").distinct().withColumn("v", 2 + F.col("r") + F.col("c") / 10)
    return ex.gls_traces(m, _pair(spark, sf), noise).select("cell_id", "t", F.round("v", 4).alias("v"))


@register("extract_regions")
def extract_regions(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    props = im.region_props(im.components(bright(spark, sf), W), 3)
    return ex.extract_regions(mv.temporal_filter(m), props, im.compute_patch(props, 7, 7, H, W), PARAMS, H, W, 83)


@register("process_movie")
def process(spark: SparkSession, sf: str) -> DataFrame:
    return process_movie(grid_movie(spark, sf), H, W, PARAMS)["traces"]


def _image(spark: SparkSession, sf: str) -> DataFrame:
    """Months by cells of the movie as one image of 83 by 350 pixels."""
    return grid_movie(spark, sf).select(F.col("t").alias("r"), (F.col("r") * W + F.col("c")).alias("c"), (F.col("v") / 1000).alias("v"))


@register("localize")
def localize(spark: SparkSession, sf: str) -> DataFrame:
    """Two windows of the image are fields of view at scale 1."""
    img = _image(spark, sf)
    fovs = None
    for k, (a, b) in enumerate(((10, 40), (30, 200))):
        win = img.where((F.col("r") >= a) & (F.col("r") < a + 40) & (F.col("c") >= b) & (F.col("c") < b + 60))
        px = F.transform(F.array_sort(F.collect_list(F.struct("r", "c", "v"))), lambda x: x["v"])
        one = win.agg(px.alias("px")).select(F.lit(k).alias("fov"), F.lit(float(b)).alias("stage_x"), F.lit(float(a)).alias("stage_y"), F.lit(40).alias("h"), F.lit(60).alias("w"), "px")
        fovs = one if fovs is None else fovs.unionAll(one)
    return rg.localize(fovs, rg.small_mosaic(img, 1), 1, ("identity", "fliplr"), (1.0,))


@register("variant_effects")
def variant_effects(spark: SparkSession, sf: str) -> DataFrame:
    return snr.variant_effects(_cells(spark, sf), FPS, k=1.5)


@register("run_report")
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _runs(spark, sf)
    return snr.report_lines(*snr.compare(a, a, b, b, FPS, k=1.5))
