"""Queries on the star tables, embeddings and documents for joins, placements, fits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import relational as rel
from glintframe.plans.catalog import register
from glintframe.plans.movie_queries import MEAN, MOVIE, H, W, grid_movie, mean


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@register("genotype_left_join", "SELECT d.doc_id, d.lang, d.source, l.quality AS gene_id_quality, l.toxic AS gene_id_toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def genotype_left_join(spark: SparkSession, sf: str) -> DataFrame:
    labels = _read(spark, sf, "labels").select("doc_id", F.col("quality").alias("gene_id_quality"), F.col("toxic").alias("gene_id_toxic"))
    return rel.genotype_join(_read(spark, sf, "documents").select("doc_id", "lang", "source"), labels, keys=("doc_id",))


@register("with_genotype", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def with_genotype(spark: SparkSession, sf: str) -> DataFrame:
    return rel.with_genotype(_read(spark, sf, "documents").select("doc_id").join(_read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"), "quality")


@register("first_of_each", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS n FROM customer) WHERE n = 1")
def first_of_each(spark: SparkSession, sf: str) -> DataFrame:
    return rel.first_of_each(_read(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], ["c_acctbal", "c_custkey"])


@register("same_sets", "SELECT (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_a, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_b")
def same_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rel.same_sets(_read(spark, sf, "customer").select(F.col("c_custkey").alias("k")), _read(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


#: Every second supplier is a tile that was imaged.
_META = "meta AS (SELECT s_suppkey AS tile, s_acctbal * 3 AS x_pos, (s_nationkey * 97 + s_suppkey) * 1.5::DOUBLE AS y_pos FROM supplier WHERE s_suppkey % 2 = 0)"


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    s = _read(spark, sf, "supplier").where("s_suppkey % 2 = 0")
    return s.select(F.col("s_suppkey").alias("tile"), (F.col("s_acctbal") * 3).alias("x_pos"), ((F.col("s_nationkey") * 97 + F.col("s_suppkey")) * F.lit(1.5)).alias("y_pos"))


def _offsets_sql(k: int) -> str:
    sx, sy, swap = rel.AXES[k]
    a, b = ("y_pos", "x_pos") if swap else ("x_pos", "y_pos")
    return f"{_META}, raw AS (SELECT tile, {sy} * {b} / 0.842914::DOUBLE AS r, {sx} * {a} / 0.842914::DOUBLE AS c FROM meta), off AS (SELECT tile, round_even(r - (SELECT min(r) FROM raw), 0)::INT AS row0, round_even(c - (SELECT min(c) FROM raw), 0)::INT AS col0 FROM raw)"


@register("tile_offsets", " UNION ALL ".join(f"SELECT {k} AS hypothesis, * FROM (WITH {_offsets_sql(k)} SELECT * FROM off)" for k in range(8)))
def tile_offsets(spark: SparkSession, sf: str) -> DataFrame:
    meta, out = _meta(spark, sf), None
    for k, axes in enumerate(rel.AXES):
        one = rel.tile_offsets(meta, 0.842914, axes).select(F.lit(k).alias("hypothesis"), "*")
        out = one if out is None else out.unionAll(one)
    return out


@register(
    "place_cells",
    f"WITH {_offsets_sql(0)} SELECT l_orderkey, l_suppkey AS tile, l_quantity AS i, l_linenumber AS j, (l_quantity + row0)::DOUBLE AS i_mos, (l_linenumber + col0)::DOUBLE AS j_mos FROM lineitem JOIN off ON tile = l_suppkey",
)
def place_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = _read(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("tile"), F.col("l_quantity").alias("i"), F.col("l_linenumber").alias("j"))
    return rel.place_cells(cells, rel.tile_offsets(_meta(spark, sf), 0.842914))


#: Eight months as tiles of the mosaic, each shifted against the last.
_TILES = f"{MOVIE}, px AS (SELECT t AS tile, r, c, v FROM g WHERE t < 8), off AS (SELECT DISTINCT tile, (tile % 4) * 5 AS row0, (tile // 4) * 40 AS col0 FROM px)"


def _tiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    px = grid_movie(spark, sf).where("t < 8").withColumnRenamed("t", "tile")
    off = px.select("tile").distinct().select("tile", (F.col("tile") % 4 * 5).alias("row0"), (F.floor(F.col("tile") / 4) * 40).cast("int").alias("col0"))
    return px, off


@register("mosaic_average", f"WITH {_TILES} SELECT r + row0 AS r, c + col0 AS c, floor(avg(v))::INT AS v FROM px JOIN off USING (tile) GROUP BY ALL")
def mosaic_average(spark: SparkSession, sf: str) -> DataFrame:
    return rel.mosaic_average(*_tiles(spark, sf))


@register("block_downscale", f"WITH {MEAN} SELECT r // 3 AS r, c // 3 AS c, round(sum(v) / 9, 6) AS v FROM i GROUP BY ALL")
def block_downscale(spark: SparkSession, sf: str) -> DataFrame:
    return rel.block_downscale(mean(spark, sf), 3).select("r", "c", F.round("v", 6).alias("v"))


@register("image_ncc", f"WITH {MOVIE} SELECT a.t, round(corr(a.v, b.v), 9) AS ncc FROM g a JOIN g b ON b.t = a.t + 1 AND b.r = a.r AND b.c = a.c GROUP BY a.t")
def image_ncc(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    both = m.withColumnRenamed("v", "a").join(m.select((F.col("t") - 1).alias("t"), "r", "c", F.col("v").alias("b")), ["t", "r", "c"])
    return rel.ncc(both, ["t"]).select("t", F.round("ncc", 9).alias("ncc"))


@register(
    "overlap_ncc",
    f"WITH {MOVIE}, a AS (SELECT r, c, v FROM g WHERE t = 1 AND c < 7), b AS (SELECT r, c, v FROM g WHERE t = 2 AND c < 7), s AS (SELECT dr::INT AS dr, dc::INT AS dc FROM range(-3, 4) x(dr), range(-3, 4) y(dc)) SELECT dr, dc, CASE WHEN count(a.v) < 16 THEN -1 ELSE round(corr(a.v, b.v), 9) END AS ncc FROM s LEFT JOIN b ON true LEFT JOIN a ON a.r = b.r + dr AND a.c = b.c + dc GROUP BY ALL",
)
def overlap_ncc(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf).where("c < 7")
    shifts = spark.createDataFrame([(float(i), float(j)) for i in range(-3, 4) for j in range(-3, 4)], "dr double, dc double")
    out = rel.overlap_ncc(m.where("t = 1").drop("t"), m.where("t = 2").drop("t"), shifts, 7)
    return out.select("dr", "dc", F.round("ncc", 9).alias("ncc"))


_POINTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
_NEAR = f"{_POINTS}, d AS (SELECT a.id, b.id AS other, a.x, a.y, b.x AS x2, b.y AS y2, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM p a JOIN p b ON a.id <> b.id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM d) WHERE k = 1)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@register("nearest", f"WITH {_NEAR} SELECT id, other, round(d, 9) AS d FROM n")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return rel.nearest(_points(spark, sf), 0.1).select("id", "other", F.round("d", 9).alias("d"))


@register("nn_pairs", f"WITH {_NEAR} SELECT id, other, round(d, 9) AS d FROM n WHERE d <= 1.3e0 * (SELECT quantile_cont(d, 0.5) FROM n) AND greatest(abs(x2 - x), abs(y2 - y)) >= 3 * least(abs(x2 - x), abs(y2 - y)) ORDER BY n.d, id LIMIT 20")
def nn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rel.neighbour_pairs(_points(spark, sf), 20, 0.1).select("id", "other", F.round("d", 9).alias("d"))


_BOXES = "b AS (SELECT l_orderkey AS id, min(l_partkey)::BIGINT AS r0, min(l_partkey) + 20 + max(l_quantity)::BIGINT AS r1, (min(l_suppkey) * 7 % 91) * 30 AS c0, (min(l_suppkey) * 7 % 91) * 30 + 25 AS c1 FROM lineitem GROUP BY l_orderkey)"


@register("isolated_boxes", f"WITH {_BOXES} SELECT id, NOT EXISTS (SELECT 1 FROM b o WHERE o.id <> b.id AND b.r0 <= o.r1 AND o.r0 <= b.r1 AND b.c0 <= o.c1 AND o.c0 <= b.c1) AS isolated FROM b")
def isolated_boxes(spark: SparkSession, sf: str) -> DataFrame:
    low = F.min("l_suppkey") * 7 % 91 * 30
    b = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    b = b.agg(F.min("l_partkey").alias("r0"), (F.min("l_partkey") + 20 + F.max("l_quantity").cast("long")).alias("r1"), low.alias("c0"), (low + 25).alias("c1"))
    return rel.isolated(b)


@register("affine_apply", f"WITH {_POINTS} SELECT id, x, y, round(0.4e0 * x + -0.1e0 * y + 200, 9) AS x_out, round(0.1e0 * x + 0.4e0 * y + -100, 9) AS y_out FROM p")
def affine_apply(spark: SparkSession, sf: str) -> DataFrame:
    out = rel.apply_affine(_points(spark, sf), [[0.4, -0.1, 200.0], [0.1, 0.4, -100.0]])
    return out.select("id", "x", "y", F.round("x_out", 9).alias("x_out"), F.round("y_out", 9).alias("y_out"))


_FIT = "q AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS v FROM embeddings)"


def _fit_points(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyuv")])


@register(
    "similarity_fit",
    f"""WITH {_FIT}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM q GROUP BY label),
k AS (SELECT label, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b FROM q JOIN m USING (label) GROUP BY label)
SELECT label, round(a, 8) AS a, round(b, 8) AS b, round(mu - a * mx + b * my, 8) AS tx, round(mv - b * mx - a * my, 8) AS ty FROM k JOIN m USING (label)""",
)
def similarity_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = rel.fit_similarity(_fit_points(spark, sf), ["label"])
    return f.select("label", *[F.round(c, 8).alias(c) for c in ("a", "b", "tx", "ty")])


@register(
    "affine_fit",
    f"""WITH {_FIT}, s AS (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM q),
k AS (SELECT *, (yy * xu - xy * yu) / (xx * yy - xy * xy) AS a, (xx * yu - xy * xu) / (xx * yy - xy * xy) AS b, (yy * xv - xy * yv) / (xx * yy - xy * xy) AS c, (xx * yv - xy * xv) / (xx * yy - xy * xy) AS d FROM s)
SELECT round(a, 8) AS a, round(b, 8) AS b, round(mu - a * mx - b * my, 8) AS tx, round(c, 8) AS c, round(d, 8) AS d, round(mv - c * mx - d * my, 8) AS ty FROM k""",
)
def affine_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = rel.fit_affine(_fit_points(spark, sf))
    return f.select(*[F.round(c, 8).alias(c) for c in f.columns])


@register(
    "dihedral",
    f"WITH {MEAN} " + " UNION ALL ".join(
        f"SELECT '{op}' AS op, {r} AS r, {c} AS c, round(v, 6) AS v FROM i"
        for op, r, c in (("identity", "r", "c"), ("rot90", f"{W - 1} - c", "r"), ("rot180", f"{H - 1} - r", f"{W - 1} - c"), ("rot270", "c", f"{H - 1} - r"), ("fliplr", "r", f"{W - 1} - c"), ("flipud", f"{H - 1} - r", "c"), ("transpose", "c", "r"), ("anti_transpose", f"{W - 1} - c", f"{H - 1} - r"))
    ),
)
def dihedral(spark: SparkSession, sf: str) -> DataFrame:
    i, out = mean(spark, sf), None
    for op in rel.DIHEDRAL:
        one = rel.dihedral(i, op, H, W).select(F.lit(op).alias("op"), "r", "c", F.round("v", 6).alias("v"))
        out = one if out is None else out.unionAll(one)
    return out


@register("clean_cycle", "SELECT doc_id, list_filter(range(0, least(12, length(bc))::BIGINT), lambda i: substring(bc, i + 1, 1) IN ('t', 'g'))::INTEGER[] AS cycles FROM (SELECT doc_id, lower(substring(text, 1, 12)) AS bc FROM documents)")
def clean_cycle(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents").select("doc_id", F.lower(F.substring("text", 1, 12)).alias("bc"))
    return d.select("doc_id", rel.clean_cycles(F.col("bc"), 12, ("t", "g")).alias("cycles"))


_CYCLES = f"{MOVIE}, cy AS (SELECT t AS cycle, r, c, v FROM g WHERE t < 6), mk AS (SELECT DISTINCT r, c, c // 10 AS cell FROM cy), bc(cell, barcode) AS (VALUES (1, 'ATG'), (2, 'CAC'), (3, 'GT'), (4, NULL))"


@register(
    "clean_cycle_anchor",
    f"""WITH {_CYCLES}, f AS (SELECT cell, (list_filter(range(0, least(6, length(barcode))), lambda i: substring(barcode, i + 1, 1) IN ('T', 'G')))[1] AS k FROM bc)
SELECT cy.r, cy.c, coalesce(max(cy.v) FILTER (cy.cycle = f.k), min(cy.v)) AS v FROM cy JOIN mk USING (r, c) LEFT JOIN f ON f.cell = mk.cell AND mk.cell <> 0 GROUP BY cy.r, cy.c""",
)
def clean_cycle_anchor(spark: SparkSession, sf: str) -> DataFrame:
    cy = grid_movie(spark, sf).where("t < 6").withColumnRenamed("t", "cycle")
    mask = cy.select("r", "c", F.floor(F.col("c") / 10).alias("cell")).distinct()
    bc = spark.createDataFrame([(1, "ATG"), (2, "CAC"), (3, "GT"), (4, None)], "cell bigint, barcode string")
    return rel.clean_cycle_anchor(cy, mask, bc, 6)


@register("winsorise", f"WITH {MEAN} SELECT r, c, round(least(v, (SELECT quantile_cont(v, 0.9) FROM i)), 6) AS v FROM i")
def winsorise(spark: SparkSession, sf: str) -> DataFrame:
    return rel.winsorise(mean(spark, sf), 90.0).select("r", "c", F.round("v", 6).alias("v"))


@register("log_anchor", f"WITH {MEAN} SELECT r, c, round(ln(1 + greatest(v, 0)), 9) AS v FROM i")
def log_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return rel.log_anchor(mean(spark, sf)).select("r", "c", F.round("v", 9).alias("v"))


@register(
    "down_weight",
    f"WITH {MOVIE}, a AS (SELECT r, c, v FROM g WHERE t = 3), s AS (SELECT r, c, v FROM g WHERE t = 4), q AS (SELECT quantile_cont(v, 0.5) AS lo, quantile_cont(v, 0.99) AS hi FROM s) SELECT a.r, a.c, round(a.v * (1 - least(greatest((s.v - lo) / (hi - lo + 1e-9), 0), 1)), 6) AS v FROM a JOIN s USING (r, c), q",
)
def down_weight(spark: SparkSession, sf: str) -> DataFrame:
    m = grid_movie(spark, sf)
    return rel.down_weight(m.where("t = 3").drop("t"), m.where("t = 4").drop("t")).select("r", "c", F.round("v", 6).alias("v"))


@register("summary_stats", "SELECT label, count(*) AS n, round(quantile_cont(x, 0.5), 8) AS median, round(avg(x), 8) AS mean, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 8) AS iqr FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = rel.summary(_fit_points(spark, sf), ["label"], "x")
    return s.select("label", "n", *[F.round(c, 8).alias(c) for c in ("median", "mean", "iqr")])


@register("paired_win_fraction", f"WITH {_FIT} SELECT label, count(*) AS n, round(quantile_cont(x, 0.5), 8) AS a_median, round(quantile_cont(y, 0.5), 8) AS b_median, round(avg((x > y)::INT), 8) AS a_gt_b_frac FROM q GROUP BY label")
def paired_win_fraction(spark: SparkSession, sf: str) -> DataFrame:
    p = rel.paired_summary(_fit_points(spark, sf), ["label"], "x", "y")
    return p.select("label", "n", *[F.round(c, 8).alias(c) for c in ("a_median", "b_median", "a_gt_b_frac")])


#: Simpson's rule for the complementary error function, which SQL lacks.
_ERFC = "2e0 / sqrt(pi()) * 0.008e0 / 3 * list_sum(list_transform(range(0, 1001), lambda k: (CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-(u + k * 0.008e0) * (u + k * 0.008e0))))"


@register(
    "paired_wilcoxon",
    f"""WITH p AS (SELECT label % 3 AS grp, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE + embedding[3]::DOUBLE / 8 AS b FROM embeddings), d AS (SELECT grp, a - b AS d, abs(a - b) AS m FROM p WHERE a <> b),
k AS (SELECT grp, d, rank() OVER (PARTITION BY grp ORDER BY m) + (count(*) OVER (PARTITION BY grp, m) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY grp, m) AS t FROM d),
s AS (SELECT grp, count(*)::DOUBLE AS n, sum(r) FILTER (d > 0) AS plus, sum(t * t - 1)::DOUBLE AS ties FROM k GROUP BY grp),
z AS (SELECT grp, n::BIGINT AS differ, round(plus, 6) AS rank_sum, abs(least(plus, n * (n + 1) / 2 - plus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2e0) AS u FROM s)
SELECT grp, differ, rank_sum, round({_ERFC}, 8) AS wilcoxon_p FROM z""",
)
def paired_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    x = lambda k: F.get("embedding", F.lit(k)).cast("double")
    p = _read(spark, sf, "embeddings").select((F.col("label") % 3).alias("grp"), x(0).alias("a"), (x(1) + x(2) / 8).alias("b"))
    ranks = rel.signed_ranks(p, ["grp"]).select("grp", "differ", F.round("rank_sum", 6).alias("rank_sum"))
    return ranks.join(rel.paired_summary(p, ["grp"]).select("grp", F.round("wilcoxon_p", 8).alias("wilcoxon_p")), "grp")


@register("metric_cutoffs", f"WITH {_FIT} SELECT label, x AS noise_sigma, y AS snr_median FROM q WHERE x <= 0.1 AND y >= -0.05")
def metric_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    m = _fit_points(spark, sf).select("label", F.col("x").alias("noise_sigma"), F.col("y").alias("snr_median"))
    return rel.cutoffs(m, max_noise=0.1, min_snr=-0.05)


@register(
    "majority_region",
    f"WITH {MEAN}, f AS (SELECT r, c, c // 7 AS cell_id FROM i), g2 AS (SELECT r, c, (c + r) // 9 AS region_id FROM i), n AS (SELECT cell_id, region_id, count(*) AS k FROM f JOIN g2 USING (r, c) GROUP BY ALL) SELECT cell_id, region_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY k DESC, region_id) AS o FROM n) WHERE o = 1",
)
def majority_region(spark: SparkSession, sf: str) -> DataFrame:
    i = mean(spark, sf)
    f = i.select("r", "c", F.floor(F.col("c") / 7).cast("int").alias("cell_id"))
    return rel.majority_region(f, i.select("r", "c", F.floor((F.col("c") + F.col("r")) / 9).cast("int").alias("region_id")))


_GATE = "k AS (SELECT l_orderkey * 10 + l_linenumber AS fov, l_discount * 8 AS ncc, 2 + l_quantity / 20 AS scale FROM lineitem), e AS (SELECT quantile_cont(scale, 0.5) AS expected FROM k WHERE ncc >= 0.3)"


@register("registration_gate", f"WITH {_GATE} SELECT fov, ncc, scale, expected, CASE WHEN ncc < 0.3 THEN format('ncc {{:.3f}} < min_ncc 0.30', ncc) WHEN NOT (scale > expected / 1.5e0 AND scale < expected * 1.5e0) THEN format('scale {{:.3f}} outside ({{:.3f}}, {{:.3f}})', scale, expected / 1.5e0, expected * 1.5e0) ELSE '' END AS reason, NOT (ncc < 0.3) AND scale > expected / 1.5e0 AND scale < expected * 1.5e0 AS passed FROM k, e")
def registration_gate(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    return rel.gate(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fov"), (F.col("l_discount") * 8).alias("ncc"), (2 + F.col("l_quantity") / 20).alias("scale")))


@register(
    "well_roughness",
    f"""WITH {MOVIE}, im AS (SELECT r * 50 + c AS r, t AS c, v FROM g WHERE v > 0), q AS (SELECT quantile_cont(v, 0.97) AS q FROM im), b AS (SELECT r, c FROM im, q WHERE v > q), m AS (SELECT avg(r) AS mr, avg(c) AS mc FROM b),
a AS (SELECT floor((atan2(r - mr, c - mc) + pi()) / (2 * pi() / 36))::INT AS bin, sqrt((r - mr) ** 2 + (c - mc) ** 2) AS rad FROM b, m), p AS (SELECT bin, quantile_cont(rad, 0.9) AS p FROM a WHERE bin < 36 GROUP BY bin HAVING count(*) >= 2),
n AS (SELECT p, coalesce(lead(p) OVER (ORDER BY bin), first_value(p) OVER (ORDER BY bin)) AS q FROM p) SELECT CASE WHEN count(*) < 36 * 0.7 THEN 'infinity'::DOUBLE ELSE round(avg(abs(q - p)) / (avg(p) + 1e-9), 9) END AS roughness FROM n""",
)
def well_roughness(spark: SparkSession, sf: str) -> DataFrame:
    im = grid_movie(spark, sf).select((F.col("r") * 50 + F.col("c")).alias("r"), F.col("t").alias("c"), "v")
    return rel.roughness(im, bins=36).select(F.round("roughness", 9).alias("roughness"))


@register("spread", f"WITH {MEAN}, k AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS n FROM i) SELECT round(stddev_pop(v) / avg(v), 9) AS cv, round(max(v) - max(v) FILTER (n = 2), 6) AS margin FROM k")
def spread(spark: SparkSession, sf: str) -> DataFrame:
    return rel.spread(mean(spark, sf), "v").select(F.round("cv", 9).alias("cv"), F.round("margin", 6).alias("margin"))


@register("factor_pairs", "SELECT d::BIGINT AS nrow, (374400 // d)::BIGINT AS ncol FROM range(100, 2101) x(d) WHERE 374400 % d = 0 AND 374400 // d BETWEEN 100 AND 2100")
def factor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from glintframe.sources.sidecar import factor_pairs as pairs

    return pairs(spark, 312 * 1200, 100, 2100)
