"""Registration of fields of view to a mosaic: candidate tables whose rows are scored by numpy kernels.

A field of view is a row (fov, stage_x, stage_y, h, w, px array<double>), row-major. Search runs on the mosaic
downscaled by f, which is small by construction and checked before it is broadcast; fine registration takes only
the window around each predicted place, by an equi-join on blocks of pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.kernels import registration as reg
from glintframe.operators.relational import block_downscale, fit_similarity, gate

FOV = "fov int, stage_x double, stage_y double, h int, w int, px array<double>"
#: Pixels of a downscaled mosaic up to which it is sent to every task (8 bytes each).
BROADCAST_PIXELS = 32_000_000
BLOCK = 512


def small_mosaic(mosaic: DataFrame, f: int) -> np.ndarray:
    """The downscaled, band-passed mosaic (r, c, v) as an array on the driver."""
    small = block_downscale(mosaic, f)
    h, w = small.agg(F.max("r") + 1, F.max("c") + 1).first()
    if h * w > BROADCAST_PIXELS:
        raise ValueError(f"a mosaic of {h} by {w} after downscaling by {f} is too large to search: downscale more")
    pdf = small.toPandas()
    out = np.zeros((h, w))
    out[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf["v"].to_numpy()
    return reg.band_pass(out)


def localize(fovs: DataFrame, small: np.ndarray, f: int, ops: tuple[str, ...] = tuple(reg.DIHEDRAL), scales: tuple[float, ...] = reg.SCALES) -> DataFrame:
    """(fov, op, ordinal, ncc, scale, x, y): each field's best scale and place under each operation, x and y in full
    pixels. A row for each candidate (field, operation, scale) is scored on its own."""
    shared = fovs.sparkSession.sparkContext.broadcast(small)
    op = F.explode(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(o).alias("op")) for k, o in enumerate(ops)])).alias("o")
    scale = F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale")
    candidates = fovs.select("fov", "h", "w", "px", op).select("fov", "h", "w", "px", "o.ordinal", "o.op", scale)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                img = reg.DIHEDRAL[r.op](np.asarray(r.px, float).reshape(r.h, r.w))
                s, v, at = reg.localize(shared.value, img, f, (r.scale,))
                out.append((r.fov, r.ordinal, r.op, max(v, -2.0), s, at[0] * f, at[1] * f))
            yield pd.DataFrame(out, columns=["fov", "ordinal", "op", "ncc", "scale", "x", "y"])

    n = fovs.sparkSession.sparkContext.defaultParallelism
    scored = candidates.repartition(n, "fov", "op", "scale").mapInPandas(score, "fov int, ordinal int, op string, ncc double, scale double, x double, y double")
    w = Window.partitionBy("fov", "op").orderBy(F.col("ncc").desc(), "scale")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recover_dihedral(fov: DataFrame, small: np.ndarray, f: int, scales: tuple[float, ...] = reg.SCALES) -> DataFrame:
    """(op, ncc) of one field, the best first."""
    return localize(fov, small, f, scales=scales).orderBy(F.col("ncc").desc(), "ordinal").select("op", "ncc")


def global_register(fovs: DataFrame, small: np.ndarray, op: str, f: int, min_ncc: float = 0.30, scale_tol: float = 0.5, scales: tuple[float, ...] = reg.SCALES) -> tuple[np.ndarray | None, float | None, DataFrame]:
    """Similarity from stage to mosaic through the fields that pass the gates, the median scale, and the report.

    None instead of a matrix if fewer than two pass.
    """
    from glintframe.sources.shared import checkpointed

    found = localize(fovs, small, f, (op,), scales)
    report = checkpointed(gate(found, min_ncc, scale_tol))
    good = report.where("passed").join(fovs.select("fov", "stage_x", "stage_y"), "fov")
    fit = fit_similarity(good.select(F.col("stage_x").alias("x"), F.col("stage_y").alias("y"), F.col("x").alias("u"), F.col("y").alias("v"))).first()
    n, expected = good.count(), report.agg(F.first("expected")).first()[0]
    if n < 2 or fit["a"] is None:
        return None, expected, report
    return np.array([[fit["a"], -fit["b"], fit["tx"]], [fit["b"], fit["a"], fit["ty"]], [0, 0, 1]]), expected, report


def fine_register(fovs: DataFrame, mosaic: DataFrame, s: np.ndarray, op: str, scale: float, half: tuple[int, int] = (1100, 3400)) -> DataFrame:
    """(fov, matrix array<double>, score): each field against the full mosaic (r, c, v) within half a window."""
    size = mosaic.agg(F.max("r") + 1, F.max("c") + 1).first()
    a, b = s[0], s[1]
    rnd = lambda v: F.rint(v).cast("int")
    clip = lambda v, lo, hi: F.least(F.greatest(v, lo if not isinstance(lo, int) else F.lit(lo)), F.lit(hi))
    at = fovs.withColumns({"_x": a[0] * F.col("stage_x") + a[1] * F.col("stage_y") + a[2], "_y": b[0] * F.col("stage_x") + b[1] * F.col("stage_y") + b[2]})
    at = at.withColumns({"r0": clip(rnd(F.col("_y")) - half[0], 0, int(size[0]) - 1), "c0": clip(rnd(F.col("_x")) - half[1], 0, int(size[1]) - 1)})
    at = at.withColumns({"r1": clip(rnd(F.col("_y")) + half[0], F.col("r0") + 1, int(size[0])), "c1": clip(rnd(F.col("_x")) + half[1], F.col("c0") + 1, int(size[1]))})
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / BLOCK).cast("int"), F.floor((F.col(hi) - 1) / BLOCK).cast("int")))
    need = at.select("fov", "r0", "r1", "c0", "c1", span("r0", "r1").alias("br")).select("*", span("c0", "c1").alias("bc"))
    blocks = mosaic.select("r", "c", "v", F.floor(F.col("r") / BLOCK).cast("int").alias("br"), F.floor(F.col("c") / BLOCK).cast("int").alias("bc"))
    window = blocks.join(need, ["br", "bc"]).where("r >= r0 and r < r1 and c >= c0 and c < c1")
    pixels = window.groupBy("fov").agg(F.collect_list(F.struct("r", "c", "v")).alias("win"))
    rows = at.select("fov", "h", "w", "px", "r0", "r1", "c0", "c1").join(pixels, "fov")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                crop = np.zeros((r.r1 - r.r0, r.c1 - r.c0))
                win = pd.DataFrame(list(r.win))
                crop[win["r"].to_numpy() - r.r0, win["c"].to_numpy() - r.c0] = win["v"].to_numpy()
                img = reg.DIHEDRAL[op](np.asarray(r.px, float).reshape(r.h, r.w))
                m, v = reg.register(reg.rescale(img, scale), crop) if img.size else (np.eye(3), -1.0)
                t = reg.compose(reg.translation(r.c0, r.r0), m, reg.prescale_matrix(scale)) if img.size else m
                out.append((r.fov, t.ravel(), v))
            yield pd.DataFrame(out, columns=["fov", "matrix", "score"])

    return rows.mapInPandas(work, "fov int, matrix array<double>, score double")


def down_weight_nuclei(tiles: DataFrame, nuclei: DataFrame, size: int, radius: float = 22.0, alpha: float = 1.0) -> DataFrame:
    """Tiles (tile, r, c, v) less alpha times their part within the nuclei (tile, i, j, area), one tile a task."""

    def work(key: tuple, pix: pd.DataFrame, nuc: pd.DataFrame) -> pd.DataFrame:
        if not len(pix):
            return pix
        rad = np.sqrt(nuc["area"].to_numpy(float) / np.pi)
        rad = np.where(np.isfinite(rad), rad, radius)
        m = reg.nucleus_mask((size, size), np.column_stack([nuc["i"], nuc["j"]]).astype(float), rad, float(np.median(rad) * 0.4) if len(rad) else 0.0)
        pix["v"] = pix["v"] * (1 - alpha * m[pix["r"].to_numpy(), pix["c"].to_numpy()])
        return pix

    return tiles.groupBy("tile").cogroup(nuclei.groupBy("tile")).applyInPandas(work, tiles.schema)
