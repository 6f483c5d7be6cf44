"""From regions to footprints and traces: spikes and clusters of each region, footprints, least-squares traces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.kernels import arrays, regions
from glintframe.params import Params

PARTS = "kind string, region_id int, k int, r int, c int, t int, v double, x double, y double"


def extract_regions(filtered: DataFrame, props: DataFrame, patches: DataFrame, params: Params, height: int, width: int, n_frames: int) -> DataFrame:
    """Spikes, centres of mass and footprints of every region in one long table, see kernels.regions.extract.

    Only the patches' pixels are taken from the filtered movie (t, r, c, v), by a semi-join before its samples are
    collected, and each region meets its own small row by a cogroup. One task works on one region at a time.
    """
    small = patches.join(props.select("region_id", "cx", "cy", "pixels"), "region_id")
    # A patch covers a known set of pixels: an equi-join on pixels instead of a range join with the movie.
    cells = small.select("region_id", F.explode(F.sequence("row0", "row1")).alias("_r"), "col0", "col1").select("region_id", (F.col("_r") - 1).alias("r"), F.explode(F.sequence(F.col("col0") - 1, F.col("col1") - 1)).alias("c"))
    wanted = filtered.join(cells.select("r", "c").distinct(), ["r", "c"], "left_semi")
    series = wanted.groupBy("r", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("y"))
    rows = series.join(cells, ["r", "c"]).select("region_id", "r", "c", "y")

    def work(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "k", "r", "c", "t", "v", "x", "y"]
        if not len(pdf) or not len(own):
            frame = pd.DataFrame([], columns=names)
            frame.insert(1, "region_id", [])
            return frame
        head = own.iloc[0]
        r0, r1, c0, c1 = (int(head[n]) - 1 for n in ("row0", "row1", "col0", "col1"))
        patch = np.zeros((n_frames, r1 - r0 + 1, c1 - c0 + 1))
        patch[:, pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = np.stack(pdf["y"].to_numpy()).T
        mask = np.zeros(patch.shape[1:], bool)
        for p in head["pixels"]:
            mask[int(p["row"]) - 1 - r0, int(p["col"]) - 1 - c0] = True
        out = regions.extract(patch, mask, (r0, c0), (float(head["cy"]), float(head["cx"])), params, height, width)
        frame = pd.DataFrame(out, columns=names)
        frame.insert(1, "region_id", int(head["own_id"]))
        return frame

    own = small.select(F.col("region_id").alias("own_id"), "row0", "row1", "col0", "col1", "cx", "cy", "pixels")
    return rows.groupBy("region_id").cogroup(own.groupBy("own_id")).applyInPandas(work, PARTS)


def cells(parts: DataFrame) -> DataFrame:
    """(cell_id, region_id, k, row, col): centres of all footprints, numbered by region and cluster."""
    from pyspark.sql import Window

    # Cells are few: their numbers are ranks in one small partition.
    n = F.row_number().over(Window.orderBy("region_id", "k")) - 1
    return parts.where("kind = 'centre'").select(n.alias("cell_id"), "region_id", "k", F.col("x").alias("row"), F.col("y").alias("col"))


def footprints(parts: DataFrame, cell: DataFrame) -> DataFrame:
    """(cell_id, r, c, w): the footprints' pixels that aren't 0."""
    p = parts.where("kind = 'footprint' and v <> 0").select("region_id", "k", "r", "c", F.col("v").alias("w"))
    return p.join(cell.select("cell_id", "region_id", "k"), ["region_id", "k"]).select("cell_id", "r", "c", "w")


def gram(footprint: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(i, j, g): sums over pixels of the products of two cells' weights, with 1 / sigma² of (r, c, v) if given."""
    left = footprint if weight is None else footprint.join(weight, ["r", "c"]).select("cell_id", "r", "c", (F.col("w") / (F.col("v") * F.col("v"))).alias("w"))
    other = footprint.select(F.col("cell_id").alias("j"), "r", "c", F.col("w").alias("w2"))
    return left.join(other, ["r", "c"]).groupBy(F.col("cell_id").alias("i"), "j").agg(F.sum(F.col("w") * F.col("w2")).alias("g"))


def projections(movie: DataFrame, footprint: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(cell_id, t, b): each frame's weighted sum under each footprint, with the sign turned."""
    f = footprint if weight is None else footprint.join(weight, ["r", "c"]).select("cell_id", "r", "c", (F.col("w") / (F.col("v") * F.col("v"))).alias("w"))
    return movie.join(f, ["r", "c"]).groupBy("cell_id", "t").agg(F.sum(-F.col("w") * F.col("v")).alias("b"))


def coupled(g: DataFrame) -> DataFrame:
    """(cell_id, group): cells whose footprints meet, directly or through others, under their smallest id.

    The pairs that meet, a few for each cell of a movie and no samples, are one task's.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([pdf["i"], pdf["j"]]), return_inverse=True)
        i, j = at[: len(pdf)], at[len(pdf) :]
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = new[new]
            if (new == label).all():
                return pd.DataFrame({"cell_id": ids, "group": ids[label]})
            label = new

    return g.where("g <> 0 or i = j").select("i", "j").groupBy().applyInPandas(work, "cell_id int, group int")


def _solve(b: DataFrame, g: DataFrame, invert: Callable[[np.ndarray, float], np.ndarray]) -> DataFrame:
    """Traces of each group of coupled cells, in a task of its own: the inverse of its matrix times its projections.

    invert gets the matrix and the mean of the diagonal over all cells.
    """
    group = coupled(g)
    mean = g.where("i = j").agg(F.avg("g").alias("mean"))
    of = group.select(F.col("cell_id").alias("i"), F.col("group").alias("own_group"))
    own = g.join(of, "i").crossJoin(F.broadcast(mean))
    kinds = "cell_id int, t int, v double"

    def work(rows: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(matrix):
            return pd.DataFrame({"cell_id": [], "t": [], "v": []})
        ids, at = np.unique(np.concatenate([matrix["i"], matrix["j"]]), return_inverse=True)
        m = np.zeros((len(ids), len(ids)))
        m[at[: len(matrix)], at[len(matrix) :]] = matrix["g"]
        times, when = np.unique(rows["t"], return_inverse=True)
        v = np.zeros((len(ids), len(times)))
        v[np.searchsorted(ids, rows["cell_id"]), when] = rows["b"]
        y = invert(m, float(matrix["mean"].iloc[0])) @ v
        return pd.DataFrame({"cell_id": np.repeat(ids, len(times)), "t": np.tile(times, len(ids)), "v": y.ravel()})

    return b.join(group, "cell_id").groupBy("group").cogroup(own.groupBy("own_group")).applyInPandas(work, kinds)


def pinv_traces(movie: DataFrame, footprint: DataFrame) -> DataFrame:
    """(cell_id, t, v): pseudoinverse of the footprints times the negative movie, through the cells' Gram matrix.

    The matrix falls into blocks of cells whose footprints meet; each is inverted where its traces are made. Directions
    whose eigenvalue is under 1e-12 of the block's largest count as absent: the square of the singular values' cut-off
    is below what doubles resolve.
    """
    return _solve(projections(movie, footprint), gram(footprint), lambda m, _: np.linalg.pinv(m, rcond=1e-12, hermitian=True))


def gls_traces(movie: DataFrame, footprint: DataFrame, noise: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """(cell_id, t, v): noise-weighted least squares with a ridge of this share of the mean diagonal of all cells."""
    return _solve(projections(movie, footprint, noise), gram(footprint, noise), lambda m, mean: np.linalg.inv(m + ridge * mean * np.eye(len(m))))


def cell_traces(movie: DataFrame, footprint: DataFrame, params: Params, noise: DataFrame | None = None) -> DataFrame:
    """Plain traces, or weighted ones for all cells or for those whose boxes meet no other."""
    from glintframe.operators.relational import isolated

    plain = pinv_traces(movie, footprint)
    if not params.whiten_traces:
        return plain
    if noise is None:
        raise ValueError("weighted traces need a noise map")
    gls = gls_traces(movie, footprint, noise, params.whiten_ridge)
    if not params.whiten_isolated_only:
        return gls
    boxes = footprint.groupBy(F.col("cell_id").alias("id")).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    alone = isolated(boxes).where("isolated").select(F.col("id").alias("cell_id"))
    return gls.join(alone, "cell_id", "left_semi").unionByName(plain.join(alone, "cell_id", "left_anti"))


def dbscan(points: DataFrame, eps: float = 1.5, least: int = 3) -> DataFrame:
    """(key, id, label) for points (key, id, x, y) of each key, in order of id; -1 is noise."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pdf[["key", "id"]].assign(label=arrays.dbscan(pdf[["x", "y"]].to_numpy(float), eps, least))

    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.groupBy("key").applyInPandas(work, f"key {kinds['key']}, id {kinds['id']}, label int")
