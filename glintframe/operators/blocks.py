"""Operators that run a numpy kernel on one image or one block of pixels per task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.kernels import arrays


def opening_kernel(image: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Grey opening with the octagon in strips: a strip of rows with the margin that it needs is one task.

    The opening of a row depends on the rows within 2 * (radius - 1); near the image's edge those are mirrored, and
    each strip holds the rows that the mirror shows.
    """
    reach = 2 * (radius - 1)
    rows = max(4 * reach, 64)
    strips = -(-height // rows)
    need = F.array_distinct(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.floor(F.least(F.greatest(F.col("r") + k, F.lit(0)), F.lit(height - 1)) / rows).cast("int")))
    sent = image.select("r", "c", "v", F.explode(need).alias("strip")) if strips > 1 else image.select("r", "c", "v", F.lit(0).alias("strip"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        a, b = max(s * rows - reach, 0), min((s + 1) * rows + reach, height)
        img = np.zeros((b - a, width))
        img[pdf["r"].to_numpy() - a, pdf["c"].to_numpy()] = pdf["v"].to_numpy()
        out = arrays.grey_opening(img, arrays.octagon(radius))
        lo, hi = s * rows, min((s + 1) * rows, height)
        r, c = np.mgrid[lo:hi, 0:width]
        return pd.DataFrame({"r": r.ravel(), "c": c.ravel(), "v": out[lo - a : hi - a].ravel()})

    return sent.groupBy("strip").applyInPandas(work, "r int, c int, v double")


def filter_pixels(pixels: DataFrame, window: int = 8) -> DataFrame:
    """Moving median less the samples on the array form (pix, y array<double>): batches of pixels, no shuffle."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf["y"] = [arrays.moving_median(y, window) - y for y in pdf["y"]]
            yield pdf

    return pixels.mapInPandas(work, pixels.schema)


def to_pixel_major(movie: DataFrame, width: int) -> DataFrame:
    """Long movie to one array of samples for each pixel, in order of time; one shuffle."""
    pix = (F.col("r") * width + F.col("c")).alias("pix")
    return movie.groupBy(pix).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("y"))
