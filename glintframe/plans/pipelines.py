"""The three lifecycles: movie to traces, tiles and fields to transforms, and two runs to a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import blocks, extraction, images, movie as mv
from glintframe.params import Params
from glintframe.sources.shared import checkpointed


def process_movie(movie: DataFrame, height: int, width: int, params: Params | None = None) -> dict[str, DataFrame]:
    """All results of one movie (t, r, c, v) as tables.

    Reference and correlation image of the first frames, sharpened image, background and motion removed, saturated
    pixels cleared, regions, spikes, centres, footprints, and one trace for each cell. The corrected and the
    filtered movie are the two large tables; they are checkpointed once and each is read by pixel from then on.
    """
    p = params or Params()
    raw = mv.truncate_last(movie, p.truncate_last)
    n = raw.agg(F.max("t") + 1).first()[0]
    p = p.clamped(n)
    reference = checkpointed(mv.reference_image(mv.first_frames(raw, p.n_ref), width))
    sharp = checkpointed(images.sharpen(reference.select("r", "c", "v"), height, width, k=p.sharpen_k, alpha=p.lap_alpha, sigma=p.gauss_sigma, disk_radius=p.disk_radius))
    means = mv.range_means(raw, p.bkg_ranges)
    opened = None
    for k in range(len(p.bkg_ranges)):
        one = blocks.opening_kernel(means.where(F.col("range_id") == k).drop("range_id"), p.disk_radius, height, width).select(F.lit(k).alias("range_id"), "r", "c", "v")
        opened = one if opened is None else opened.unionAll(one)
    corrected = mv.subtract_background(raw, checkpointed(opened), p.bkg_ranges) if opened is not None else raw
    corrected = checkpointed(mv.clip_saturation(mv.motion_correct(corrected, p.truncate_last), p.saturation_clip))
    binary = images.binarise(sharp.select("r", "c", F.col("sharpened").alias("v")), height, width, p.seg_gauss)
    props = checkpointed(images.region_props(images.components(binary, width), p.seg_region_size))
    patches = images.compute_patch(props, *p.patch_size, height, width)
    filtered = checkpointed(mv.temporal_filter(corrected, p.filter_window))
    parts = checkpointed(extraction.extract_regions(filtered, props, patches, p, height, width, n))
    cell = extraction.cells(parts)
    footprint = checkpointed(extraction.footprints(parts, cell))
    noise = mv.pixel_noise_map(filtered, p.std_ranges, p.whiten_sigma_floor_pct) if p.whiten_traces else None
    traces = extraction.cell_traces(corrected, footprint, p, noise)
    return {
        "reference": reference, "sharpened": sharp, "regions": props, "cells": cell, "footprint": footprint, "traces": traces,
        "spikes": parts.where("kind = 'spike'").select("region_id", "r", "c", "t", F.col("v").alias("amplitude")),
        "coms": parts.where("kind = 'com'").select("region_id", F.col("x").alias("row"), F.col("y").alias("col"), "t"),
    }


def write_results(results: dict[str, DataFrame], path: str) -> None:
    """One parquet directory for each table."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def process_folder(spark, fov_dir: str, out_dir: str, params: Params | None = None, name: str = "frames1.bin") -> None:
    """One field of view: shape from the sidecar or the data, all results written as tables."""
    from glintframe.sources import raw_movie

    p = params or Params()
    pixels = raw_movie.detect_pixels(spark, fov_dir, name)
    nrow, ncol = p.nrow, p.ncol
    if nrow * ncol != pixels:
        best = raw_movie.recover_dims(spark, f"{fov_dir}/{name}", pixels).first()
        nrow, ncol = best["nrow"], best["ncol"]
    movie = raw_movie.to_long(raw_movie.read_frames(spark, f"{fov_dir}/{name}", nrow, ncol), ncol)
    write_results(process_movie(movie, nrow, ncol, p), out_dir)


def process_folders(spark, root: str, params: Params | None = None, name: str = "frames1.bin") -> DataFrame:
    """(folder, error): every sub-folder in order of name, a failure noted and the others done."""
    import os

    rows = []
    for d in sorted(e.name for e in os.scandir(root) if e.is_dir()):
        try:
            process_folder(spark, f"{root}/{d}", f"{root}/{d}/analysis", params, name)
            rows.append((d, None))
        except Exception as e:  # noqa: BLE001 - one field's failure must not stop the others
            rows.append((d, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, "folder string, error string")
