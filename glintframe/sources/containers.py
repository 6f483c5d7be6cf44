"""Array files as tables: HDF5 and TIFF through Spark's binaryFile source, one file a task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from glintframe.kernels import hdf5


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "content")


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(path, name, shape, dtype, values): one row for each array, values in C order; members of groups have names
    with slashes."""

    def walk(tree: dict, prefix: str = "") -> Iterator[tuple[str, np.ndarray]]:
        for n, v in tree.items():
            if isinstance(v, dict):
                yield from walk(v, f"{prefix}{n}/")
            elif v.dtype.kind in "iufb":
                yield prefix + n, v

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p, n, list(v.shape), v.dtype.name, v.ravel().astype(float)) for n, v in walk(hdf5.read(bytes(c))) if names is None or n in names]
                yield pd.DataFrame(rows, columns=["path", "name", "shape", "dtype", "values"])

    return _files(spark, path, glob).mapInPandas(work, "path string, name string, shape array<bigint>, dtype string, values array<double>")


def read_stage_positions(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, x, y) of the stage controller in each file; a file without one is an error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = [hdf5.stage_position(hdf5.read(bytes(c))) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "x": [p[0] for p in at], "y": [p[1] for p in at]})

    return _files(spark, path, glob).mapInPandas(work, "path string, x double, y double")


def decode_tiff(data: bytes) -> np.ndarray:
    """(pages, rows, columns) of an uncompressed grey TIFF with strips."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    sizes = {1: "B", 3: "H", 4: "I"}
    at, pages = struct.unpack_from(order + "I", data, 4)[0], []
    while at:
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in sizes:
                step = struct.calcsize(sizes[kind])
                place = at + 10 + 12 * k
                if count * step > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{sizes[kind]}", data, place)
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF is not supported")
        width, height, bits = tags[256][0], tags[257][0], tags.get(258, (1,))[0]
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        raw = b"".join(data[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
        pages.append(np.frombuffer(raw, f"{order}{kind}{bits // 8}", width * height).reshape(height, width))
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return np.stack(pages)


def read_tiles(spark: SparkSession, path: str, pattern: str = r"(\d+)\.tiff?$", glob: str | None = None) -> DataFrame:
    """(tile, ch, r, px): one row for each image row; the tile's number comes from the file's name."""
    import re

    find = re.compile(pattern)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                found = find.search(p)
                if not found:
                    raise ValueError(f"no tile number in {p}")
                a = decode_tiff(bytes(c)).astype(np.int32)
                ch, r = (i.ravel() for i in np.mgrid[0 : a.shape[0], 0 : a.shape[1]])
                yield pd.DataFrame({"tile": int(found[1]), "ch": ch, "r": r, "px": list(a.reshape(-1, a.shape[2]))})

    return _files(spark, path, glob).mapInPandas(work, "tile int, ch int, r int, px array<int>")


def orient(traces: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Traces as (cells, frames) and centres as (cells, 2), whichever way round they come: centres have two columns, and
    traces as many rows as there are centres."""
    if centres.shape[1] != 2 and centres.shape[0] == 2:
        centres = centres.T
    if traces.shape[0] != centres.shape[0] and traces.shape[1] == centres.shape[0]:
        traces = traces.T
    if traces.shape[0] != centres.shape[0]:
        raise ValueError(f"{traces.shape} traces don't go with {centres.shape} centres")
    return traces, centres


def read_result(spark: SparkSession, path: str, traces: str = "cell_traces", centres: str = "footprint_center", glob: str | None = None) -> DataFrame:
    """(path, cell_id, row, col, y): the cells of stored results, one row each, of every file of a path. Arrays were
    stored with their dimensions reversed and are turned round; see ``orient``. Files without both arrays have no rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                tree = hdf5.read(bytes(c))
                if traces not in tree or centres not in tree:
                    continue
                y, at = orient(np.atleast_2d(np.asarray(tree[traces], float).T), np.atleast_2d(np.asarray(tree[centres], float).T))
                yield pd.DataFrame({"path": p, "cell_id": np.arange(len(y)), "row": at[:, 0], "col": at[:, 1], "y": list(y)})

    return _files(spark, path, glob).mapInPandas(work, "path string, cell_id int, row double, col double, y array<double>")
