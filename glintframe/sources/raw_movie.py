"""Raw movies as a Spark data source: little-endian 16-bit samples, frame after frame, rows within a frame."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


class _Frames(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


class RawMovieReader(DataSourceReader):
    """A partition for each block of frames; filters on t choose blocks before anything is read."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.nrow, self.ncol = int(options["nrow"]), int(options["ncol"])
        self.block = int(options.get("frames_per_partition", max(1, (32 << 20) // (2 * self.nrow * self.ncol))))
        self.first, self.last = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("t",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    end = f.value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            yield f  # Spark still checks each row

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".bin")) if os.path.isdir(self.path) else [self.path]
        out = []
        for p in files:
            n = os.path.getsize(p) // (2 * self.nrow * self.ncol)  # a partial last frame is left out
            end = n if self.last is None else min(n, self.last)
            out += [_Frames(p, a, min(a + self.block, end)) for a in range(max(self.first, 0), end, self.block)]
        return out

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        size = self.nrow * self.ncol
        step = max(1, (8 << 20) // (4 * size))
        with open(partition.path, "rb") as f:
            f.seek(partition.first * size * 2)
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                px = np.frombuffer(f.read(n * size * 2), "<u2").astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(px))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(np.arange(a, a + n, dtype=np.int32)), lists], ["file", "t", "px"])


class RawMovie(DataSource):
    """Options: path (a file or a folder of .bin files that every executor sees), nrow, ncol, frames_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "rawmovie"

    def schema(self) -> str:
        return "file string, t int, px array<int>"

    def reader(self, schema) -> RawMovieReader:
        return RawMovieReader(self.options)


def read_frames(spark: SparkSession, path: str, nrow: int, ncol: int, **options) -> DataFrame:
    """(file, t, px): one row for each whole frame."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawMovie)
    r = spark.read.format("rawmovie").option("path", path).option("nrow", nrow).option("ncol", ncol)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def to_long(frames: DataFrame, ncol: int) -> DataFrame:
    """(t, r, c, v) of frames (t, px)."""
    px = frames.select("t", F.posexplode("px").alias("i", "v"))
    return px.select("t", F.floor(F.col("i") / ncol).cast("int").alias("r"), (F.col("i") % ncol).alias("c"), F.col("v").cast("double").alias("v"))


def mean_frame(frames: DataFrame, n_ref: int) -> DataFrame:
    """(i, v): mean of the first n_ref frames by pixel, as float; the filter on t reaches the source."""
    px = frames.where(F.col("t") < n_ref).select(F.posexplode("px").alias("i", "v"))
    return px.groupBy("i").agg(F.avg("v").cast("float").alias("v"))


def recover_dims(spark: SparkSession, path: str, pixels: int, lo: int = 100, hi: int = 2100, probe: int = 5) -> DataFrame:
    """(nrow, ncol, score) of all shapes of a frame, the smoothest first, by the first frames."""
    from glintframe.operators.movie import smoothness
    from glintframe.sources.sidecar import factor_pairs

    frames = read_frames(spark, path, 1, pixels).where(F.col("t") < probe).select("t", F.posexplode("px").alias("i", "v"))
    pairs = [(r["nrow"], r["ncol"]) for r in factor_pairs(spark, pixels, lo, hi).collect()]
    if not pairs:
        raise ValueError(f"no two numbers in [{lo}, {hi}] give {pixels} pixels")
    return smoothness(frames.withColumn("v", F.col("v").cast("double")), pairs).orderBy(F.col("score").desc(), F.col("nrow").desc())


def _adjacent(img: np.ndarray) -> float:
    """Mean of the correlations of horizontal and vertical neighbours."""
    out = []
    for a, b in ((img[:, :-1], img[:, 1:]), (img[:-1], img[1:])):
        x, y = a.ravel() - a.mean(), b.ravel() - b.mean()
        d = np.sqrt((x * x).sum() * (y * y).sum())
        out.append(float((x * y).sum() / d) if d > 0 else 0.0)
    return sum(out) / 2


def search_shapes(spark: SparkSession, path: str, lo: int = 100, hi: int = 2100) -> DataFrame:
    """(pixels, nrow, ncol, score) of every shape that divides the file into whole frames, the smoothest first.

    For files without a sidecar. Shapes are rows of a table, each scored on the first two frames by one task.
    """
    total = os.path.getsize(path) // 2
    sizes = [n for n in range(lo * lo, min(hi * hi, total // 2) + 1) if total % n == 0]
    shapes = [(n, r, n // r) for n in sizes for r in range(lo, hi + 1) if n % r == 0 and lo <= n // r <= hi]
    if not shapes:
        raise ValueError("no shape within the limits divides the file")

    def score(batches):
        for pdf in batches:
            got = []
            for n, r, c in pdf[["pixels", "nrow", "ncol"]].itertuples(index=False):
                raw = np.fromfile(path, "<u2", 2 * n).astype(float)
                got.append(np.mean([_adjacent(f.reshape(r, c)) for f in raw.reshape(-1, n)]))
            yield pdf.assign(score=got)

    table = spark.createDataFrame(shapes, "pixels long, nrow long, ncol long")
    return table.mapInPandas(score, "pixels long, nrow long, ncol long, score double").orderBy(F.col("score").desc(), "pixels", "nrow")


def detect_pixels(spark: SparkSession, folder: str, name: str, lo: int = 100, hi: int = 2100) -> int:
    """Pixels of a frame: what a sidecar says, else those of the smoothest shape."""
    from glintframe.sources.sidecar import frame_pixels

    if any(n.endswith(".txt") for n in os.listdir(folder)):
        found = frame_pixels(spark, folder, os.path.splitext(name)[0]).first()
        if found:
            return int(found["pixels"])
    return int(search_shapes(spark, os.path.join(folder, name), lo, hi).first()["pixels"])
