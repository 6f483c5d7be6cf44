"""Movies of many fields of view as arrays: one row (fov, t, px) for each frame, px its pixels in row-major order.

All fields are worked on at once. What sums over frames is one pass: each task keeps one set of images for each field
that it meets, and only these are shuffled. What needs a field's images at each frame joins them by field. What needs
a pixel's samples in time cuts frames into blocks of pixels, one shuffle; a task then has one block of one field.
Fields may differ in length, not in shape. Null frames (px) are left out; an empty movie gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.kernels import arrays
from glintframe.operators.movie import EPS, Ranges, anchors

#: Pixels of a block, and pixels whose medians are taken at once.
BLOCK = 1024
CHUNK = 64
#: Bytes of all fields' images up to which they are broadcast; beyond, frames are shuffled by field once.
BROADCAST_BYTES = 256 << 20

#: Bytes of a field's frames up to which one task does all stages on it.
FIELD_BYTES = 64 << 20

Images = dict[str, np.ndarray]


def from_raw(frames: DataFrame) -> DataFrame:
    """(fov, t, px) of the raw movie source (file, t, px): each file is a field."""
    return frames.select(F.col("file").alias("fov"), "t", F.col("px").cast("array<double>").alias("px"))


def to_long(frames: DataFrame, width: int) -> DataFrame:
    """(fov, t, r, c, v)."""
    px = frames.select("fov", "t", F.posexplode("px").alias("i", "v"))
    return px.select("fov", "t", F.floor(F.col("i") / width).cast("int").alias("r"), (F.col("i") % width).cast("int").alias("c"), "v")


def images_to_long(images: DataFrame, width: int, *names: str) -> DataFrame:
    """(fov, r, c, names...) of images given as arrays."""
    rows = images.select("fov", F.posexplode(F.arrays_zip(*names)).alias("i", "z"))
    return rows.select("fov", F.floor(F.col("i") / width).cast("int").alias("r"), (F.col("i") % width).cast("int").alias("c"), *[F.col(f"z.{n}").alias(n) for n in names])


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """Stretches of rows of one field."""
    code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist() if len(code) else []
    for a, b in zip(cuts, [*cuts[1:], len(code)], strict=True):
        yield column[a].as_py(), a, b


def reduce_fields(frames: DataFrame, names: list[str], partial: Callable[[np.ndarray, np.ndarray], Images], combine: Callable[[Images, Images], Images]) -> DataFrame:
    """(fov, names array<double>...): images of each field from its frames (px, t), combined in tasks and then by field."""
    kind = frames.schema["fov"].dataType.simpleString()
    schema = f"fov {kind}, " + ", ".join(f"{n} array<double>" for n in names)

    def rows(found: list[tuple[object, Images]], keys: pa.DataType) -> pa.RecordBatch:
        lists = pa.list_(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], keys), *[pa.array([i[n] for _, i in found], lists) for n in names]], ["fov", *names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Images] = {}
        keys = None
        for b in batches:
            keys = b.column(0).type
            for fov, a, e in _runs(b.column(0)):
                new = partial(_stack(b.column(2).slice(a, e - a)), b.column(1).slice(a, e - a).to_numpy())
                held[fov] = combine(held[fov], new) if fov in held else new
        if held:
            yield rows(list(held.items()), keys)

    def field(table: pa.Table) -> pa.Table:
        total: Images | None = None
        for b in table.to_batches():
            for k in range(b.num_rows):
                one = {n: np.asarray(b.column(i + 1)[k].values) for i, n in enumerate(names)}
                total = combine(total, one) if total is not None else one
        return pa.Table.from_batches([rows([(table.column(0)[0].as_py(), total)], table.schema.field(0).type)])

    source = frames.where(F.col("px").isNotNull()).select("fov", "t", "px")
    return source.mapInArrow(task, schema).groupBy("fov").applyInArrow(field, schema)


def with_images(frames: DataFrame, images: DataFrame, names: list[str], kernel: Callable[[np.ndarray, np.ndarray, Images], np.ndarray], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Frames with the pixels that kernel makes of a stretch of a field's frames, its times and the field's images."""
    kind = frames.schema["fov"].dataType.simpleString()
    size = images.agg(F.sum(sum((F.size(n) * 8).cast("long") for n in names))).first()[0] or 0
    side = images.select(F.col("fov").alias("_fov"), *names)
    joined = frames.where(F.col("px").isNotNull()).join(F.broadcast(side) if size <= broadcast_bytes else side, F.col("fov") == F.col("_fov")).select("fov", "t", "px", *names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, a, e in _runs(b.column(0)):
                part = b.slice(a, e - a)
                own = {n: np.asarray(part.column(3 + k)[0].values, float) for k, n in enumerate(names)}
                out = kernel(_stack(part.column(2)), part.column(1).to_numpy(), own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["fov", "t", "px"])

    return joined.mapInArrow(task, f"fov {kind}, t int, px array<double>")


def mean_images(frames: DataFrame) -> DataFrame:
    """(fov, mean array<double>)."""
    add = lambda x, y: {k: x[k] + y[k] for k in x}
    sums = reduce_fields(frames, ["n", "s"], lambda x, _: {"n": np.array([float(len(x))]), "s": x.sum(0)}, add)
    return sums.select("fov", F.transform("s", lambda v: v / F.get("n", F.lit(0))).alias("mean"))


def truncate_last(frames: DataFrame, n: int) -> DataFrame:
    last = frames.groupBy(F.col("fov").alias("_fov")).agg((F.max("t") - n).alias("_last"))
    return frames.join(last, F.col("fov") == F.col("_fov")).where("t <= _last").select("fov", "t", "px")


def reference_images(frames: DataFrame, height: int, width: int, eps: float = EPS) -> DataFrame:
    """(fov, mean, corr, reference): mean and correlation image, cut at 0 over its largest value, and their product.

    One pass: each task has means and co-moments about its own means, which combine exactly.
    """
    shape = (height, width)

    def partial(x: np.ndarray, _: np.ndarray) -> Images:
        mean = x.mean(0)
        d = (x - mean).reshape(-1, *shape)
        right, down = np.zeros(shape), np.zeros(shape)
        right[:, :-1] = (d[:, :, :-1] * d[:, :, 1:]).sum(0)
        down[:-1] = (d[:, :-1] * d[:, 1:]).sum(0)
        return {"n": np.array([float(len(x))]), "mean": mean, "square": (d * d).sum(0).ravel(), "right": right.ravel(), "down": down.ravel()}

    def combine(a: Images, b: Images) -> Images:
        n = a["n"] + b["n"]
        d, k = (b["mean"] - a["mean"]).reshape(shape), a["n"] * b["n"] / n
        right, down = np.zeros(shape), np.zeros(shape)
        right[:, :-1], down[:-1] = d[:, :-1] * d[:, 1:], d[:-1] * d[1:]
        return {
            "n": n, "mean": a["mean"] + d.ravel() * b["n"] / n, "square": a["square"] + b["square"] + k * (d * d).ravel(),
            "right": a["right"] + b["right"] + k * right.ravel(), "down": a["down"] + b["down"] + k * down.ravel(),
        }

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            norm = np.sqrt(np.asarray(r.square)).reshape(shape)
            right, down = np.asarray(r.right).reshape(shape)[:, :-1] / (norm[:, :-1] * norm[:, 1:] + eps), np.asarray(r.down).reshape(shape)[:-1] / (norm[:-1] * norm[1:] + eps)
            corr = np.zeros(shape)
            if height > 2 and width > 2:
                corr[1:-1, 1:-1] = (right[1:-1, 1:] + right[1:-1, :-1] + down[1:, 1:-1] + down[:-1, 1:-1]) / 4
            corr = np.maximum(np.where(norm > 0, corr, 0), 0).ravel()
            corr = corr / corr.max() if corr.max() > 0 else corr
            rows.append({"fov": r.fov, "mean": r.mean, "corr": corr, "reference": np.asarray(r.mean) * corr})
        return pd.DataFrame(rows, columns=["fov", "mean", "corr", "reference"])

    stats = reduce_fields(frames, ["n", "mean", "square", "right", "down"], partial, combine)
    kind = frames.schema["fov"].dataType.simpleString()
    return stats.mapInPandas(lambda it: (finish(p) for p in it if len(p)), f"fov {kind}, mean array<double>, corr array<double>, reference array<double>")


def _slopes(mean: np.ndarray, height: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = mean.reshape(height, width)
    gx, gy = np.zeros_like(m), np.zeros_like(m)
    gx[:, 1:-1], gy[1:-1] = (m[:, 2:] - m[:, :-2]) / 2, (m[2:] - m[:-2]) / 2
    gx[:, 0], gx[:, -1], gy[0], gy[-1] = gx[:, 1], gx[:, -2], gy[1], gy[-2]
    return gx.ravel(), gy.ravel()


def gradients(images: DataFrame, height: int, width: int) -> DataFrame:
    """(fov, gx, gy) of images (fov, mean): central differences; edges take their neighbour's."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.itertuples():
            gx, gy = _slopes(np.asarray(r.mean), height, width)
            rows.append({"fov": r.fov, "gx": gx, "gy": gy})
        return pd.DataFrame(rows, columns=["fov", "gx", "gy"])

    kind = images.schema["fov"].dataType.simpleString()
    return images.select("fov", "mean").mapInPandas(lambda it: (one(p) for p in it if len(p)), f"fov {kind}, gx array<double>, gy array<double>")


def motion_correct(frames: DataFrame, height: int, width: int, truncate: int = 10) -> DataFrame:
    """Each frame less its least-squares fit by the gradients of its field's mean image; least norm if singular."""
    g = gradients(mean_images(truncate_last(frames, truncate)), height, width)
    return with_images(frames, g, ["gx", "gy"], lambda x, _, own: _less_motion(x, own["gx"], own["gy"]))


def _less_motion(x: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    basis = np.stack([gx, gy])
    gram = basis @ basis.T
    return x - (x @ basis.T @ np.linalg.pinv(gram, rcond=1e-14, hermitian=True)) @ basis


def clip_saturation(frames: DataFrame, threshold: float) -> DataFrame:
    return frames.withColumn("px", F.transform("px", lambda v: F.when(v > threshold, 0.0).otherwise(v)))


def _range_sums(x: np.ndarray, t: np.ndarray, ranges: Ranges) -> Images:
    inside = [(t + 1 >= a) & (t + 1 <= b) for a, b in ranges]
    return {"n": np.array([float(k.sum()) for k in inside]), "s": np.concatenate([x[k].sum(0) for k in inside])}


def range_means(frames: DataFrame, ranges: Ranges) -> DataFrame:
    """(fov, means): the mean images of the 1-based inclusive ranges one after the other; frames in several count in
    each."""

    partial = lambda x, t: _range_sums(x, t, ranges)
    add = lambda x, y: {k: x[k] + y[k] for k in x}
    sums = reduce_fields(frames, ["n", "s"], partial, add)
    each = (F.size("s") / len(ranges)).cast("int")
    return sums.select("fov", F.transform("s", lambda v, i: v / F.get("n", F.floor(i / each).cast("int"))).alias("means"))


def subtract_background(frames: DataFrame, samples: DataFrame, ranges: Ranges) -> DataFrame:
    """Frames less the samples (fov, means), interpolated between the ranges' middle frames, clamped at both ends."""
    return with_images(frames, samples, ["means"], lambda x, t, own: _less_background(x, t, own["means"], ranges))


def _less_background(x: np.ndarray, t: np.ndarray, means: np.ndarray, ranges: Ranges) -> np.ndarray:
    at = np.array(anchors(ranges))
    means = means.reshape(len(at), -1)
    f = t + 1.0
    before = np.clip(np.searchsorted(at, f, "right") - 1, 0, len(at) - 1)
    after = np.minimum(before + 1, len(at) - 1)
    gap = np.maximum(at[after] - at[before], 1.0)
    weight = np.clip(np.where(after > before, (f - at[before]) / gap, 0.0), 0.0, 1.0)[:, None]
    return x - ((1 - weight) * means[before] + weight * means[after])


def pixel_blocks(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """(fov, block, t, y): each frame cut into runs of pixels."""
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("px") / block).cast("int") - 1), lambda k: F.slice("px", k * block + 1, block))
    return frames.where(F.size("px") > 0).select("fov", "t", F.posexplode(cut).alias("block", "y"))


def _in_time(blocks: DataFrame, schema: str, kernel: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Rows (fov, block, t, y) that kernel makes of a block's times and its samples (times, pixels)."""

    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("t")
        t = table["t"].to_numpy()
        out = list(kernel(t, _stack(table["y"].combine_chunks())))
        n = len(out)
        head = table.slice(0, 1).take(pa.array(np.zeros(n, np.int64)))
        return pa.table({"fov": head["fov"], "block": head["block"], "t": pa.array([k for k, _ in out], pa.int32()), "y": pa.array([v for _, v in out], pa.list_(pa.float64()))})

    return blocks.groupBy("fov", "block").applyInArrow(task, schema)


def _block_schema(frames: DataFrame) -> str:
    return f"fov {frames.schema['fov'].dataType.simpleString()}, block int, t int, y array<double>"


def filtered_blocks(frames: DataFrame, window: int = 8, block: int = BLOCK) -> DataFrame:
    """(fov, block, t, y): moving median of each pixel less the sample."""

    return _in_time(pixel_blocks(frames, block), _block_schema(frames), lambda t, x: zip(t.tolist(), _less_median(x, window), strict=True))


def _less_median(x: np.ndarray, window: int) -> np.ndarray:
    out = np.empty_like(x)
    for a in range(0, x.shape[1], CHUNK):
        part = x[:, a : a + CHUNK].T
        out[:, a : a + CHUNK] = (arrays.moving_median(part, window) - part).T
    return out


def process(frames: DataFrame, height: int, width: int, ranges: Ranges, clip: float, window: int = 8, truncate: int = 10, block: int = BLOCK, field_bytes: int = FIELD_BYTES) -> DataFrame:
    """(fov, block, t, y): frames without background and motion, saturated pixels cleared, and filtered in time.

    One task does all stages on a field of up to field_bytes: its frames are shuffled once and nothing is written between.
    Larger fields go through the stages one by one. frames are read more than once.
    """
    from glintframe.sources.shared import checkpointed

    frames = frames.where(F.col("px").isNotNull())
    size = frames.groupBy(F.col("fov").alias("_fov")).agg((F.count("*") * height * width * 8).alias("_size"))
    large = checkpointed(size.where(F.col("_size") > field_bytes).select("_fov"))
    many = not large.isEmpty()
    small = frames.join(large, F.col("fov").eqNullSafe(F.col("_fov")), "left_anti") if many else frames

    def field(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("t")
        t, x = table["t"].to_numpy(), _stack(table["px"].combine_chunks())
        sums = _range_sums(x, t, ranges)
        if not sums["n"].all():
            raise ZeroDivisionError("a field has a range without frames")
        x = _less_background(x, t, sums["s"] / np.repeat(sums["n"], x.shape[1]), ranges)
        x = _less_motion(x, *_slopes(x[t <= t.max() - truncate].mean(0), height, width)) if (t <= t.max() - truncate).any() else x[:0]
        t = t[: len(x)]
        x = _less_median(np.where(x > clip, 0.0, x), window) if len(x) else x
        rows = np.tile(np.arange(len(t)), -(-x.shape[1] // block))
        cuts = range(0, x.shape[1], block)
        y = [x[i, a : a + block] for a in cuts for i in range(len(t))]
        head = table["fov"].combine_chunks().take(pa.array(np.zeros(len(rows), np.int64)))
        return pa.table({"fov": head, "block": pa.array(np.repeat(np.arange(len(cuts)), len(t)), pa.int32()), "t": pa.array(t[rows], pa.int32()), "y": pa.array(y, pa.list_(pa.float64()))})

    out = small.select("fov", "t", "px").groupBy("fov").applyInArrow(field, _block_schema(frames))
    if not many:
        return out
    big = frames.join(large, F.col("fov").eqNullSafe(F.col("_fov"))).select("fov", "t", "px")
    big = checkpointed(subtract_background(big, range_means(big, ranges), ranges))
    return out.unionByName(filtered_blocks(clip_saturation(motion_correct(big, height, width, truncate), clip), window, block))


def noise_blocks(filtered: DataFrame, ranges: Ranges, floor_pct: float = 5.0) -> DataFrame:
    """(fov, block, y): robust sigma of each pixel on the ranges, at least the floor percentile of the field's positive
    ones; 1 if the field has none."""

    def kernel(t: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        x = np.concatenate([x[(t + 1 >= a) & (t + 1 <= b)] for a, b in ranges])
        if len(x):
            yield 0, 1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)

    sigma = _in_time(filtered, _block_schema(filtered), kernel)
    floor = sigma.select(F.col("fov").alias("_fov"), F.explode("y").alias("s")).groupBy("_fov").agg(F.percentile(F.when(F.col("s") > 0, F.col("s")), floor_pct / 100).alias("_f"))
    lifted = F.transform("y", lambda s: F.when(F.col("_f").isNull(), 1.0).otherwise(F.greatest(s, F.col("_f"))))
    return sigma.join(floor, F.col("fov") == F.col("_fov")).select("fov", "block", lifted.alias("y"))


def blocks_to_long(blocks: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(fov, t if there is one, r, c, v)."""
    keep = ["fov", *[c for c in ("t",) if c in blocks.columns]]
    i = F.col("block") * block + F.col("i")
    rows = blocks.select(*keep, "block", F.posexplode("y").alias("i", "v"))
    return rows.select(*keep, F.floor(i / width).cast("int").alias("r"), (i % width).cast("int").alias("c"), "v")
