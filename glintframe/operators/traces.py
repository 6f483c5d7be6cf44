"""Waveform operators on long traces: one row for each sample, with a key, a 0-based index t and a value v.

All of them partition by the key and order by t, so that a chain of them shares one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, T, V = "key", "t", "v"


def _w():
    return Window.partitionBy(K).orderBy(T)


def from_events(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Number each key's rows in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias(K), (F.row_number().over(w) - 1).cast("long").alias(T), F.col(value).cast("double").alias(V))


def moving_median(df: DataFrame, window: int = 8, value: str = V, out: str = "med") -> DataFrame:
    """Median of the window//2 samples before, the sample, and the rest after; shorter at the ends."""
    before = window // 2
    return df.withColumn(out, F.percentile(value, 0.5).over(_w().rowsBetween(-before, window - 1 - before)))


def median_highpass(df: DataFrame, window: int = 8) -> DataFrame:
    """Moving median less the sample: dips become peaks."""
    return moving_median(df, window).withColumn("hp", F.col("med") - F.col(V)).drop("med")


def forward_min_subtract(df: DataFrame, look: int = 5, value: str = V, out: str = "fm") -> DataFrame:
    """The sample less the smallest of the next ones; 0 at the last."""
    return df.withColumn(out, F.coalesce(F.col(value) - F.min(value).over(_w().rowsBetween(1, look)), F.lit(0.0)))


def running_mean_detrend(df: DataFrame, window: int = 60) -> DataFrame:
    """The sample less the mean of the last window samples, itself included."""
    return df.withColumn("detrended", F.col(V) - F.avg(V).over(_w().rowsBetween(-(window - 1), 0)))


def stride(df: DataFrame, step: int, end: int | None = None) -> DataFrame:
    keep = F.col(T) % step == 0
    return df.where(keep if end is None else keep & (F.col(T) < end))


def end_zero(df: DataFrame, half: int, value: str = V) -> DataFrame:
    """Zero the first and last half samples of each trace."""
    n = F.max(T).over(Window.partitionBy(K)) + 1
    return df.withColumn(value, F.when((F.col(T) >= half) & (F.col(T) < n - half), F.col(value)).otherwise(F.lit(0.0)))


def plateaus(df: DataFrame, value: str = V, keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs of equal samples: key, first t, last t, v, the values of the runs before and after, and other columns of
    the first sample."""
    w = _w()
    before = F.lag(value).over(w)
    marked = df.withColumn("_first", before.isNull() | (before != F.col(value))).withColumn("_last", F.max(T).over(Window.partitionBy(K)))
    runs = marked.where("_first")
    return runs.select(
        K,
        F.col(T).alias("t0"),
        (F.coalesce(F.lead(T).over(w) - 1, F.col("_last"))).alias("t1"),
        F.col(value).alias(V),
        F.lag(value).over(w).alias("v_before"),
        F.lead(value).over(w).alias("v_after"),
        *keep,
    )


def find_peaks(df: DataFrame, value: str = V, left_edge: bool = True) -> DataFrame:
    """Strict local maxima, ends excluded; a plateau's place is its left edge, or its middle rounded down."""
    p = plateaus(df, value).where("v_before < v and v_after < v")
    at = F.col("t0") if left_edge else F.floor((F.col("t0") + F.col("t1")) / 2).cast("long")
    return p.select(K, at.alias(T), V)


def tolerance_groups(df: DataFrame, tolerance: float, time: str = T) -> DataFrame:
    """Greedy groups of ascending times: a group takes all within the tolerance of its first. (key, first, last, n).

    Repeated times are equal members; null times have no group. Rows are sorted by key and time within partitions by
    key, and a pass over them in batches goes from group to group, so that many keys share a task and a long one is
    linear in its rows and never in memory as a whole.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[K]
    rows = df.where(F.col(time).isNotNull()).select(K, F.col(time).cast("double").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "first", "last", "n"]

        def out(found: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
            k, first, last, n = zip(*found, strict=True) if found else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, keys), pa.array(first, pa.float64()), pa.array(last, pa.float64()), pa.array(n, pa.int64())], names)

        open_, keys = None, None  # the group that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).type
            code = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            t = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])).tolist()
            found = []
            for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
                key, i = batch.column(0)[a].as_py(), a
                while i < b:
                    goes_on = open_ is not None and open_[0] == key
                    first = open_[1] if goes_on and t[i] - open_[1] <= tolerance else float(t[i])
                    j = int(np.searchsorted(t[i:b], first + tolerance, "right")) + i
                    while j < b and t[j] - first <= tolerance:  # the sum and the difference round apart
                        j += 1
                    while j > i + 1 and t[j - 1] - first > tolerance:
                        j -= 1
                    j = max(j, i + 1)
                    before = open_[3] if goes_on and first == open_[1] and t[i] - open_[1] <= tolerance else 0
                    if open_ is not None and not before:
                        found.append(open_)
                    open_, i = (key, first, float(t[j - 1]), before + j - i), j
            yield out(found, keys)
        if open_ is not None:
            yield out([open_], keys)

    return rows.repartition(K).sortWithinPartitions(K, "t").mapInArrow(work, f"key {kind}, first double, last double, n bigint")


def dedup_close(df: DataFrame, tolerance: float) -> DataFrame:
    """Rows whose time is both the first and the last of its group; all rows of that time stay."""
    alone = tolerance_groups(df, tolerance).where("first = last").select(F.col(K).alias("_k"), F.col("first").alias("_t"))
    return df.join(alone, (F.col(K) == F.col("_k")) & (F.col(T).cast("double") == F.col("_t")), "left_semi")


def robust_sigma(df: DataFrame, value: str = V) -> DataFrame:
    """1.4826 times the median distance from the median, by key."""
    med = df.groupBy(K).agg(F.percentile(value, 0.5).alias("_m"))
    return df.join(med, K).groupBy(K).agg((F.percentile(F.abs(F.col(value) - F.col("_m")), 0.5) * 1.4826).alias("sigma"))


def in_ranges(t: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    """How many 1-based inclusive ranges hold the 0-based index t."""
    return sum((((t + 1) >= a) & ((t + 1) <= b)).cast("int") for a, b in ranges)


def detect_spikes(
    df: DataFrame, window: int = 8, threshold_factor: float = 3.25, min_interval: float = 15, ranges: tuple[tuple[int, int], ...] | None = None, gain: float = 1.0
) -> DataFrame:
    """Spikes of each trace: (key, t, amplitude).

    The median high-pass without its ends is the signal. Its noise is the standard deviation, on the baseline
    ranges or on all samples, of the signal times gain less its forward minimum. Samples under the threshold become
    0; peaks that aren't near the ends move to the first largest sample from 3 before to 2 after, and keep the
    amplitude of the peak. Spikes that share a group with another time go.
    """
    half = round(window / 2)
    s = end_zero(median_highpass(df, window).select(K, T, F.col("hp").alias(V)), half)
    s = forward_min_subtract(s.withColumn("_g", F.col(V) * gain), value="_g", out="_fm")
    sample = F.col("_fm") if ranges is None else F.when(in_ranges(F.col(T), ranges) > 0, F.col("_fm"))
    whole = Window.partitionBy(K)
    s = s.withColumn("_thr", F.stddev_samp(sample).over(whole) * threshold_factor).withColumn("_n", F.max(T).over(whole) + 1)
    cut = s.select(K, T, F.when(F.col(V) < F.col("_thr"), 0.0).otherwise(F.col(V)).alias(V), "_n")
    near = F.array(*[F.struct(F.coalesce(F.lag(V, -k).over(_w()), F.lit(float("-inf"))).alias("v"), F.lit(-k).alias("d")) for k in range(-3, 3)])
    # The first largest is the largest value, then the smallest step.
    cut = cut.withColumn("_to", F.col(T) - F.array_max(near)["d"])
    # A peak's row has its place already, so that the whole chain is windows on one exchange.
    peaks = plateaus(cut, keep=("_to", "_n")).where("v_before < v and v_after < v and t0 > 2 and t0 < _n - 4")
    return dedup_close(peaks.select(K, F.col("_to").alias(T), F.col(V).alias("amplitude")), min_interval)


def find_peaks_distance(df: DataFrame, height: float, distance: int) -> DataFrame:
    """Peaks at plateau middles with v >= height, thinned: the largest first, others nearer than distance go."""
    from glintframe.kernels.signal import thin_peaks

    peaks = find_peaks(df, left_edge=False).where(F.col(V) >= height)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(T)
        return pdf[thin_peaks(pdf[T].to_numpy(), pdf[V].to_numpy(), distance)]

    return peaks.groupBy(K).applyInPandas(thin, peaks.schema)
