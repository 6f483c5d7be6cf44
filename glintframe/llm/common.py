"""Helpers shared by the operators: shared tables, measured broadcasts, bitmaps and UTF-8 buffers of Arrow columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.sources.shared import checkpointed

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


#: Write to the shared folder and read again: cuts lineage, survives executors and runs the plan once.
staged = checkpointed


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of the largest filter that ``sieved`` broadcasts: 128 MB.
MOST_BITS = 1 << 30


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: the texts' own, 8 for each other value and 16 for each row. df should be a written table."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(named(name)), F.lit(0)).cast("long") + 8
        if kind.startswith("array"):
            return F.greatest(F.size(named(name)), F.lit(0)).cast("long") * 8 + 16
        return F.lit(8).cast("long")

    row = F.lit(16).cast("long")
    for name, kind in df.dtypes:
        row = row + width(name, kind)
    return df.agg(F.sum(row)).first()[0] or 0


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured bytes are within the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def sieved(df: DataFrame, keys: DataFrame, on: list[str], most_bits: int = MOST_BITS, passing: bool = True) -> DataFrame:
    """The rows of df whose values of the columns may be among the keys' (a written table), or else all the others.

    A bitmap of one hash of the keys, 16 bits for each up to most_bits together, is broadcast, so that df isn't
    shuffled at any number of keys. Rows that are among the keys always pass.
    """
    n = keys.count()
    bits = min(most_bits, 1 << max(15, (16 * n).bit_length()))
    slot, cell, bitmap = fresh(df, "_slot", "_cell", "_bitmap")
    place = F.xxhash64(*[named(c) for c in on]).bitwiseAND(F.lit(bits - 1))
    low = F.lit((1 << 15) - 1)
    marks = keys.select(F.shiftright(place, 15).cast("int").alias(cell), place.bitwiseAND(low).alias("at"))
    marks = marks.groupBy(cell).agg(F.bitmap_construct_agg("at").alias(bitmap))
    at = F.col(slot).bitwiseAND(low)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn(slot, place).join(F.broadcast(marks), F.shiftright(F.col(slot), 15).cast("int") == F.col(cell), "inner" if passing else "left")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.where(hit if passing else ~F.coalesce(hit, F.lit(False))).select(*[named(c) for c in df.columns])


def tidy(f: Callable) -> Callable:
    """Give freed memory back to the system when a task's generator ends: workers stay for later stages."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return run


def named(name: str) -> Column:
    """A column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that don't clash with any of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about most_bytes together; a longer text stands alone."""
    at = batch.schema.get_field_index(column)
    _, off = utf8(batch.column(at))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most_bytes, "right")) - 1)
        end = min(end, n)
        yield batch.slice(start, end - start)
        start = end


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 20)
        inverse = pow(_GOLDEN, -1, 1 << 64)
        for name, base in (("p", _GOLDEN), ("i", inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes other than blank, tab, newline, form feed and return, never across texts.

    Returns for each word a 64-bit hash of its bytes, its first byte, the byte after it and its text's index.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, e
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = off[(off > 0) & (off < n)]
    first[bounds] = solid[bounds]
    last = np.zeros(n, bool)
    last[:-1] = solid[:-1] & (~solid[1:] | first[1:])
    last[-1] = solid[-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(off, s, "right") - 1


def char_index(data: np.ndarray) -> np.ndarray:
    """For every byte position, and the end, how many characters begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
