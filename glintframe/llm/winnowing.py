"""Document fingerprints by winnowing.

Every run of K characters has a polynomial hash modulo 2**64, rolled over the text. Of every W consecutive hashes
the smallest is chosen, the rightmost if several are smallest, and kept with its position. Two texts that share a
passage of at least K + W - 1 characters therefore share a chosen hash, at matching places; passages under K
characters are never matched.

One row for each document: hashes and positions (0-based, in characters), in order of position. Texts with fewer
than W runs form one window; texts under K characters, empty and null texts have empty lists; very long texts are
fingerprinted whole. Ties go to the rightmost. Null ids stay, repeated rows give equal rows, other columns are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import named, slices, tidy, utf8

K = 32
W = 64
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1 << 20
_MAX = np.uint64((1 << 64) - 1)


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """sum(codes[i + j] * BASE ** (k - 1 - j)) mod 2**64 for every i, by doubling; places near the end are cut off."""
    power, done, total, size = codes.astype(np.uint64), 1, None, 0
    base = BASE
    while True:
        if k & done:
            if total is None:
                total, size = power, done
            else:  # the part that was built comes after this one
                n = len(codes) - done - size + 1
                total = power[: max(n, 0)] * np.uint64(pow(BASE, size, 1 << 64)) + total[done : done + max(n, 0)]
                size += done
        if done * 2 > k:
            return total if total is not None else power
        n = max(len(power) - done, 0)
        power = power[:n] * np.uint64(base) + power[done : done + n]
        base = base * base % (1 << 64)
        done *= 2


def rightmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every i the place of the rightmost smallest of h[i : i + w]; h is padded by the largest value."""
    n = len(h)
    value, place, size = h, np.arange(n), 1

    def join(v1, p1, v2, p2, shift):
        m = n - shift
        right = v2[shift:] <= v1[:m]
        v, p = v1.copy(), p1.copy()
        v[:m] = np.where(right, v2[shift:], v1[:m])
        p[:m] = np.where(right, p2[shift:], p1[:m])
        return v, p

    while size * 2 <= w and size < n:
        value, place = join(value, place, value, place, size)
        size *= 2
    if 0 < w - size < n:
        value, place = join(value, place, value, place, w - size)
    return place


def _fingerprints(column: pa.Array, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the texts' lists, chosen hashes and positions."""
    data, off = utf8(column)
    n = len(off) - 1
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    start = chars[off]
    size = np.diff(start)
    runs = np.maximum(size - k + 1, 0)
    # Texts lie apart by w places, so that no window reaches into the next text.
    shifted = start[:-1] + np.arange(n) * w
    spread = np.zeros(len(codes) + n * w, np.uint32)
    spread[np.arange(len(codes)) + np.repeat(np.arange(n) * w, size)] = codes
    h = rolling_hashes(spread, k)
    valid = np.zeros(len(h) + 1, np.int32)
    np.add.at(valid, shifted[runs > 0], 1)
    np.add.at(valid, (shifted + runs)[runs > 0], -1)
    inside = np.cumsum(valid[:-1]) > 0
    h = np.where(inside, np.minimum(h, _MAX - np.uint64(1)), _MAX)
    place = rightmost_minima(h, w)
    starts = np.maximum(runs - w + 1, (runs > 0).astype(np.int64))
    windows = np.zeros(len(h) + 1, np.int32)
    np.add.at(windows, shifted[starts > 0], 1)
    np.add.at(windows, (shifted + starts)[starts > 0], -1)
    at = place[np.cumsum(windows[:-1]) > 0]
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    text = np.searchsorted(shifted, at, "right") - 1
    lists = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
    return lists, h[at].view(np.int64), (at - shifted[text]).astype(np.int32)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """(doc_id, hashes array<bigint>, positions array<int>) for every row; no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "_text", SLICE_BYTES):
                lists, hashes, places = _fingerprints(b.column(1), k, w)
                o = pa.array(lists, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(o, pa.array(hashes)), pa.ListArray.from_arrays(o, pa.array(places))],
                    ["doc_id", "hashes", "positions"],
                )

    source = docs.select(named(doc_id).alias("doc_id"), named(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(work), f"doc_id {kind}, hashes array<bigint>, positions array<int>")


def _doubling() -> str:
    steps, size = [], 1
    while size < K:
        steps.append(
            f"h{size * 2} AS (SELECT doc_id, pos, (h * {pow(BASE, size, 1 << 64)}::UHUGEINT + lead(h, {size}) OVER (PARTITION BY doc_id ORDER BY pos)) % 18446744073709551616::UHUGEINT AS h FROM h{size})"
        )
        size *= 2
    return ",\n".join(steps)


SQL = f"""
WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS pos FROM documents WHERE length(text) >= {K}),
h1 AS (SELECT doc_id, pos, unicode(ch)::UHUGEINT AS h FROM chars),
{_doubling()},
runs AS (SELECT doc_id, pos, h * 4294967296::UHUGEINT + (4294967295 - pos)::UHUGEINT AS packed, count(*) OVER (PARTITION BY doc_id) AS n FROM h{K} WHERE h IS NOT NULL),
chosen AS (SELECT doc_id, pos, n, min(packed) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS packed FROM runs),
kept AS (SELECT DISTINCT doc_id, packed FROM chosen WHERE pos <= greatest(n - {W}, 0)),
parts AS (SELECT doc_id, (4294967295 - (packed % 4294967296::UHUGEINT)::BIGINT)::INTEGER AS pos, (packed // 4294967296::UHUGEINT)::HUGEINT AS h FROM kept),
lists AS (SELECT doc_id, list((CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT ORDER BY pos) AS hashes, list(pos ORDER BY pos) AS positions FROM parts GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.hashes, []::BIGINT[]) AS hashes, coalesce(l.positions, []::INTEGER[]) AS positions FROM documents d LEFT JOIN lists l USING (doc_id)
"""
