"""One region's spikes, centres of mass, clusters and footprints, in numpy on its patch of the filtered movie."""

from __future__ import annotations

import numpy as np

from glintframe.kernels import arrays
from glintframe.params import Params


def centre_gain(p: Params) -> float:
    """The centre tap of the difference-of-Gaussians kernel, which scales the trace that noise is measured on."""
    from glintframe.operators.images import dog_kernel

    k = dog_kernel(p.dog_sigma1, p.dog_sigma2, p.dog_width)
    return k[len(k) // 2]


def forward_min_subtract(x: np.ndarray, look: int = 5) -> np.ndarray:
    padded = np.concatenate([x[1:], np.full(look, np.inf)])
    low = np.lib.stride_tricks.sliding_window_view(padded, look)[: len(x)].min(1)
    return np.where(np.isfinite(low), x - low, 0.0)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Left edges of strict local maxima, ends excluded."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    v = x[start]
    top = np.zeros(len(v), bool)
    top[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    return start[top]


def lone_times(times: np.ndarray, tolerance: float) -> np.ndarray:
    """Which times are alone in their group; a group takes all within the tolerance of its first."""
    v = np.sort(np.unique(times))
    keep, i = [], 0
    while i < len(v):
        j = int(np.searchsorted(v, v[i] + tolerance, "right"))
        if j == i + 1:
            keep.append(v[i])
        i = j
    return np.isin(times, keep)


def baseline_frames(p: Params, n: int) -> np.ndarray:
    """0-based frames of all ranges, each range's in turn; frames in two ranges count twice."""
    spans = p.clamped(n).std_ranges or ((1, n),)
    return np.concatenate([np.arange(first, last + 1) for first, last in spans]) - 1


def spikes(patch: np.ndarray, mask: np.ndarray, p: Params) -> np.ndarray:
    """(k, 4) of row, col in the patch, frame and amplitude; the pixel is the frame's brightest, first in column order.

    patch is (frames, rows, cols) with its ends already 0; its mean under the mask, over all pixels, is the trace.
    """
    n = len(patch)
    trace = (patch * mask).mean((1, 2))
    noise = np.std(forward_min_subtract(trace * centre_gain(p))[baseline_frames(p, n)], ddof=1)
    cut = np.where(trace < p.threshold_factor * noise, 0.0, trace)
    out = []
    for t in local_maxima(cut):
        if t <= 2 or t >= n - 4:
            continue
        at = t - 3 + int(np.argmax(cut[t - 3 : t + 3]))
        r, c = arrays.first_column_major(patch[at], patch[at].max())
        out.append((r, c, at, cut[t]))
    return np.array(out, float).reshape(-1, 4)


def centres_of_mass(patch: np.ndarray, times: np.ndarray, origin: tuple[int, int], p: Params) -> np.ndarray:
    """(k, 2) of 1-based row and col: the squared brightness' centre about the brightest of the denoised frames."""
    out = []
    for img in arrays.denoise_stack(patch, times, p.svd_rank):
        out.append(arrays.weighted_centre(img, arrays.grow_brightest(img, p.com_radius, p.com_n_pixels), origin[0] + 1, origin[1] + 1))
    return np.array(out).reshape(-1, 2)


def fallback(patch: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Largest value over time on all rows by all columns of the region."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    out = np.zeros(mask.shape)
    out[np.ix_(rows, cols)] = patch.max(0)[np.ix_(rows, cols)]
    return out


def cluster(patch: np.ndarray, times: np.ndarray, mask: np.ndarray, origin: tuple[int, int], height: int, width: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Mean of the frames within 5 pixels of the brightest under the mask, and that pixel, 1-based."""
    raw = patch[times].mean(0)
    under = raw * mask
    r, c = arrays.first_column_major(under, under.max())
    out = np.zeros_like(raw)
    s = np.s_[max(r - 5, 0) : r + 6, max(c - 5, 0) : c + 6]
    out[s] = raw[s]
    return out, (origin[0] + r + 1, origin[1] + c + 1)


def extract(patch: np.ndarray, mask: np.ndarray, origin: tuple[int, int], centre: tuple[float, float], p: Params, height: int, width: int) -> list[tuple]:
    """Rows (kind, k, r, c, t, v, x, y) of one region:

    "spike" with pixel r, c, frame t and amplitude v; "com" with frame t and 1-based row x, col y; "footprint" with
    number k and weight v of pixel r, c; "centre" with number k and 1-based row x, col y. A region without spikes or
    without a cluster has one footprint, its largest values, about its centroid.
    """
    half = int(p.filter_window / 2 + 0.5)
    patch = patch.copy()
    patch[:half] = 0
    patch[len(patch) - half :] = 0
    r0, c0 = origin
    rows: list[tuple] = []

    def plane(k: int, img: np.ndarray, row: float, col: float) -> None:
        for r, c in zip(*np.nonzero(img), strict=True):
            rows.append(("footprint", k, int(r) + r0, int(c) + c0, None, float(img[r, c]), None, None))
        rows.append(("centre", k, None, None, None, None, float(row), float(col)))

    found = spikes(patch, mask, p)
    if len(found):
        found = found[lone_times(found[:, 2], p.min_peak_interval)]
    for r, c, t, a in found:
        rows.append(("spike", 0, int(r) + r0, int(c) + c0, int(t), float(a), None, None))
    if not len(found):
        plane(0, fallback(patch, mask), *centre)
        return rows
    times = found[:, 2].astype(int)
    com = centres_of_mass(patch, times, origin, p)
    for t, (x, y) in zip(times, com, strict=True):
        rows.append(("com", 0, None, None, int(t), None, float(x), float(y)))
    good = np.isfinite(com).all(1)
    labels = np.full(len(com), -1)
    labels[good] = arrays.dbscan(com[good], p.dbscan_eps, p.dbscan_min_pts)
    if labels.max(initial=-1) < 0:
        plane(0, fallback(patch, mask), *centre)
        return rows
    for k in range(labels.max() + 1):
        img, (x, y) = cluster(patch, times[labels == k], mask, origin, height, width)
        plane(k, img, x, y)
    return rows
