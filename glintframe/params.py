"""Tunables of the analysis with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


#: First and last frames, from 1, of the stretches without stimulus in the usual protocol.
QUIET = tuple(zip((1, 4100, 6100), (750, 4200, 6350), strict=True))


@dataclass(frozen=True)
class Params:
    """Fields in order of name; each stage takes the ones that begin with what it is about."""

    bkg_ranges: tuple[tuple[int, int], ...] = QUIET
    com_n_pixels: int = 50
    com_radius: float = 8.5
    dbscan_min_pts: int = 3
    dbscan_eps: float = 1.5
    disk_radius: int = 15
    dog_width: int = 19
    dog_sigma2: float = 3.0
    dog_sigma1: float = 1.0
    filter_window: int = 8
    fps: float = 800.0
    gauss_sigma: float = 1.75
    min_peak_interval: int = 15
    lap_alpha: float = 0.2
    n_ref: int = 600
    ncol: int = 1200
    nrow: int = 312
    patch_size: tuple[int, int] = (27, 27)
    saturation_clip: float = 25000.0
    seg_region_size: int = 10
    seg_gauss: float = 0.1
    seg_threshold: float = 0.90
    sharpen_k: float = 2.25
    std_ranges: tuple[tuple[int, int], ...] = QUIET
    svd_rank: int = 15
    threshold_factor: float = 3.25
    truncate_last: int = 10
    whiten_isolated_only: bool = True
    whiten_ridge: float = 1e-3
    whiten_sigma_floor_pct: float = 5.0
    whiten_traces: bool = False

    def clamped(self, n_frames: int) -> Params:
        """The same with frame ranges cut to the movie's frames; ranges outside it go."""
        from dataclasses import replace

        def cut(ranges: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
            return tuple((max(a, 1), min(b, n_frames)) for a, b in ranges if max(a, 1) <= min(b, n_frames))

        return replace(self, bkg_ranges=cut(self.bkg_ranges), std_ranges=cut(self.std_ranges))
