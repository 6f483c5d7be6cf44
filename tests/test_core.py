"""Operators against DuckDB, plain numpy restatements of their rules, and synthetic truth."""

import collections
import math

import duckdb
import numpy as np
import pytest

from glintframe.kernels import arrays, regions, registration as reg, signal
from glintframe.operators import blocks, extraction, images, movie as mv, registration as rg, relational as rel, snr, traces as tr
from glintframe.params import Params
from glintframe.plans import catalog, pipelines
from glintframe.sources import raw_movie, sidecar

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf, con, name):
    cur = con.execute(catalog.oracle_sql()[name])
    names = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    want = collections.Counter(repr(norm([r[i] for i in at])) for r in cur.fetchall())
    df = catalog.queries()[name](spark, sf)
    assert sorted(df.columns) == names
    assert collections.Counter(repr(norm(list(r))) for r in df.select(names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert len(catalog.queries()[name](spark, sf).collect()) > 0


def image(spark, a):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(a)], "r int, c int, v double")


def array(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = r[v]
    return out


# waveforms


def test_moving_median_and_arrays(spark):
    x = np.random.default_rng(0).normal(size=(3, 30))
    df = spark.createDataFrame([(k, t, float(v)) for (k, t), v in np.ndenumerate(x)], "key int, t long, v double")
    for w in (1, 5, 8):
        got = np.zeros_like(x)
        for r in tr.moving_median(df, w).collect():
            got[r["key"], r["t"]] = r["med"]
        want = [[np.median(row[max(i - w // 2, 0) : i + w - w // 2]) for i in range(30)] for row in x]
        assert np.allclose(got, want) and np.allclose(arrays.moving_median(x, w), want)


def test_plateau_rules(spark):
    x = [0, 2, 2, 1, 1, 3, 3, 3]  # the last rise never falls: no peak
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "key int, t long, v double")
    assert [r["t"] for r in tr.find_peaks(df).collect()] == [1] == regions.local_maxima(np.array(x, float)).tolist()
    assert [r["t"] for r in tr.find_peaks(df, left_edge=False).collect()] == [1]


def test_lone_times(spark):
    t = [0, 10, 20, 40, 40, 70]
    df = spark.createDataFrame([(0, v, 1.0) for v in t], "key int, t long, v double")
    kept = sorted(r["t"] for r in tr.dedup_close(df, 15).collect())
    assert kept == [20, 40, 40, 70] == np.array(t)[regions.lone_times(np.array(t), 15)].tolist()


def test_thinned_peaks():
    x = np.array([0, 5, 0, 6, 0, 0, 4, 0, 9, 0, 0.0])
    at, h = signal.find_peaks(x, 4.5, 3)
    assert at.tolist() == [3, 8] and h.tolist() == [6, 9]


# signal kernels


def test_butterworth_response():
    b, a = signal.butter_highpass(4, 20, 800)
    h = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f / 800)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f / 800)))
    assert h(20) == pytest.approx(2**-0.5) and h(0.01) < 1e-9 and h(399.9) == pytest.approx(1)
    for f in (5, 50, 200):  # the analogue prototype at the warped frequency
        w = math.tan(math.pi * 20 / 800) / math.tan(math.pi * f / 800)
        assert h(f) == pytest.approx(1 / math.sqrt(1 + w**8))


def test_zero_phase_keeps_place_and_removes_drift():
    t = np.arange(2000) / 800
    spike = np.exp(-((np.arange(2000) - 1000) ** 2) / 8)
    y = signal.highpass(5 + 3 * t + spike, 20, 800)
    assert np.argmax(y) == 1000 and abs(y[100:600]).max() < 0.02
    tone = np.sin(2 * np.pi * 60 * t)
    assert abs(signal.notch_chain(tone, [60, 1000], 800, 30)[500:1500]).max() < 0.05
    with pytest.raises(ValueError, match="samples"):
        signal.highpass(np.zeros(15), 20, 800)


def test_welch_and_coherence():
    rng = np.random.default_rng(1)
    x = rng.normal(size=40_000)
    f, p = signal.welch(x, 800, 256)
    assert p.mean() * 400 == pytest.approx(1, rel=0.05) and f[-1] == 400
    y = x + rng.normal(size=40_000)
    assert signal.coherence(x, y, 800, 256)[1].mean() == pytest.approx(0.5, abs=0.05)
    assert signal.coherence(x, x, 800, 256)[1].min() == pytest.approx(1)


def test_metrics_of_planted_spikes(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(0, 1, 4000)
    at = np.arange(100, 3900, 200)
    y[at] += 30
    r = snr.cell_metrics(spark.createDataFrame([(0, y.tolist()), (1, [0.0] * 4000)], "cell_id int, y array<double>"), 800).orderBy("cell_id").collect()
    assert r[0]["n_spikes"] == len(at) and 20 < r[0]["snr_median"] < 35 and r[0]["noise_sigma"] == pytest.approx(1, rel=0.1)
    assert (r[1]["n_spikes"], r[1]["snr_median"], r[1]["spectral_hf_snr"]) == (0, None, None)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((4, 4), (3, 6), (6, 3), (1, 1)):
        c = rng.integers(0, 9, (n, m)).astype(float)
        i, j = arrays.assign(c)
        best = min(sum(c[a, p[a]] for a in range(n)) for p in permutations(range(m), n)) if n <= m else min(sum(c[p[a], a] for a in range(m)) for p in permutations(range(n), m))
        assert len(i) == min(n, m) and c[i, j].sum() == best and len(set(j.tolist())) == len(j)


def test_assignment_of_points_needs_no_matrix():
    """Least total distance against the solver on the matrix, on odd points too; and memory far below a matrix."""
    import tracemalloc

    from glintframe.kernels import matching

    rng = np.random.default_rng(3)
    makers = [lambda k: rng.normal(size=(k, 2)), lambda k: rng.integers(0, 6, (k, 2)).astype(float), lambda k: np.stack([np.zeros(k), rng.normal(size=k)], 1), lambda k: rng.normal(size=(k, 2)) + 100 * (rng.random((k, 1)) < 0.5)]
    for n, m in ((0, 3), (1, 1), (1, 5), (5, 1), (30, 30), (120, 121), (121, 120), (40, 200), (300, 300)):
        for make in makers:
            x, y = make(n), make(m)
            i, j = matching.assign_points(x, y)
            d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
            a, b = arrays.assign(d) if n else ([], [])
            assert len(i) == len(set(i.tolist())) == len(set(j.tolist())) == min(n, m)
            assert d[i, j].sum() == pytest.approx(d[a, b].sum(), rel=1e-9, abs=1e-9)
    tracemalloc.start()
    matching.assign_points(rng.normal(size=(2000, 2)), rng.normal(size=(2000, 2)))
    assert tracemalloc.get_traced_memory()[1] < 16e6 < 2000 * 2000 * 8
    tracemalloc.stop()


def test_runs_hold_every_cell(spark, sf):
    e = sorted((r["vec_id"], *(100 * float(v) for v in r["embedding"][:2])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x, y = (np.array([r for r in e if r[0] % 2 == k]) for k in (0, 1))
    assert len(x) + len(y) == len(e) > 400
    d = np.hypot(x[:, None, 1] - y[None, :, 1], x[:, None, 2] - y[None, :, 2])
    i, j = arrays.assign(d)
    want = {(int(x[a, 0]), int(y[b, 0])) for a, b in zip(i, j, strict=True) if d[a, b] <= 6}
    assert {(r["i_a"], r["j_b"]) for r in catalog.queries()["cell_match"](spark, sf).collect()} == want
    assert {(r["i_a"], r["j_b"]) for r in catalog.queries()["run_comparison"](spark, sf).collect()} == want


def test_signed_rank():
    from itertools import product

    d = np.array([1.1, -0.4, 2.5, 3.1, -0.2, 0.9, 1.7, 2.2, 0.6])
    rank = np.argsort(np.argsort(abs(d))) + 1
    sums = np.array([sum(r for r, s in zip(rank, sg, strict=True) if s) for sg in product((0, 1), repeat=9)])
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    assert arrays.wilcoxon(d, np.zeros(9)) == pytest.approx(2 * (sums <= w).mean())
    assert arrays.wilcoxon(np.ones(9), np.ones(9)) is None
    big = np.random.default_rng(4).normal(0.1, 1, 300)
    assert 0 < arrays.wilcoxon(big, np.zeros(300)) < 0.3


# movies and images


def movie(spark, a):
    return spark.createDataFrame([(t, r, c, float(v)) for (t, r, c), v in np.ndenumerate(a)], "t int, r int, c int, v double")


def test_correlation_image_literal(spark):
    a = np.random.default_rng(5).normal(size=(20, 5, 6)).cumsum(0)
    a[:, 2, 3] = 7  # constant
    want = np.zeros((5, 6))
    for r in range(1, 4):
        for c in range(1, 5):
            if a[:, r, c].std() == 0:
                continue
            for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                x, y = a[:, r, c] - a[:, r, c].mean(), a[:, r + dr, c + dc] - a[:, r + dr, c + dc].mean()
                want[r, c] += (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum()) + mv.EPS) / 4
    assert np.allclose(array(mv.correlation_image(movie(spark, a), 6), (5, 6)), want)


def test_motion_residual_is_orthogonal(spark):
    a = np.random.default_rng(6).normal(size=(12, 6, 7)) + 50
    out = mv.motion_correct(movie(spark, a), 3)
    m = np.zeros_like(a)
    for r in out.collect():
        m[r["t"], r["r"], r["c"]] = r["v"]
    g = mv.gradients(mv.mean_image(mv.truncate_last(movie(spark, a), 3)))
    gx, gy = array(g, (6, 7), "gx"), array(g, (6, 7), "gy")
    assert np.abs((m * gx).sum((1, 2))).max() < 1e-9 and np.abs((m * gy).sum((1, 2))).max() < 1e-9
    flat = mv.motion_shifts(movie(spark, np.ones((4, 3, 3))), 1)[0].collect()
    assert all((r["dx"], r["dy"]) == (0, 0) for r in flat)


def test_background_is_removed(spark):
    base = np.random.default_rng(7).uniform(5, 9, (4, 5))
    ranges = ((1, 3), (9, 11), (18, 20))
    at = np.array(mv.anchors(ranges))
    level = np.interp(np.arange(1, 21), at, [1.0, 4.0, 2.0])
    a = base[None] * level[:, None, None]
    samples = spark.createDataFrame([(k, r, c, float(base[r, c] * s)) for k, s in enumerate((1.0, 4.0, 2.0)) for r in range(4) for c in range(5)], "range_id int, r int, c int, v double")
    out = mv.subtract_background(movie(spark, a), samples, ranges)
    assert max(abs(r["v"]) for r in out.collect()) < 1e-12


def test_opening_in_strips_equals_whole(spark):
    img = np.random.default_rng(8).uniform(size=(150, 9))
    got = array(blocks.opening_kernel(image(spark, img), 3, 150, 9), (150, 9))
    assert np.allclose(got, arrays.grey_opening(img, arrays.octagon(3)))
    small = img[:12]
    assert np.allclose(array(images.grey_opening(image(spark, small), 3, 12, 9), (12, 9)), arrays.grey_opening(small, arrays.octagon(3)))
    assert (arrays.grey_opening(img, arrays.octagon(3)) <= img).all()


def test_kernels_of_images():
    assert sum(w for *_, w in images.gaussian_stencil(1.75)) == pytest.approx(1) and len(images.gaussian_stencil(1.75)) == 81
    assert sum(w for *_, w in images.laplacian_stencil()) == pytest.approx(0)
    assert len(images.octagon(15)) == 697 == arrays.octagon(15).sum()
    d = images.dog_kernel()
    assert max(d) == 1 and d[9] == 1 and abs(sum(d) - (d[0] + d[-1]) / 2) < 1e-9


def test_components_of_a_spiral(spark):
    a = np.zeros((15, 15), int)
    for k in range(0, 15, 4):
        a[k, :] = 1
    a[:, 0] = 1
    a[2, 3:9] = 1
    df = spark.createDataFrame([(int(r), int(c)) for r, c in np.argwhere(a)], "r int, c int")
    lab = {(r["r"], r["c"]): r["label"] for r in images.components(df, 15).collect()}
    assert len(lab) == a.sum() and {lab[2, c] for c in range(3, 9)} == {2 * 15 + 3} and set(lab.values()) == {0, 33}
    assert images.components(df.limit(0), 15).count() == 0


def test_dbscan_rules():
    p = np.array([[0, 0], [0, 1], [1, 0], [2.5, 0], [10, 10], [10, 11], [11, 10], [30, 30]])
    assert arrays.dbscan(p, 1.5, 3).tolist() == [0, 0, 0, 0, 1, 1, 1, -1]


def test_dbscan_lists_no_pairs():
    """Against the rule written out with all pairs, on odd points too; and 100,000 points that are nearly all near."""
    import tracemalloc

    def all_pairs(p, eps, least):
        near = ((p[:, None] - p[None]) ** 2).sum(-1) <= eps * eps
        core, labels, k = near.sum(1) >= least, np.full(len(p), -1), 0
        for i in range(len(p)):
            if core[i] and labels[i] < 0:
                labels[i], stack = k, [i]
                while stack:
                    for j in np.flatnonzero(near[stack.pop()] & (labels < 0)):
                        labels[j] = k
                        stack += [j] if core[j] else []
                k += 1
        return labels

    rng = np.random.default_rng(7)
    gap = np.array([[0.0, 0.0], [0.01, 0.01], [1.04, 1.04], [1.05, 1.05]])
    for p in (rng.normal(size=(150, 2)) * 3, rng.integers(0, 8, (150, 2)).astype(float), rng.integers(0, 30, (150, 2)) / 2, gap, np.where(rng.random((40, 2)) < 0.1, np.nan, 1.0), np.zeros((0, 2))):
        for eps, least in ((1.5, 3), (1.0, 4), (0.5, 2), (0.0, 2), (2.0, 12), (1.5, 2)):
            assert arrays.dbscan(p, eps, least).tolist() == all_pairs(p, eps, least).tolist()
    tracemalloc.start()
    assert (arrays.dbscan(rng.uniform(size=(100_000, 2)), 1.5, 3) == 0).all()
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_traces_of_planted_cells(spark):
    rng = np.random.default_rng(9)
    f = np.zeros((8, 9, 3))
    f[1:4, 1:4, 0], f[3:6, 3:6, 1], f[6:8, 7:9, 2] = rng.uniform(1, 2, (3, 3)), rng.uniform(1, 2, (3, 3)), rng.uniform(1, 2, (2, 2))
    y = rng.normal(size=(3, 20))
    m = movie(spark, -np.einsum("rck,kt->trc", f, y))
    foot = spark.createDataFrame([(int(k), int(r), int(c), float(f[r, c, k])) for r, c, k in np.argwhere(f)], "cell_id int, r int, c int, w double")
    noise = image(spark, rng.uniform(0.5, 2, (8, 9)))
    plain, mixed = extraction.pinv_traces(m, foot), extraction.cell_traces(m, foot, Params(whiten_traces=True), noise)
    for df, tol in ((plain, 1e-9), (mixed, 5e-3)):
        got = np.zeros_like(y)
        for r in df.collect():
            got[r["cell_id"], r["t"]] = r["v"]
        assert np.allclose(got, y, atol=tol * 3)
    assert np.allclose(arrays.pinv_traces(f.reshape(-1, 3), -np.einsum("rck,kt->trc", f, y).reshape(20, -1).T), y)
    boxes = foot.groupBy("cell_id").agg({"r": "min"})
    assert boxes.count() == 3


def test_whole_movie_finds_planted_cells(spark):
    rng = np.random.default_rng(10)
    T, H, W = 220, 64, 80
    y, x = np.mgrid[0:H, 0:W]
    centres = [(18, 20), (44, 55)]
    a = rng.normal(0, 0.3, (T, H, W)) + 100
    times = {0: [30, 70, 110, 150], 1: [50, 90, 130, 170]}
    for k, (r, c) in enumerate(centres):
        blob = np.exp(-((y - r) ** 2 + (x - c) ** 2) / 6)
        wave = rng.normal(0, 0.5, T).cumsum() * 0.2 + 6
        wave[times[k]] -= 25  # spikes are dips
        a += wave[:, None, None] * blob
    p = Params(truncate_last=4, n_ref=60, bkg_ranges=((1, 60), (150, 216)), std_ranges=((8, 25), (180, 210)), disk_radius=5, seg_region_size=4)
    res = pipelines.process_movie(movie(spark, a), H, W, p)
    cells = [(r["row"], r["col"]) for r in res["cells"].collect()]
    for r, c in centres:
        assert min(math.hypot(r + 1 - i, c + 1 - j) for i, j in cells) < 2.5
    found = {r["t"] for r in res["spikes"].collect()}
    assert len(found & {t for v in times.values() for t in v}) >= 6
    n = res["traces"].groupBy("cell_id").count().collect()
    assert len(n) == len(cells) and all(r["count"] == T - 4 for r in n)


# registration


def test_dihedral_points_follow_images():
    img = np.arange(12).reshape(3, 4)
    for op in reg.DIHEDRAL:
        m = reg.dihedral_matrix(op, img.shape)
        out = reg.DIHEDRAL[op](img)
        for (r, c), v in np.ndenumerate(img):
            x, y = np.rint(reg.apply(m, [[c, r]])[0]).astype(int)
            assert out[y, x] == v
        assert rel.DIHEDRAL[op](1, 2, 3, 4) == tuple(np.argwhere(out == img[1, 2])[0])


def test_fits():
    rng = np.random.default_rng(11)
    src = rng.uniform(0, 100, (12, 2))
    m = reg.similarity(0.4, math.radians(15), 200, -100)
    dst = reg.apply(m, src)
    assert np.abs(reg.apply(reg.fit_similarity(src, dst), src) - dst).max() < 1e-6
    assert np.allclose(reg.fit_affine(src, dst), m)
    dst[3] += 500
    assert np.allclose(reg.fit_similarity(src, dst, robust=True), m)
    assert reg.scale_of(m) == pytest.approx(0.4) and reg.rotation_of(m) == pytest.approx(15)


def texture(shape, seed, n):
    rng = np.random.default_rng(seed)
    a = np.zeros(shape)
    a[rng.integers(0, shape[0], n), rng.integers(0, shape[1], n)] = rng.uniform(0.4, 1, n)
    return reg.gaussian(a, 1.5) * 4000


def test_translation_and_windows():
    img = texture((256, 256), 12, 900)
    m, v = reg.register_translation(img[60:180, 90:240], img)
    assert np.abs(m[:2, 2] - [90, 60]).max() < 0.2 and v > 0.4  # the padding counts in v
    m, v = reg.register_similarity(reg.warp(img, reg.compose(reg.translation(128, 128), reg.similarity(1.1, 0.12, 0, 0), reg.translation(-128, -128)), img.shape)[40:216, 40:216], img[40:216, 40:216])
    assert v > 0.5 and reg.scale_of(m) == pytest.approx(1 / 1.1, abs=0.04)
    crop, corner = reg.crop_around(img, -500, 900, (10, 10))
    assert crop.size and corner[0] == 0
    with pytest.raises(ValueError, match="mode"):
        reg.register(img, img, "other")


def test_fields_are_placed(spark):
    mosaic = texture((400, 500), 13, 3000)
    s = reg.similarity(0.4, 0.0, 200, 120)
    fovs, scale = [], 3.0
    for k, (cx, cy) in enumerate(((150, 130), (300, 140), (260, 280))):
        m = reg.compose(reg.translation(cx, cy), reg.similarity(scale, 0, 0, 0), reg.translation(-24.5, -17.5))
        fov = reg.DIHEDRAL["fliplr"](reg.warp(mosaic, np.linalg.inv(m), (36, 50)))
        x, y = reg.apply(np.linalg.inv(s), [[cx, cy]])[0]
        fovs.append((k, float(x), float(y), 36, 50, np.nan_to_num(fov).ravel().tolist()))
    f = spark.createDataFrame(fovs, rg.FOV)
    big = image(spark, mosaic)
    small = rg.small_mosaic(big, 4)
    best = rg.recover_dihedral(f.where("fov = 0"), small, 4, (2.75, 3.0, 3.25)).first()
    assert best["op"] == "fliplr"
    got, expected, report = rg.global_register(f, small, "fliplr", 4, scales=(2.75, 3.0, 3.25))
    assert expected == 3.0 and report.where("passed").count() == 3
    assert np.abs(reg.apply(got, [[0, 0], [100, 50]]) - reg.apply(s, [[0, 0], [100, 50]])).max() < 8
    assert abs(reg.scale_of(got) - 0.4) < 0.02
    fine = rg.fine_register(f, big, got, "fliplr", 3.0, (56, 77)).collect()
    for r in fine:
        cx, cy = ((150, 130), (300, 140), (260, 280))[r["fov"]]
        at = reg.apply(np.array(r["matrix"]).reshape(3, 3), [[24.5, 17.5]])[0]
        assert math.hypot(at[0] - cx, at[1] - cy) < 5 and r["score"] > 0.5
    none, _, rep = rg.global_register(f.limit(1), small, "fliplr", 4, scales=(3.0,))
    assert none is None and rep.count() == 1


def test_gate_does_not_depend_on_order(spark):
    rows = [(k, 0.95, 3.0) for k in range(4)] + [(9, 0.35, 4.75), (10, 0.1, 3.0)]
    for order in (rows, rows[::-1]):
        out = {r["fov"]: (r["passed"], r["reason"]) for r in rel.gate(spark.createDataFrame(order, "fov int, ncc double, scale double")).collect()}
        assert [k for k, (ok, _) in out.items() if ok] and sorted(k for k, (ok, _) in out.items() if ok) == [0, 1, 2, 3]
        assert out[9][1].startswith("scale 4.750 outside") and out[10][1] == "ncc 0.100 < min_ncc 0.30"


def test_nuclei_are_weighted_down(spark):
    tiles = spark.createDataFrame([(1, r, c, 10.0) for r in range(30) for c in range(30)], "tile int, r int, c int, v double")
    nuclei = spark.createDataFrame([(1, 15.0, 15.0, 80.0), (2, 1.0, 1.0, 9.0)], "tile int, i double, j double, area double")
    out = array(rg.down_weight_nuclei(tiles, nuclei, 30), (30, 30))
    assert out[15, 15] < 1 and out[0, 0] > 9.9


def test_nearest_far_points(spark):
    rng = np.random.default_rng(14)
    p = np.concatenate([rng.uniform(0, 1, (40, 2)), [[100, 100], [-300, 5]]])
    got = {r["id"]: r["other"] for r in rel.nearest(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double"), 0.05).collect()}
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert got == dict(enumerate(d.argmin(1).tolist()))


def test_nearest_of_crowded_and_equal_points(spark):
    """Small parts, equal places, ties, points without a place; and 50,000 points within one cell of the first grid, whose
    pairs are too many to be met."""
    import time

    rng = np.random.default_rng(5)
    for p in (rng.normal(size=(300, 2)), rng.integers(0, 9, (200, 2)).astype(float), np.stack([np.zeros(90), rng.normal(size=90)], 1), np.zeros((5, 2))):
        rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(p)]
        got = rel.nearest(spark.createDataFrame([*rows, (9999, None, 0.0), (9998, math.nan, 0.0)], "id int, x double, y double"), 0.05, part=20).collect()
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
        np.fill_diagonal(d, np.inf)
        assert len(got) == len(p) and {r["id"]: r["other"] for r in got} == dict(enumerate(d.argmin(1).tolist()))
    many = spark.range(50_000).selectExpr("id", "rand(1) x", "rand(2) y")
    began = time.time()
    assert rel.nearest(many, 2.0).count() == 50_000
    assert time.time() - began < 60


def test_neighbour_pairs_of_crowded_points(spark):
    import time

    p = np.random.default_rng(6).uniform(size=(50_000, 2)).round(6)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double")
    began = time.time()
    got = rel.neighbour_pairs(df, 20, 2.0).collect()
    assert time.time() - began < 60 and len(got) == 20
    for r in got:
        d = np.hypot(*(p - p[r["id"]]).T)
        d[r["id"]] = np.inf
        assert r["d"] == pytest.approx(d.min()) and d[r["other"]] == d.min()


# sources and sinks


def test_raw_movie(spark, tmp_path):
    a = np.random.default_rng(15).integers(0, 60000, (13, 4, 5)).astype("<u2")
    (tmp_path / "frames1.bin").write_bytes(a.tobytes() + b"\x01\x02\x03")  # a partial frame at the end
    f = raw_movie.read_frames(spark, str(tmp_path / "frames1.bin"), 4, 5, frames_per_partition=4)
    assert f.rdd.getNumPartitions() == 4
    rows = f.orderBy("t").collect()
    assert np.array_equal(np.array([r["px"] for r in rows]).reshape(13, 4, 5), a)
    assert f.where("t >= 4 and t < 8").rdd.getNumPartitions() == 1 and f.where("t >= 4 and t < 8").count() == 4
    long = raw_movie.to_long(f, 5)
    assert long.where("t = 7 and r = 2 and c = 3").first()["v"] == a[7, 2, 3]
    m = {r["i"]: r["v"] for r in raw_movie.mean_frame(f, 6).collect()}
    assert m[7] == pytest.approx(a[:6].reshape(6, -1)[:, 7].mean())


def test_dims(spark, tmp_path):
    y, x = np.mgrid[0:12, 0:20]
    frames = np.stack([(1000 + 50 * y + 3 * x * x + t).astype("<u2") for t in range(3)])
    (tmp_path / "frames1.bin").write_bytes(frames.tobytes())
    best = raw_movie.recover_dims(spark, str(tmp_path / "frames1.bin"), 240, 5, 60).first()
    assert (best["nrow"], best["ncol"]) == (12, 20)
    (tmp_path / "a.txt").write_text("pixels_per_frame: 99")
    (tmp_path / "frames1_dropped.txt").write_text("x=1\nExposure_Bytes_per_frame = 480\n")
    got = sidecar.frame_pixels(spark, str(tmp_path), "frames1").collect()
    assert [(r["pixels"], r["how"]) for r in got] == [(240, "frames1_dropped.txt: exposure_bytes_per_frame=480")]


def test_report_files(spark, tmp_path):
    t = spark.createDataFrame([(1, 2, 0.123456789, None), (3, 4, 1234567.0, 2.0)], "i_a int, j_b int, dist double, corr_raw double")
    s = spark.createDataFrame([("noise_sigma", 3, 0.5)], "metric string, n int, a_median double")
    snr.write_report(t, s, str(tmp_path / "r"))
    back = {r["i_a"]: r for r in spark.read.csv(str(tmp_path / "r/per_cell_metrics"), header=True).collect()}
    assert float(back["1"]["dist"]) == pytest.approx(0.123457) and float(back["3"]["dist"]) == 1234570.0
    assert spark.read.json(str(tmp_path / "r/summary")).first()["n"] == 3


def test_stream(spark, sf, tmp_path):
    from glintframe.streaming import causal

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.parquet").symlink_to(f"{sf}/events.parquet")
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df in (("counts", causal.windowed_counts(src)), ("detrended", causal.running_detrend(src, 60))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    e = tr.from_events(spark.read.parquet(f"{sf}/events.parquet"), "user_id", ["ts", "event_id"], "value")
    want = sorted(r["detrended"] for r in tr.running_mean_detrend(e).collect())
    assert np.allclose(sorted(r["detrended"] for r in spark.table("detrended").collect()), want)
    assert 0 < spark.table("counts").count()


def test_params():
    p = Params(bkg_ranges=((1, 750), (4100, 4200)), std_ranges=((10, 20),))
    assert p.clamped(100).bkg_ranges == ((1, 100),) and p.clamped(100).std_ranges == ((10, 20),)


def test_hdf5_round_trip(spark, tmp_path):
    import struct
    import zlib

    from glintframe.kernels import hdf5
    from glintframe.sources import containers

    rng = np.random.default_rng(16)
    tree = {
        "cell_traces": rng.normal(size=(3, 7)), "u": np.arange(6, dtype=np.uint16).reshape(2, 3), "f": np.float32([[1.5, 2]]), "i": np.int32([[-4]]),
        "#refs#": {"a": {"deviceType": np.array([[ord(c)] for c in "Camera"], np.uint16)}, "b": {"deviceType": np.array([[ord(c) for c in "MAC5000_Stage_Controller"]], np.uint16), "pos": {"x": np.array([[-77642.4]]), "y": np.array([[27365.8]])}}},
    }
    data = hdf5.write(tree)
    for shift in (b"", b"\0" * 512):
        back = hdf5.read(shift + data)
        for n in ("cell_traces", "u", "f", "i"):
            assert back[n].dtype == tree[n].dtype and np.array_equal(back[n], tree[n])
        assert hdf5.stage_position(back) == (-77642.4, 27365.8)
    with pytest.raises(ValueError, match="signature"):
        hdf5.read(b"nothing")
    with pytest.raises(KeyError):
        hdf5.stage_position({"u": tree["u"]})
    # a chunked, deflated dataset in place of the contiguous one
    a = rng.normal(size=(5, 4))
    raw = bytearray(hdf5.write({"a": np.zeros((4, 5))}))
    f = hdf5.File(bytes(raw))
    at = next(p for k, p, _ in f.messages(next(f._symbols(f._ref(next(p for k, p, _ in f.messages(f.root) if k == 17)), f._ref(f._ref(next(p for k, p, _ in f.messages(f.root) if k == 17) + 8) + 24)))[1]) if k == 8)
    keys = b""
    for r0 in (0, 3):
        for c0 in (0, 3):
            block = np.zeros((3, 3))
            part = a[r0 : r0 + 3, c0 : c0 + 3]
            block[: part.shape[0], : part.shape[1]] = part
            z = zlib.compress(block.tobytes()) if c0 else block.tobytes()
            keys += struct.pack("<IIQQQ", len(z), 0 if c0 else 1, r0, c0, 0) + struct.pack("<Q", len(raw))
            raw += z
    node = len(raw)
    raw += b"TREE" + struct.pack("<BBHQQ", 1, 0, 4, hdf5.NONE, hdf5.NONE) + keys
    raw[at : at + 24] = struct.pack("<BBBQIII", 3, 2, 3, node, 3, 3, 8)[:23] + b"\0"
    assert np.array_equal(hdf5.read(bytes(raw))["a"], a.T)
    (tmp_path / "m.mat").write_bytes(data)
    rows = {r["name"]: r for r in containers.read_arrays(spark, str(tmp_path / "m.mat")).collect()}
    assert rows["u"]["shape"] == [2, 3] and rows["u"]["values"] == [0, 1, 2, 3, 4, 5] and "#refs#/b/pos/x" in rows
    assert containers.read_stage_positions(spark, str(tmp_path / "m.mat")).first()["x"] == -77642.4


def test_tiff(spark, tmp_path):
    import struct

    from glintframe.sources import containers

    a = np.random.default_rng(17).integers(0, 60000, (2, 3, 4)).astype("<u2")
    out, data = bytearray(b"II*\0\0\0\0\0"), []
    for page in a:
        data.append(len(out))
        out += page.tobytes()
    link = 4
    for k in range(2):
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 1, data[k]), (279, 4, 1, 24)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    (tmp_path / "A-12.tif").write_bytes(out)
    assert np.array_equal(containers.decode_tiff(bytes(out)), a)
    rows = containers.read_tiles(spark, str(tmp_path)).collect()
    assert {r["tile"] for r in rows} == {12} and next(r["px"] for r in rows if (r["ch"], r["r"]) == (1, 2)) == a[1, 2].tolist()


def test_views(spark):
    import json

    from glintframe.operators import views

    t = spark.createDataFrame([(k, i, float(k * i)) for k in (0, 1) for i in range(20)], "cell_id int, t int, v double")
    got = views.rescale_traces(t, 5).collect()
    assert len(got) == 30 and max(r["v"] for r in got) == 1 and {r["v"] for r in got if r["cell_id"] == 0} == {0.0}
    f = spark.createDataFrame([(0, 3, 4, 0.5), (0, 4, 4, 1.0), (1, 0, 0, 2.0)], "cell_id int, r int, c int, w double")
    crops = views.footprint_crops(f, 6, 8)
    z = {r["cell_id"]: r for r in crops.collect()}
    assert (z[0]["r0"], z[0]["c0"], len(z[0]["z"]), len(z[0]["z"][0])) == (1, 2, 5, 5) and z[0]["z"][3][2] == 1.0 and z[1]["z"][0][0] == 2.0
    props = images.region_props(images.components(spark.createDataFrame([(3, 4), (4, 4), (0, 7)], "r int, c int"), 8))
    panels = views.region_panels(f, props)
    p = {r["cell_id"]: r for r in panels.collect()}
    assert p[0]["region_diameter"] == round(2 * math.sqrt(2 / math.pi), 2) == p[0]["footprint_diameter"] and p[1]["region_id"] is None
    m = spark.createDataFrame([(0, 0.5, None, 1.0, 3)], "cell_id int, noise_sigma double, snr_median double, spectral_hf_snr double, n_spikes int")
    rec = {r["cell_id"]: json.loads(r["json"]) for r in views.explorer(t, m, crops, panels, 10.0, 5, 8).collect()}
    assert rec[1]["Y"] == [float(i) for i in range(0, 15, 2)] and rec[0]["ns"] == 0.5 and rec[0]["nsp"] == 3 and "sm" not in rec[0]


def test_orientation_of_a_round_well(spark):
    from glintframe.operators import mosaics

    # A bright ring seen by overlapping tiles; the stage's y axis runs against the rows.
    y, x = np.mgrid[0:204, 0:204]
    well = 100 * np.exp(-((np.hypot(y - 101.5, x - 101.5) - 87) ** 2) / 18) + np.random.default_rng(18).uniform(0, 5, (204, 204))
    rows, meta = [], []
    for k, (r, c) in enumerate((r, c) for r in range(0, 161, 40) for c in range(0, 161, 40)):
        part = well[r : r + 44, c : c + 44]
        rows += [(k, i, j, float(v)) for (i, j), v in np.ndenumerate(part)]
        meta.append((k, c * 0.5, -r * 0.5))
    tiles = spark.createDataFrame(rows, "tile int, r int, c int, v double").cache()
    m = spark.createDataFrame(meta, "tile int, x_pos double, y_pos double")
    scores = mosaics.orientation_scores(tiles, m, 0.5, 44, ds=2, bins=36).cache()
    by = {(r["sx"], r["sy"], r["swap"]): r for r in scores.collect()}
    best = mosaics.recover_axes(scores, 25)
    assert best == (1, -1, False) and by[best]["ncc"] > 0.99 and by[best]["roughness"] == min(r["roughness"] for r in by.values())
    mosaic, off, a = mosaics.build_mosaic(tiles, m, 0.5, 44, best)
    assert np.array_equal(array(mosaic, (204, 204)), np.floor(well))
    assert mosaics.affine_residual(m, off, a, 44).first()["residual"] < 0.51
    assert mosaics.recover_axes(scores, 3) == (1, 1, False)


def test_shape_without_a_sidecar(spark, tmp_path):
    rng = np.random.default_rng(19)
    base = reg.gaussian(rng.uniform(0, 1, (12, 25)), 2) * 60_000
    movie = np.stack([base + rng.normal(0, 20, base.shape) for _ in range(4)]).clip(0, 65535).astype("<u2")
    (tmp_path / "frames1.bin").write_bytes(movie.tobytes())
    best = raw_movie.search_shapes(spark, str(tmp_path / "frames1.bin"), 8, 40).first()
    assert (best["pixels"], best["nrow"], best["ncol"]) == (300, 12, 25)
    assert raw_movie.detect_pixels(spark, str(tmp_path), "frames1.bin", 8, 40) == 300
    (tmp_path / "n.txt").write_text("pixels_per_frame=150")
    assert raw_movie.detect_pixels(spark, str(tmp_path), "frames1.bin", 8, 40) == 150


def test_folders_report_failures(spark, tmp_path):
    (tmp_path / "fov1").mkdir()
    (tmp_path / "fov1" / "frames1.bin").write_bytes(b"\1\2")
    rows = pipelines.process_folders(spark, str(tmp_path)).collect()
    assert [r["folder"] for r in rows] == ["fov1"] and "ValueError" in rows[0]["error"]


def test_mean_coherence(spark):
    rng = np.random.default_rng(20)
    y = rng.normal(size=3000)
    a = spark.createDataFrame([(0, y.tolist())], "cell_id int, y array<double>")
    pairs = spark.createDataFrame([(0, 0, 0.0)], "i_a long, j_b long, dist double")
    c = snr.mean_coherence(pairs, a, a, 800, nperseg=256).collect()
    assert len(c) == 129 and min(r["coherence"] for r in c if r["freq"] > 30) == pytest.approx(1)


def test_cut_tables_can_be_deleted(spark):
    from pathlib import Path

    from glintframe.sources import shared

    df = shared.checkpointed(spark.range(5))
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    folder = Path(shared.shared_folder(spark).removeprefix("file:"))
    mine = [Path(p.removeprefix("file:")) for p in shared._written[spark.sparkContext.applicationId]]
    assert all(p.parent == folder and p.exists() for p in mine)
    assert shared.forget_tables(spark) == len(mine) and not any(p.exists() for p in mine)


def test_stored_results_are_oriented(spark, tmp_path):
    from glintframe.kernels import hdf5
    from glintframe.sources.containers import orient, read_result

    y, at = np.arange(12.0).reshape(3, 4), np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    for k, (a, b) in enumerate(((y.T, at.T), (y, at.T), (y.T, at), (y, at))):  # as stored, and turned round
        (tmp_path / f"r{k}.h5").write_bytes(hdf5.write({"cell_traces": a, "footprint_center": b}))
    (tmp_path / "none.h5").write_bytes(hdf5.write({"other": y}))
    rows = read_result(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and {r["path"].rpartition("/")[2] for r in rows} == {f"r{k}.h5" for k in range(4)}
    for r in rows:
        assert r["y"] == y[r["cell_id"]].tolist() and [r["row"], r["col"]] == at[r["cell_id"]].tolist()
    with pytest.raises(ValueError, match="centres"):
        orient(np.zeros((5, 7)), at)


def test_variants_and_report(spark, sf):
    rng = np.random.default_rng(2)
    t = np.arange(4000) / 800
    y = rng.normal(size=4000) + 3 * np.sin(2 * np.pi * 60 * t)
    y[200::400] += 40
    cells = spark.createDataFrame([(1, y.tolist())], "cell_id int, y array<double>")
    by = {r["variant"]: r for r in snr.variant_effects(cells, 800.0, snr.VARIANTS | {"half": lambda x, _: x / 2}).collect()}
    assert set(by) == {"baseline", "notch", "half"} and by["baseline"]["amplitude_ratio"] == 1.0
    assert by["notch"]["sigma"] < 0.6 * by["baseline"]["sigma"] and by["notch"]["amplitude_ratio"] > 0.9
    assert by["half"]["sigma"] == pytest.approx(by["baseline"]["sigma"] / 2) and by["half"]["amplitude_ratio"] == pytest.approx(0.5)
    lines = [r["text"] for r in catalog.queries()["run_report"](spark, sf).collect()]
    assert lines[0].startswith("A and B: matched cells") and len(lines) == 1 + 3 + 7
    assert lines[1].startswith("corr_raw") and lines[4].startswith("noise_sigma")


def test_traces_are_filtered_side_by_side(spark):
    """One call for all traces of a length, in the order given; and each row as if it were filtered alone."""
    rng = np.random.default_rng(8)
    traces = [rng.normal(size=n) for n in (64, 90, 64, 64, 90)]
    calls = []
    got = snr._by_length(traces, lambda rows: calls.append(rows.shape) or signal.highpass(rows, 20.0, 800.0))
    assert sorted(calls) == [(2, 90), (3, 64)]
    assert all((g == signal.highpass(y, 20.0, 800.0)).all() for g, y in zip(got, traces, strict=True))
    cells = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(traces)], "cell_id int, y array<double>")
    for r in snr.variant_effects(cells, 800.0, k=1.5).collect():
        x = signal.highpass(snr.VARIANTS[r["variant"]](traces[r["cell_id"]], 800.0), 20.0, 800.0)
        assert r["sigma"] == signal.robust_sigma(x) and r["n_spikes"] == signal.spike_metrics(x, r["sigma"], 800.0, 1.5)["n_spikes"]
    for r in snr.cell_metrics(cells, 800.0, k=1.5).collect():
        assert r.asDict() == {"cell_id": r["cell_id"], **signal.trace_metrics(traces[r["cell_id"]], 800.0, k=1.5)}


def test_long_keys_are_grouped_in_linear_time(spark):
    """Many times in one key, across batches, against the rule written out."""
    rng = np.random.default_rng(3)
    times = np.sort(np.round(rng.random(40_000) * 5000, 2))
    df = spark.createDataFrame([(0, float(v)) for v in times] + [(1, 5.0), (1, 5.0), (None, 1.0), (1, None)], "key int, t double").repartition(5)
    want, first = [], None
    for v in times:
        if first is None or v - first > 0.7:
            want.append([v, v, 0])
            first = v
        want[-1][1:] = [v, want[-1][2] + 1]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "999")
    try:
        got = sorted(tr.tolerance_groups(df, 0.7).collect(), key=lambda r: (r["key"] is None, r["key"], r["first"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [[r["first"], r["last"], r["n"]] for r in got if r["key"] == 0] == want
    assert [tuple(r) for r in got if r["key"] != 0] == [(1, 5.0, 5.0, 2), (None, 1.0, 1.0, 1)]


def test_fields_as_arrays_agree_with_the_long_form(spark):
    """Reference, motion and filter of two fields of unlike length against the operators on the long form of each."""
    from glintframe.operators import frames as fr

    rng = np.random.default_rng(4)
    h, w = 6, 9
    movies = {"a": rng.normal(size=(30, h * w)).cumsum(0), "b": rng.normal(size=(21, h * w))}
    rows = [(f, t, x.tolist()) for f, m in movies.items() for t, x in enumerate(m)]
    frames = spark.createDataFrame([*rows, ("a", 99, None)], "fov string, t int, px array<double>").repartition(4)
    ref = {r["fov"]: r for r in fr.reference_images(frames, h, w).collect()}
    moved = fr.to_long(fr.motion_correct(frames.where("px is not null"), h, w), w)
    filtered = fr.blocks_to_long(fr.filtered_blocks(frames, block=10), w, 10)
    for f, m in movies.items():
        long = fr.to_long(frames.where(f"fov = '{f}'"), w).drop("fov")
        assert np.allclose(np.reshape(ref[f]["reference"], (h, w)), array(mv.reference_image(long, w), (h, w)), atol=1e-9)
        for got, want in ((moved, mv.motion_correct(long)), (filtered, mv.temporal_filter(long))):
            pairs = got.where(f"fov = '{f}'").join(want.withColumnRenamed("v", "u"), ["t", "r", "c"]).selectExpr("count(*) n", "max(abs(v - u)) d").first()
            assert pairs["n"] == m.size and pairs["d"] < 1e-8
    none = frames.where("fov = 'z'")
    assert fr.reference_images(none, h, w).count() == 0 == fr.filtered_blocks(none).count()


def test_fields_in_one_task_agree_with_the_stages(spark):
    """Whole fields in a task, all of them by stages, and some by each way; a field that is all truncated goes."""
    from glintframe.operators import frames as fr

    rng = np.random.default_rng(12)
    h, w, ranges = 6, 9, ((1, 3), (5, 7))
    rows = [(f, t, (50 + 20 * rng.normal(size=h * w)).tolist()) for f, n in (("a", 30), ("b", 41), ("c", 7)) for t in range(n)]
    frames = spark.createDataFrame([*rows, ("a", 99, None)], "fov string, t int, px array<double>").repartition(5)
    got = [{(r["fov"], r["block"], r["t"]): r["y"] for r in fr.process(frames, h, w, ranges, 90.0, block=10, field_bytes=b).collect()} for b in (1 << 20, 0, 35 * h * w * 8)]
    assert len(got[0]) == 6 * (30 + 41) and {k[0] for k in got[0]} == {"a", "b"}
    for other in got[1:]:
        assert other.keys() == got[0].keys() and all(np.allclose(other[k], y, atol=1e-9) for k, y in got[0].items())
    assert fr.process(frames.where("fov = 'z'"), h, w, ranges, 90.0).count() == 0


def test_shared_folder_is_needed_on_a_cluster():
    from glintframe.sources.shared import shared_folder

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("K", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Unset)
