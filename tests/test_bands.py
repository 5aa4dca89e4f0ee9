"""Near points in blocks against all pairs, with crowds, gaps and odd values."""

import numpy as np
import pytest

from statloom.operators import bands, graph, multivariate


@pytest.fixture(scope="module")
def places():
    """A crowd, copies of points, points far apart, and rows that are near nothing."""
    r = np.random.default_rng(41)
    x = np.concatenate([r.normal(0, 0.3, (150, 2)), np.round(r.uniform(-6, 6, (120, 2)), 1), np.repeat(r.uniform(-9, 9, (6, 2)), 5, axis=0), r.uniform(-1e6, 1e6, (20, 2)), [[np.inf, 0.0], [np.nan, 0.0]]])
    v = np.round(r.normal(3, 2, len(x)), 2)
    v[::17] = np.nan
    return x, v


@pytest.fixture(scope="module")
def points(spark, places):
    x, v = places
    return spark.createDataFrame([(f"p{i:03d}", float(a), float(b), None if np.isnan(w) else float(w)) for i, ((a, b), w) in enumerate(zip(x, v, strict=True))], "id string, x double, y double, v double").cache()


@pytest.fixture(scope="module")
def near(places):
    x, _ = places
    with np.errstate(invalid="ignore"):
        d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.where(d <= 0.7, d, np.nan)


@pytest.fixture(params=[1 << 25, 2000], ids=["whole", "parted"])
def group(request, monkeypatch):
    """A cell's points in one group, or in several."""
    monkeypatch.setattr(bands.fold, "__defaults__", (request.param,))


def test_sums(points, near, group):
    want = {f"p{i:03d}": (int(np.isfinite(r).sum()), np.nansum(r)) for i, r in enumerate(near) if np.isfinite(r).any()}
    got = {r["i"]: (r["n"], r["total"]) for r in graph.band_sums(points, "id", "x", "y", 0.7).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)


def test_moran_and_geary(points, places, near, group):
    v = places[1]
    z, w = v - np.nanmean(v), np.isfinite(near)
    n, s0, m2 = len(v), w.sum(), np.nansum(z * z)
    i = n / s0 * np.nansum(w * np.outer(z, z)) / m2
    s2 = ((2.0 * w.sum(1)) ** 2).sum()
    variance = (n * n * 2 * s0 - n * s2 + 3.0 * s0 * s0) / ((n * n - 1.0) * s0 * s0) - 1 / (n - 1) ** 2
    row = graph.band_moran(points, "id", "x", "y", "v", 0.7).first()
    assert np.allclose([row["i"], row["expected"], row["variance"]], [i, -1 / (n - 1), variance])
    c = (n - 1) * np.nansum(w * np.subtract.outer(z, z) ** 2) / (2 * s0 * m2)
    assert np.isclose(graph.band_geary(points, "id", "x", "y", "v", 0.7).first()["c"], c)


def test_variogram(points, places, near, group):
    v = places[1]
    i, j = np.nonzero(np.isfinite(np.triu(near)) & np.triu(np.ones_like(near, bool), 1))
    at, e = np.floor(near[i, j] / 0.1), (v[i] - v[j]) ** 2
    got = {r["bin"]: r for r in graph.band_variogram(points, "id", "x", "y", "v", 0.7, 0.1).collect()}
    assert got.keys() == set(at.astype(int))
    for b, r in got.items():
        assert r["n"] == (at == b).sum() and np.isclose(r["distance"], near[i, j][at == b].mean()) and np.isclose(r["gamma"], np.nanmean(e[at == b]) / 2)


def test_pairs_across_a_far_cell_border(spark):
    """Rounded, the distance is the threshold; the cells by exact quotients were two apart."""
    df = spark.createDataFrame([(1, -1e-17, 0.0), (2, 1.5, 0.0), (3, 1.5, 1e9)], "id long, x double, y double")
    assert {tuple(r) for r in graph.band_weights(df, "id", "x", "y", 1.5).collect()} == {(1, 2, 1.5), (2, 1, 1.5)}


def test_crowd_is_counted_without_pairs(spark):
    """1.4e8 pairs in one cell: counted in several groups."""
    df = spark.range(12_000).selectExpr("id", "id % 7 / 1000 AS x", "id % 5 / 1000 AS y", "id % 3 AS v")
    got = graph.band_sums(df, "id", "x", "y", 1.0).selectExpr("count(*)", "min(n)", "max(n)").first()
    assert tuple(got) == (12_000, 11_999, 11_999)
    assert graph.band_moran(df, "id", "x", "y", "v", 1.0).first()["i"] == pytest.approx(-1 / 11_999)


def clusters(near, least):
    near = near | np.eye(len(near), dtype=bool)
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(near)), len(near))
    while True:
        new = np.where(core, np.where(near & core, label, len(near)).min(1), len(near))
        if (new == label).all():
            break
        label = new
    return core, np.where(near & core, label, len(near)).min(1)


@pytest.mark.parametrize("least", [1, 4])
def test_dbscan(points, near, group, least):
    core, label = clusters(np.isfinite(near), least)
    got = {r["id"]: (r["cluster"], r["core"]) for r in multivariate.dbscan(points, "id", "x", "y", 0.7, least).collect()}
    assert got == {f"p{i:03d}": (f"p{label[i]:03d}" if label[i] < len(label) else None, bool(core[i])) for i in range(len(label))}


def test_vectors_of_any_size(spark, group):
    r = np.random.default_rng(42)
    x = [r.normal(0, 1, 2 + (i % 2) * 3).tolist() for i in range(120)] + [None, [0.0, None]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x array<double>")
    want = np.zeros((len(x), len(x)), bool)
    for i, a in enumerate(x):
        for j, b in enumerate(x):
            want[i, j] = i != j and a is not None and b is not None and len(a) == len(b) and None not in a + b and np.linalg.norm(np.subtract(a, b)) <= 1.2
    assert {(p["i"], p["j"]) for p in multivariate.vector_band(df, "id", "x", 1.2).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    core, label = clusters(want, 4)
    got = {p["id"]: (p["cluster"], p["core"]) for p in multivariate.dbscan_vectors(df, "id", "x", 1.2, 4).collect()}
    assert got == {i: (int(label[i]) if label[i] < len(x) else None, bool(core[i])) for i in range(len(x))}
