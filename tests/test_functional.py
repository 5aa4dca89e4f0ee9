"""Curves against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import functional as C


@pytest.fixture(scope="module")
def curves(spark):
    r = np.random.default_rng(23)
    out = {}
    for c in range(12):
        t = np.sort(r.uniform(0, 10, 30))
        out[c] = (t, r.normal(0, 2) * np.sin(t / 3) + r.normal() * t / 5 + r.normal(0, 0.1, 30))
    rows = [(c, float(a), float(b)) for c, (t, y) in out.items() for a, b in zip(t, y)] + [(0, None, 1.0), (0, 2.0, None), (99, 5.0, 3.0)]
    return out, spark.createDataFrame(rows, "c int, t double, y double").repartition(4).cache()


def basis_values(spark, basis, t):
    return np.array([r["f"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "i int, t double").select("i", basis.column("t").alias("f")).orderBy("i").collect()])


@pytest.mark.parametrize("basis", [C.Basis("polynomial", 3, 0, 10), C.Basis("fourier", 5, 0, 10), C.Basis("bspline", 6, 0, 10)], ids=lambda b: b.kind)
def test_smoothing(spark, curves, basis):
    own, df = curves
    for penalty in (0.0, 0.5):
        got = {r["c"]: r for r in C.smooth_curves(df, ["c"], "t", "y", basis, penalty).collect()}
        for c in (0, 5):
            f = basis_values(spark, basis, own[c][0])
            want = np.linalg.solve(f.T @ f + penalty * np.eye(basis.size), f.T @ own[c][1])
            assert got[c]["n"] == 30 and np.allclose(got[c]["coefficients"], want, rtol=1e-6)
        one = basis_values(spark, basis, [5.0])[0]
        assert abs(one @ got[99]["coefficients"] * (1 + penalty / (one @ one)) - 3) < 1e-6  # one value: the shortest solution
    made = C.smooth_curves(df, ["c"], "t", "y", basis).where("c = 5").select(basis.value("coefficients", F.lit(4.0)).alias("v")).first()["v"]
    assert abs(made - basis_values(spark, basis, [4.0])[0] @ C.smooth_curves(df, ["c"], "t", "y", basis).where("c = 5").first()["coefficients"]) < 1e-9


def test_mean_curve(curves):
    own, df = curves
    grid = [-1.0, 0.5, 3.0, 7.25, 9.99, 12.0]
    got = {r["t"]: r for r in C.mean_curve(df, ["c"], "t", "y", grid).collect()}
    for g in grid:
        assert got[g]["n"] == 13
        assert abs(got[g]["mean"] - np.mean([*(np.interp(g, t, y) for t, y in own.values()), 3.0])) < 1e-9


def test_products_and_components(spark, curves):
    _, df = curves
    basis = C.Basis("bspline", 6, 0, 10)
    w = basis.metric(spark)
    t = np.linspace(0, 10, 101)
    f = basis_values(spark, basis, t)
    smooth = C.smooth_curves(df.where("c < 99"), ["c"], "t", "y", basis).cache()
    c = np.array([r["coefficients"] for r in smooth.orderBy("c").collect()])
    norms = [r["n"] for r in smooth.orderBy("c").select(C.norm("coefficients", w).alias("n")).collect()]
    assert np.allclose(norms, [np.sqrt(np.trapezoid((f @ x) ** 2, t)) for x in c])
    plain = C.curve_components(smooth, 6, 3)
    values = np.linalg.eigvalsh(np.cov(c.T))[::-1]
    assert np.allclose(plain.values, values[:3]) and np.allclose(plain.explained, values[:3] / values.sum())
    scores = np.array([r["scores"] for r in plain.transform(smooth).orderBy("c").collect()])
    assert np.allclose(scores, (c - c.mean(0)) @ plain.components.T) and np.allclose(np.cov(scores.T), np.diag(plain.values), atol=1e-8)
    under = C.curve_components(smooth, 6, 2, w)
    e = under.components @ f.T
    assert np.allclose([[np.trapezoid(a * b, t) for a in e] for b in e], np.eye(2), atol=1e-6)  # eigenfunctions of length 1, at right angles
    scores = np.array([r["scores"] for r in under.transform(smooth).orderBy("c").collect()])
    assert np.allclose(scores, [[np.trapezoid(a * (f @ (x - c.mean(0))), t) for a in e] for x in c], atol=1e-6)
    assert np.allclose(scores.var(0, ddof=1), under.values, rtol=1e-6)


def test_arguments(curves):
    for bad in (("none", 3), ("fourier", 0), ("bspline", 4, 1.0, 1.0)):
        with pytest.raises(ValueError):
            C.Basis(*bad)
    with pytest.raises(ValueError):
        C.curve_components(C.smooth_curves(curves[1].where("c = 1"), ["c"], "t", "y", C.Basis("polynomial", 2, 0, 10)), 2)
