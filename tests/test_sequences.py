"""Series, mixed and additive models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.vectors import bspline_basis
from statloom.operators import graph, mixed, multivariate, regression, resampling, sensitivity, statespace


def _series(spark, *values):
    return spark.createDataFrame([(k, i, float(v)) for k, x in enumerate(values) for i, v in enumerate(x)], "s int, t int, x double")


def _column(df, *names):
    rows = df.where("s = 0").orderBy("t").collect()
    return [np.array([r[n] for r in rows]) for n in names]


def test_smoother_equals_the_normal_posterior(spark):
    rng = np.random.default_rng(1)
    v = np.cumsum(rng.normal(size=12)) + rng.normal(size=12)
    v[5] = np.nan
    (state,) = _column(statespace.kalman(_series(spark, v), "x", "t", ["s"], [[1.0]], [1.0], [[1.0]], 1.0, smooth=True), "state")
    cov = 1e7 + np.minimum.outer(np.arange(12), np.arange(12)) + 1.0  # of the walk
    seen = np.isfinite(v)
    want = cov[:, seen] @ np.linalg.solve(cov[np.ix_(seen, seen)] + np.eye(seen.sum()), v[seen])
    assert state[:, 0] == pytest.approx(want, abs=1e-3)


def test_em_and_arima_recover_parameters(spark):
    rng = np.random.default_rng(2)
    walk = np.cumsum(rng.normal(0, 1.0, 400)) + rng.normal(0, 2.0, 400)
    r = statespace.state_space_em(_series(spark, walk), "x", "t", ["s"]).first()
    assert 0.4 < r["q"][0] < 2.2 and 2.5 < r["r"] < 6
    e = rng.normal(size=1500)
    y = np.zeros(1500)
    for i in range(1, 1500):
        y[i] = 0.6 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    r = statespace.arima(_series(spark, y + 3), "x", "t", ["s"], 1, 0, 1).first()
    assert abs(r["ar"][0] - 0.6) < 0.1 and abs(r["ma"][0] - 0.4) < 0.12 and abs(r["variance"] - 1) < 0.15
    f = statespace.arima_forecast(_series(spark, np.arange(60) * 2.0), "x", "t", ["s"], 0, 1, 0, 3).orderBy("step").collect()
    assert [x["mean"] for x in f] == pytest.approx([120, 122, 124])
    best = statespace.auto_arima(_series(spark, np.cumsum(y)), "x", "t", ["s"], 2, 1, 1).first()
    assert best["d"] == 1


def test_smoothing_and_changepoints(spark):
    x = np.arange(40.0)
    df = spark.createDataFrame([(0, float(a), 3 * float(a) - 1) for a in x], "s int, x double, y double")
    assert all(r["fitted"] == pytest.approx(r["y"], abs=1e-8) for r in statespace.loess(df, "x", "y", ["s"]).collect())
    knots = [(0.0, 1.0), (1.0, 2.0), (3.0, -1.0), (4.0, 0.5)]
    at = [r[0] for r in df.where("x < 5").orderBy("x").select(statespace.cubic_spline(knots, "x")).collect()]
    assert [at[0], at[1], at[3], at[4]] == pytest.approx([1.0, 2.0, -1.0, 0.5])
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 50), rng.normal(6, 1, 40), rng.normal(-3, 1, 30)])
    (segment,) = _column(statespace.binary_segmentation(_series(spark, v), "x", "t", ["s"]), "segment")
    assert segment.tolist() == [0] * 50 + [1] * 40 + [2] * 30
    length, change = _column(statespace.online_changepoints(_series(spark, v), "x", "t", ["s"]), "run_length", "change")
    assert length[49] >= 45 and length[60] <= 12 and change[50:54].max() > 0.1


def test_garch_recovers_persistence(spark):
    rng = np.random.default_rng(4)
    e, s = np.zeros(2500), 1.0
    for i in range(1, 2500):
        s = 0.1 + 0.15 * e[i - 1] ** 2 + 0.75 * s
        e[i] = np.sqrt(s) * rng.normal()
    r = statespace.garch(_series(spark, e), "x", "t", ["s"]).first()
    assert abs(r["parameters"][1] - 0.15) < 0.08 and abs(r["parameters"][2] - 0.75) < 0.12
    for kind in ("arch", "gjr", "egarch"):
        assert statespace.garch(_series(spark, e), "x", "t", ["s"], kind).first()["log_likelihood"] > -4500
    f = [x["variance"] for x in statespace.garch_forecast(_series(spark, e), "x", "t", ["s"], 60).orderBy("step").collect()]
    assert abs(f[-1] - e.var()) < 0.4 * e.var()


def _log_likelihood(y, x, g, b, error, cov, z):
    total = 0.0
    for k in np.unique(g):
        i = g == k
        v = error * np.eye(i.sum()) + z[i] @ cov @ z[i].T
        r = y[i] - x[i] @ b
        total -= 0.5 * (np.linalg.slogdet(2 * np.pi * v)[1] + r @ np.linalg.solve(v, r))
    return total


@pytest.mark.parametrize("slope", [None, "a"])
def test_mixed_model_is_at_the_top_of_the_likelihood(spark, slope):
    rng = np.random.default_rng(5)
    g = rng.integers(0, 15, 300)
    a = rng.normal(size=300)
    u = rng.normal(0, 1.5, (15, 2)) * [1, 0.6]
    y = 2 + 1.5 * a + u[g, 0] + (u[g, 1] * a if slope else 0) + rng.normal(0, 0.7, 300)
    df = spark.createDataFrame([(int(k), float(p), float(q)) for k, p, q in zip(g, a, y, strict=True)], "g int, a double, y double")
    model, groups = mixed.mixed_model(df, ["a"], "y", "g", slope=slope, rounds=150)
    x = np.column_stack([np.ones(300), a])
    z = x if slope else x[:, :1]
    at = lambda b=model.coefficients, e=model.stats["residual"], c=model.stats["random"]: _log_likelihood(y, x, g, b, e, c, z)
    top = at()
    assert top == pytest.approx(model.stats["log_likelihood"], rel=1e-5)
    for d in (np.array([0.05, 0]), np.array([0, 0.05]), np.array([-0.05, 0.02])):
        assert at(b=model.coefficients + d) < top
    assert max(at(e=model.stats["residual"] * f) for f in (0.9, 1.1)) < top and max(at(c=model.stats["random"] * f) for f in (0.7, 1.4)) < top + 1e-3
    assert groups.count() == 15 and model.se[1] > 0
    assert np.corrcoef([r["intercept"] for r in groups.orderBy("g").collect()], u[:, 0])[0, 1] > 0.95


def test_additive_and_consensus(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(0, 6, 1500), rng.uniform(-1, 1, 1500)
    y = np.sin(a) + b * b + rng.normal(0, 0.1, 1500)
    df = spark.createDataFrame([(float(p), float(q), float(v)) for p, q, v in zip(a, b, y, strict=True)], "a double, b double, y double")
    model = mixed.additive_model(df, ["a", "b"], "y")
    assert model.stats["r2"] > 0.97
    curve = model.partial_dependence(spark, "a", 30).toPandas()
    assert np.corrcoef(curve["effect"], np.sin(curve["x"]))[0, 1] > 0.99
    y[:300] += rng.uniform(5, 30, 300)
    y2 = 1 + 2 * a + rng.normal(0, 0.1, 1500) + np.where(np.arange(1500) < 400, rng.uniform(5, 40, 1500), 0)
    df = spark.createDataFrame([(i, float(p), float(v)) for i, (p, v) in enumerate(zip(a, y2, strict=True))], "i int, a double, y double")
    line, n = mixed.consensus_regression(df, ["a"], "y", "i", threshold=0.5)
    assert line.coefficients == pytest.approx([1, 2], abs=0.05) and 1050 < n < 1150


def test_vector_autoregression(spark):
    rng = np.random.default_rng(7)
    v = np.zeros((600, 2))
    for i in range(1, 600):
        v[i] = [0.5 * v[i - 1, 0] + 0.2 * v[i - 1, 1], 0.3 * v[i - 1, 1]] + rng.normal(size=2)
    df = spark.createDataFrame([(0, i, float(p), float(q)) for i, (p, q) in enumerate(v)], "s int, t int, a double, b double")
    m = mixed.vector_autoregression(df, ["a", "b"], "t", ["s"], 1)
    want = np.linalg.lstsq(np.column_stack([np.ones(599), v[:-1]]), v[1:], rcond=None)[0]
    assert m.lags[0] == pytest.approx(want[1:].T) and m.intercept == pytest.approx(want[0])
    assert m.forecast(v[-1:], 1)[0] == pytest.approx(want[0] + v[-1] @ want[1:])
    assert m.variance_decomposition(8).sum(axis=1) == pytest.approx([1, 1]) and m.impulse_response(3).shape == (4, 2, 2)
    assert mixed.select_lags(df, ["a", "b"], "t", ["s"], 3)["bic"] == 1
    walk = np.cumsum(rng.normal(size=500))
    df = spark.createDataFrame([(0, i, float(w), float(w + e)) for i, (w, e) in enumerate(zip(walk, rng.normal(size=500), strict=True))], "s int, t int, a double, b double")
    values, trace = mixed.johansen(df, ["a", "b"], "t", ["s"])
    assert trace[0] > 30 and trace[1] < 12 and values[0] > values[1]


def test_families_of_glm(spark):
    rng = np.random.default_rng(8)
    a = rng.uniform(0, 1, 800)
    y = rng.poisson(np.exp(0.5 + a)) * rng.gamma(2.0, 0.5, 800)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, y, strict=True)], "a double, y double")
    model = regression.glm(df, ["a"], "y", regression.tweedie(1.5))
    assert model.coefficients == pytest.approx([0.5, 1.0], abs=0.25) and model.stats["dispersion"] > 0


def test_betweenness_and_diameter(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (1, 5), (5, 3), (6, 7)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(df).collect()}
    assert got == pytest.approx({0: 0, 1: 4.5, 2: 2, 3: 4.5, 4: 0, 5: 2, 6: 0, 7: 0})
    assert graph.diameter(df).first()[0] == 4
    found = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert found == {**dict.fromkeys(range(6), 0), 6: 6, 7: 6}
    chain = spark.createDataFrame([(i, i + 1) for i in range(90)], "src long, dst long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}


def test_variogram_fit(spark):
    rows = [(k, 100, k + 0.5, 2 + 5 * (1.5 * (k + 0.5) / 12 - 0.5 * ((k + 0.5) / 12) ** 3 if k + 0.5 < 12 else 1.0)) for k in range(20)]
    nugget, sill, reach = graph.fit_variogram(spark.createDataFrame(rows, "bin int, n long, distance double, gamma double"))
    assert nugget == pytest.approx(2, abs=0.2) and sill == pytest.approx(7, abs=0.2) and reach == pytest.approx(12, abs=0.8)


def test_factors_bases_and_inputs(spark):
    rng = np.random.default_rng(9)
    f = rng.normal(size=2000)
    x = np.column_stack([0.9 * f, 0.8 * f, 0.7 * f, -0.6 * f]) + rng.normal(size=(2000, 4)) * np.sqrt(1 - np.array([0.9, 0.8, 0.7, 0.6]) ** 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    loadings, _ = multivariate.factor_analysis(df, ["a", "b", "c", "d"], 1)
    assert loadings[:, 0] == pytest.approx([0.9, 0.8, 0.7, -0.6], abs=0.06)
    b = spark.range(50).select(bspline_basis(F.col("id") / 50, 7).alias("b")).collect()
    assert all(sum(r["b"]) == pytest.approx(1) and min(r["b"]) >= 0 for r in b)
    r = sensitivity.sobol_indices(spark, lambda v: 3 * v[0] + v[1], 3, 20_000).orderBy("input").collect()
    assert [x["first"] for x in r] == pytest.approx([0.9, 0.1, 0], abs=0.04) and [x["total"] for x in r] == pytest.approx([0.9, 0.1, 0], abs=0.04)
    r = sensitivity.fourier_indices(spark, lambda v: 3 * v[0] + v[1], 2).orderBy("input").collect()
    assert [x["first"] for x in r] == pytest.approx([0.9, 0.1], abs=0.05)


def test_resampled_means(spark):
    rng = np.random.default_rng(10)
    v = rng.normal(5, 2, 3000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double")
    for kind in ("poisson", "exponential"):
        r = resampling.replicate_interval(resampling.resampled_means(df, "x", "i", kind, 300)).first()
        assert r["estimate"] == pytest.approx(v.mean(), abs=0.02) and r["se"] == pytest.approx(2 / 3000**0.5, rel=0.2)
    a, b = (sorted(map(tuple, resampling.resampled_means(d, "x", "i").collect())) for d in (df, df.repartition(7)))
    assert [x[1] for x in a] == pytest.approx([x[1] for x in b])
    wild = resampling.replicate_interval(resampling.resampled_means(df.withColumn("x", F.col("x") - float(v.mean())), "x", "i", "mammen", 300)).first()
    assert wild["se"] == pytest.approx(2 / 3000**0.5, rel=0.2)
    assert resampling.sign_flip_test(df, "x", "i", float(v.mean())).first()["p_value"] > 0.01 > resampling.sign_flip_test(df, "x", "i", 4.5).first()["p_value"]
    zip_ = [(float(z),) for z in np.where(rng.random(4000) < 0.3, 0, rng.poisson(4, 4000))]
    rate, share = resampling.fit_zero_inflated_poisson(spark.createDataFrame(zip_, "x double"), "x")
    assert rate == pytest.approx(4, abs=0.2) and share == pytest.approx(0.3, abs=0.03)
