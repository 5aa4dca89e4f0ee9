"""Mixtures and multivariate distributions against numpy and moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import multivariate as D
from statloom.operators import mixtures as M


@pytest.fixture(scope="module")
def planted(spark):
    r = np.random.default_rng(21)
    parts = [r.multivariate_normal(m, c, n) for m, c, n in (([0, 0], [[1, 0.6], [0.6, 1]], 500), ([8, 0], [[1, 0], [0, 3]], 300), ([4, 9], [[2, -1], [-1, 2]], 200))]
    x = np.concatenate(parts) + 1000
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(9999, None, 1.0)]
    return x, spark.createDataFrame(rows, "id int, a double, b double").repartition(4).cache()


def test_bic_finds_the_planted_components(planted):
    x, df = planted
    best, bic = M.select_components(df, ["a", "b"], 4, tol=1e-5)
    assert len(best.weights) == 3 and sorted(bic) == [1, 2, 3, 4] and best.converged
    order = np.argsort(-best.weights)
    assert np.allclose(best.weights[order], [0.5, 0.3, 0.2], atol=0.02)
    assert np.allclose(best.means[order] - 1000, [[0, 0], [8, 0], [4, 9]], atol=0.3)
    labelled = best.transform(df).where("id < 9999").orderBy("id").toPandas()
    want = np.repeat(order, [500, 300, 200])
    assert (labelled["component"] == want).mean() > 0.98 and labelled["probability"].min() > 0.3
    assert best.transform(df).where("id = 9999").first()["component"] is None
    one = M.fit_mixtures(df, ["a", "b"], 1)[1]
    assert np.allclose(one.means[0], x.mean(0)) and np.allclose(one.covariances[0], np.cov(x.T, ddof=0), rtol=1e-5)
    assert best.table(df.sparkSession).count() == 3


def test_a_round_equals_numpy(planted):
    x, df = planted
    got = M.fit_mixtures(df, ["a", "b"], 2, rounds=3)[2]
    # the same rounds from the parameters of the fit before the last
    before = M.fit_mixtures(df, ["a", "b"], 2, rounds=2)[2]
    logs = M._log_parts(x, before.weights, before.means, before.covariances)
    direct = [[np.log(w) - 0.5 * ((v - m) @ np.linalg.inv(c) @ (v - m) + np.log(np.linalg.det(2 * np.pi * c))) for w, m, c in zip(before.weights, before.means, before.covariances)] for v in x[:5]]
    assert np.allclose(logs[:5], direct)
    r = np.exp(logs - logs.max(1, keepdims=True))
    r /= r.sum(1, keepdims=True)
    assert np.allclose(got.weights, r.mean(0)) and np.allclose(got.means, r.T @ x / r.sum(0)[:, None])
    for j in range(2):
        z = x - got.means[j]
        assert np.allclose(got.covariances[j], (r[:, j, None] * z).T @ z / r[:, j].sum() + 1e-6 * np.diag(x.var(0)), rtol=1e-6)


def test_mixture_of_equal_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 20, "a double, b double")
    fits = M.fit_mixtures(df, ["a", "b"], 2, rounds=5)
    assert set(fits) == {1, 2} and np.allclose(fits[2].means, [[1, 2], [1, 2]])


S = ((2.0, 0.6, 0.1), (0.6, 1.0, -0.2), (0.1, -0.2, 0.5))
MEAN = (1.0, -2.0, 0.5)


def density(spark, f, points):
    rows = spark.createDataFrame([(i, None if p is None else [float(v) for v in p]) for i, p in enumerate(points)], "i int, x array<double>")
    return [r["v"] for r in rows.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_densities(spark):
    r = np.random.default_rng(22)
    x = r.normal(0, 2, (6, 3))
    s, m = np.array(S), np.array(MEAN)
    q = [(v - m) @ np.linalg.inv(s) @ (v - m) for v in x]
    got = density(spark, D.MultivariateNormal(MEAN, S).log_pdf, [*x, None])
    assert got[-1] is None and np.allclose(got[:-1], [-0.5 * (a + np.log(np.linalg.det(2 * np.pi * s))) for a in q])
    got = density(spark, D.MultivariateT(5.0, MEAN, S).log_pdf, x)
    from math import lgamma, log, pi

    assert np.allclose(got, [lgamma(4) - lgamma(2.5) - 1.5 * log(5 * pi) - 0.5 * log(np.linalg.det(s)) - 4 * log(1 + a / 5) for a in q])
    d = D.Dirichlet((2.0, 0.5, 3.0))
    got = density(spark, d.pdf, [(0.2, 0.3, 0.5), (0.2, 0.3, 0.6), (0.0, 0.5, 0.5)])
    assert abs(got[0] - np.exp(lgamma(5.5) - lgamma(2) - lgamma(0.5) - lgamma(3) + log(0.2) - 0.5 * log(0.3) + 2 * log(0.5))) < 1e-12 and got[1:] == [0, 0]
    got = density(spark, D.Multinomial(5, (0.2, 0.3, 0.5)).pmf, [(1, 2, 2), (5, 0, 0), (1, 1, 1), (-1, 3, 3)])
    assert np.allclose(got, [30 * 0.2 * 0.09 * 0.25, 0.2**5, 0, 0])
    w = np.array([[3.0, 0.4], [0.4, 1.5]])
    v = np.array([[1.0, 0.2], [0.2, 2.0]])
    gamma2 = lambda a: 0.5 * log(pi) + lgamma(a) + lgamma(a - 0.5)
    got = density(spark, D.Wishart(4.0, tuple(map(tuple, v))).log_pdf, [w.ravel(), [1, 2, 2, 1]])
    assert abs(got[0] - (0.5 * log(np.linalg.det(w)) - 0.5 * np.trace(np.linalg.inv(v) @ w) - 4 * log(2) - 2 * log(np.linalg.det(v)) - gamma2(2.0))) < 1e-10 and got[1] == -np.inf
    got = density(spark, D.InverseWishart(4.0, tuple(map(tuple, v))).log_pdf, [w.ravel()])
    assert abs(got[0] - (2 * log(np.linalg.det(v)) - 4 * log(2) - gamma2(2.0) - 3.5 * log(np.linalg.det(w)) - 0.5 * np.trace(v @ np.linalg.inv(w)))) < 1e-10


@pytest.mark.parametrize("d", [D.MultivariateNormal(MEAN, S), D.MultivariateT(9.0, MEAN, S), D.Dirichlet((2.0, 0.5, 3.0)), D.Multinomial(5, (0.2, 0.3, 0.5)), D.Wishart(6.0, S), D.InverseWishart(9.0, S)], ids=lambda d: type(d).__name__)
def test_draws(spark, d):
    rows = d.sample(spark, 6000, 3).orderBy("id").collect()
    x = np.array([r["x"] for r in rows])
    mean = np.array(MEAN) if type(d).__name__ in ("MultivariateNormal", "MultivariateT") else d.mean().ravel()
    assert np.allclose(x.mean(0), mean, atol=5 * x.std(0).max() / np.sqrt(6000))
    cov = np.array(S) if isinstance(d, D.MultivariateNormal) else d.covariance() if hasattr(d, "covariance") else None
    if cov is not None:
        assert np.allclose(np.cov(x.T), cov, atol=0.12 * np.abs(cov).max())
    again = d.sample(spark, 10, 3).repartition(3).orderBy("id").collect()
    assert [r["x"] for r in again] == [r["x"] for r in rows[:10]]


def test_parameters():
    for bad in (lambda: D.Dirichlet((1.0, 0.0)), lambda: D.Multinomial(3, (0.5, 0.6)), lambda: D.Wishart(1.0, S), lambda: D._lower([[1, 2], [2, 1]])):
        with pytest.raises(ValueError):
            bad()
