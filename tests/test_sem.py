"""Paths and factors against numpy and closed forms."""

import numpy as np
import pytest

from statloom.operators import sem


def frame(spark, x, names):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)


def test_paths(spark):
    r = np.random.default_rng(13)
    a = r.normal(0, 2, 3000)
    b = 0.5 * a + r.normal(0, 1, 3000)
    c = -0.7 * b + 0.3 * a + r.normal(5, 1, 3000)
    d = c + r.normal(0, 3, 3000)
    x = np.column_stack([a, b, c, d])
    got = sem.path_analysis(frame(spark, x, "abcd"), [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d")])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    fit = lambda y, *s: np.linalg.lstsq(z[:, s], z[:, y], rcond=None)[0]
    ab, (ac, bc), cd = fit(1, 0)[0], fit(2, 0, 1), fit(3, 2)[0]
    at = {n: k for k, n in enumerate(got.names)}
    total = {(s, t): got.total[at[t], at[s]] for s in "abcd" for t in "abcd"}
    assert np.allclose([total["a", "b"], total["a", "c"], total["a", "d"], total["b", "d"], total["d", "a"]], [ab, ac + ab * bc, (ac + ab * bc) * cd, bc * cd, 0])
    assert abs(got.r_squared["c"] - ((z[:, :2] @ [ac, bc]) ** 2).sum() / (z[:, 2] ** 2).sum()) < 1e-10
    rows = {(q["source"], q["target"]): q for q in got.table(spark).collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert abs(rows["a", "c"]["indirect"] - ab * bc) < 1e-10
    held = sem.path_analysis(frame(spark, x, "abcd"), [("a", "b"), ("b", "c")], {("b", "c"): 0.25})
    assert abs(held.total[2, 0] - 0.25 * ab) < 1e-10


def test_factors_are_recovered(spark):
    r = np.random.default_rng(14)
    f = r.multivariate_normal([0, 0], [[1, 0.4], [0.4, 1]], 20_000)
    load = np.array([0.9, 0.8, 0.7, 0.6, 0.85, 0.75, 0.65])
    x = np.column_stack([f[:, 0 if k < 4 else 1] * l + r.normal(0, np.sqrt(1 - l * l), 20_000) for k, l in enumerate(load)]) * 3 + 7
    df = frame(spark, x, "abcdefg")
    got = sem.confirmatory_factors(df, {"one": "abcd", "two": "efg"}, correlated=True)
    assert got.converged and np.allclose(got.loadings.sum(1), load, atol=0.02) and abs(got.phi[0, 1] - 0.4) < 0.03
    assert got.fit["df"] == 13 and got.fit["p_value"] > 0.001 and got.fit["rmsea"] < 0.02 and got.fit["cfi"] > 0.995 and got.fit["srmr"] < 0.02
    # at the maximum no small change of a free parameter raises the likelihood
    observed = np.corrcoef(x.T)

    def loss(l, phi, u):
        s = l @ phi @ l.T + np.diag(u)
        return np.trace(np.linalg.solve(s, observed)) + np.linalg.slogdet(s)[1]

    u = 1 - got.communality
    best = loss(got.loadings, got.phi, u)
    for i in range(7):
        for h in (-1e-3, 1e-3):
            l = got.loadings.copy()
            l[i, int(i > 3)] += h
            e = np.zeros(7)
            e[i] = h
            assert loss(l, got.phi, u) > best and loss(got.loadings, got.phi, u + e) > best
    apart = sem.confirmatory_factors(df, {"one": "abcd", "two": "efg"})
    assert apart.fit["chi_squared"] > 500 and apart.fit["p_value"] < 1e-12 and apart.fit["bic"] > got.fit["bic"]
    held = sem.confirmatory_factors(df, {"one": "abcd"}, {("one", "a"): 0.5})
    assert held.loadings[0, 0] == 0.5 and held.fit["chi_squared"] > 100


def test_three_indicators_in_closed_form(spark):
    r = np.random.default_rng(15)
    f = r.normal(0, 1, 500)
    x = np.column_stack([f * s + r.normal(0, 1, 500) for s in (1.5, 0.9, -1.2)])
    got = sem.confirmatory_factors(frame(spark, x, "abc"), {"f": "abc"})
    c = np.corrcoef(x.T)
    want = np.sqrt(c[0, 1] * c[0, 2] / c[1, 2])
    assert np.allclose(got.loadings[:, 0], [want, c[0, 1] / want, c[0, 2] / want], atol=1e-6)
    assert got.fit["chi_squared"] < 1e-6 and got.fit["df"] == 0 and got.fit["p_value"] == 1
    assert got.table(spark).count() == 3


def test_indices():
    s = np.array([[1, 0.5, 0.3], [0.5, 1, 0.2], [0.3, 0.2, 1]])
    got = sem.fit_indices(s, np.eye(3), 101, 3)  # independence itself
    chi = -100 * np.log(np.linalg.det(s))
    assert abs(got["chi_squared"] - chi) < 1e-9 and got["df"] == 3 and got["cfi"] == 0 and abs(got["tli"]) < 1e-12
    assert abs(got["rmsea"] - np.sqrt((chi - 3) / 300)) < 1e-12 and abs(got["srmr"] - np.sqrt((0.25 + 0.09 + 0.04) / 6)) < 1e-12
    assert abs(got["aic"] - chi - 6) < 1e-9 and abs(got["bic"] - chi - 3 * np.log(101)) < 1e-9
    assert sem.fit_indices(s, s, 101, 6)["chi_squared"] < 1e-9
