"""Proportional hazards, designs, item response and meta-analysis against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import causal, designs, irt, survival


def _brute_cox(t, e, x):
    b = np.zeros(x.shape[1])
    for _ in range(60):
        u, h = np.zeros(len(b)), np.zeros((len(b), len(b)))
        for i in np.flatnonzero(e):
            r = t >= t[i]
            w = np.exp(x[r] @ b)
            m = (w[:, None] * x[r]).sum(0) / w.sum()
            u += x[i] - m
            h += (w[:, None, None] * x[r][:, :, None] * x[r][:, None, :]).sum(0) / w.sum() - np.outer(m, m)
        b = b + np.linalg.solve(h, u)
    ll = sum(x[i] @ b - np.log(np.exp(x[t >= t[i]] @ b).sum()) for i in np.flatnonzero(e))
    return b, np.sqrt(np.diag(np.linalg.inv(h))), ll


def test_cox_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(250, 2))
    t = np.round(rng.exponential(np.exp(-(0.8 * x[:, 0] - 0.5 * x[:, 1]))), 1)  # many ties
    e = rng.random(250) < 0.7
    df = spark.createDataFrame([(float(a), bool(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x, strict=True)] + [(None, True, 0.0, 0.0)], "t double, e boolean, a double, b double")
    model = survival.cox_regression(df, "t", "e", ["a", "b"])
    b, se, ll = _brute_cox(t, e, x)
    assert model.coefficients == pytest.approx(b, abs=1e-7) and np.sqrt(np.diag(model.covariance)) == pytest.approx(se, rel=1e-6)
    shift = e.sum() * 0  # centring leaves the partial likelihood as it is
    assert model.log_likelihood + shift == pytest.approx(ll, rel=1e-9) and model.likelihood_ratio()[1] < 1e-6
    assert [r["term"] for r in model.table(spark).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        survival.cox_regression(df.withColumn("e", F.lit(False)), "t", "e", ["a"])


def test_response_surface_finds_the_top(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (120, 2))
    y = 5 - (x[:, 0] - 0.5) ** 2 - 2 * (x[:, 1] + 0.3) ** 2 + 0.5 * (x[:, 0] - 0.5) * (x[:, 1] + 0.3) + rng.normal(0, 1e-3, 120)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    _, at = designs.response_surface(df, ["a", "b"], "y")
    assert at == pytest.approx([0.5, -0.3], abs=0.01)


def test_blocks_and_latin_square(spark):
    y = np.array([[8, 7, 9], [5, 6, 4], [11, 12, 13], [3, 5, 4]], float)
    df = spark.createDataFrame([(b, t, float(y[b, t])) for b in range(4) for t in range(3)], "block int, treat int, y double")
    got = {r["source"]: r for r in designs.additive_anova(df, "y", ["block", "treat"]).collect()}
    sb, st = 3 * ((y.mean(1) - y.mean()) ** 2).sum(), 4 * ((y.mean(0) - y.mean()) ** 2).sum()
    total = ((y - y.mean()) ** 2).sum()
    assert got["block"]["ss"] == pytest.approx(sb) and got["treat"]["ss"] == pytest.approx(st) and got["error"]["ss"] == pytest.approx(total - sb - st)
    assert got["block"]["statistic"] == pytest.approx(sb / 3 / ((total - sb - st) / 6)) and got["error"]["df"] == 6 and 0 < got["block"]["p_value"] < 0.05
    square = designs.latin_square(spark, 4).withColumn("y", F.col("treatment") * 2.0 + F.col("row"))
    got = {r["source"]: r["ss"] for r in designs.additive_anova(square, "y", ["row", "column", "treatment"]).collect()}
    assert got["treatment"] == pytest.approx(80) and got["row"] == pytest.approx(20) and got["column"] == pytest.approx(0) and got["error"] == pytest.approx(0)


def test_abilities_recover_order(spark):
    rng = np.random.default_rng(2)
    theta = np.linspace(-2, 2, 9)
    items = irt.rasch(spark, np.linspace(-2, 2, 60).tolist())
    p = 1 / (1 + np.exp(-(theta[:, None] - np.linspace(-2, 2, 60))))
    y = rng.random(p.shape) < p
    rows = spark.createDataFrame([(i, j, int(y[i, j])) for i in range(9) for j in range(60)], "person int, item int, y int")
    got = {r["person"]: r for r in irt.abilities(rows, items, "person", "item", "y").collect()}
    found = [got[i]["theta"] for i in range(9)]
    assert np.corrcoef(found, theta)[0, 1] > 0.95 and all(0.1 < got[i]["sd"] < 0.6 for i in range(9))


def _brute_trim(y, v, rounds=50):
    mean = lambda a, b: (a / b).sum() / (1 / b).sum()
    sign = 1.0 if ((y - mean(y, v)) ** 3 / v).sum() >= 0 else -1.0
    order = np.lexsort((v, -sign * y))
    y, v, n, k, centre = y[order], v[order], len(y), 0, mean(y, v)
    for _ in range(rounds):
        d = sign * (y - centre)
        rank = np.array([(np.abs(d) < abs(a)).sum() + (1 + (np.abs(d) == abs(a)).sum()) / 2 for a in d])
        new = int(max(0, min(n - 2, round((4 * rank[d > 0].sum() - n * (n + 1)) / (2 * n - 1)))))
        if new == k:
            break
        k, centre = new, mean(y[new:], v[new:])
    return k, mean(np.append(y, 2 * centre - y[:k]), np.append(v, v[:k]))


@pytest.mark.parametrize("seed", [1, 4])
def test_trim_and_fill_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y, v = np.round(np.append(rng.normal(0, 0.2, 30), rng.uniform(1, 2, 8)), 3), np.round(np.append(rng.uniform(0.02, 0.05, 30), rng.uniform(0.5, 1, 8)), 3)
    df = spark.createDataFrame(list(zip(y.tolist(), v.tolist(), strict=True)), "y double, v double")
    r = causal.trim_and_fill(df, "y", "v").first()
    k, adjusted = _brute_trim(y, v)
    assert r["missing"] == k > 0 and r["side"] == "left" and r["adjusted"] == pytest.approx(adjusted) and r["adjusted"] < r["estimate"]
    even = causal.trim_and_fill(spark.createDataFrame([(x, 0.04) for x in (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3)], "y double, v double"), "y", "v").first()
    assert even["missing"] == 0 and even["adjusted"] == even["estimate"]
