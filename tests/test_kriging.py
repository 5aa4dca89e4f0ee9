"""Nearest points and kriging against numpy."""

import numpy as np
import pytest

from statloom.operators.kriging import Variogram, nearest, ordinary_kriging


def frames(spark, p, v, q):
    points = spark.createDataFrame([(i, float(a), float(b), None if z is None else float(z)) for i, ((a, b), z) in enumerate(zip(p, v))], "id int, x double, y double, v double")
    return points, spark.createDataFrame([(100 + i, float(a), float(b)) for i, (a, b) in enumerate(q)], "id int, x double, y double")


def world():
    r = np.random.default_rng(9)
    p = np.concatenate([r.normal(0, 0.01, (150, 2)), r.uniform(-50, 50, (60, 2)), np.tile([[7.0, 7.0]], (40, 1))])
    return p, r.normal(0, 1, len(p)), np.concatenate([r.uniform(-60, 60, (25, 2)), p[[0, 180, 249]]])


@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest(spark, k):
    p, v, q = world()
    points, queries = frames(spark, p, v, q)
    got = {}
    for r in nearest(queries, points, k).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["j"], r["d"]))
    for i, x in enumerate(q):
        d = np.sqrt(((p - x) ** 2).sum(1))
        place = [np.sum((p[:j] == p[j]).all(1)) for j in range(len(p))]
        want = [j for j in np.lexsort((np.arange(len(p)), d)) if place[j] < k][:k]
        assert [j for j, _ in got[100 + i]] == want
        assert np.allclose([e for _, e in got[100 + i]], d[want])


@pytest.mark.parametrize("model", [Variogram(0.1, 2.0, 30.0), Variogram(0.0, 1.0, 20.0, "exponential"), Variogram(0.3, 1.5, 40.0, "gaussian")])
def test_kriging(spark, model):
    r = np.random.default_rng(10)
    p, q = r.uniform(0, 100, (40, 2)), r.uniform(0, 100, (12, 2))
    v = p[:, 0] / 10 + r.normal(0, 0.1, 40)
    points, queries = frames(spark, p, v, np.concatenate([q, p[:2]]))
    for k in (8, 40):
        got = {x["id"]: x for x in ordinary_kriging(queries, points, model, k).collect()}
        for i, x in enumerate(np.concatenate([q, p[:2]])):
            d = np.sqrt(((p - x) ** 2).sum(1))
            near = np.lexsort((np.arange(40), d))[:k]
            a = np.ones((k + 1, k + 1))
            a[k, k] = 0
            a[:k, :k] = model.covariance(np.sqrt(((p[near][:, None] - p[near]) ** 2).sum(-1)))
            b = np.append(model.covariance(d[near]), 1)
            w = np.linalg.solve(a, b)
            assert abs(got[100 + i]["prediction"] - w[:k] @ v[near]) < 1e-8
            assert abs(got[100 + i]["variance"] - max(0, model.sill - w @ b)) < 1e-8
        for i in (0, 1):  # at an observed place its value is known
            assert abs(got[112 + i]["prediction"] - v[i]) < 1e-8 and got[112 + i]["variance"] < 1e-8


def test_kriging_edges(spark):
    m = Variogram(0.0, 1.0, 5.0)
    points, queries = frames(spark, [(0, 0), (0, 0), (3, 4)], [1.0, 3.0, None], [(1, 1)])
    (one,) = ordinary_kriging(queries, points, m, 4).collect()
    assert abs(one["prediction"] - 2) < 1e-9  # two values at one place
    assert ordinary_kriging(queries, points.where("v > 9"), m).collect() == []
    assert ordinary_kriging(queries.where("id < 0"), points, m).collect() == []
    with pytest.raises(ValueError):
        Variogram(2.0, 1.0, 5.0)
    with pytest.raises(ValueError):
        nearest(queries, points, 0)
