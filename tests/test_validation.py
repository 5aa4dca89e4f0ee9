"""Scores from cells of products against models that are fitted to the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import validation as V


def mse(x, y, train, test, penalty=0.0, centre=None):
    a, b = np.column_stack([np.ones(len(y)), x - x.mean(0)]), y - y.mean()
    shrink = penalty * np.diag([0.0, *[1.0] * x.shape[1]])
    w = np.linalg.solve(a[train].T @ a[train] + shrink, a[train].T @ b[train])
    return ((b[test] - a[test] @ w) ** 2).mean()


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    x = r.normal(1e4, 3, (400, 3))
    y = 5e5 + 2 * x[:, 0] - x[:, 1] + r.normal(0, 1, 400)
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame([*rows, (999, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double").repartition(5)


def test_nested(data):
    x, y, df = data
    i = np.arange(400)
    subsets, penalties = [["a"], ["a", "b"], ["a", "b", "c"]], [0.0, 50.0]
    got = {r["fold"]: r for r in V.nested_validation(df, ["a", "b", "c"], "y", F.col("id") % 4, F.floor(F.col("id") / 4) % 3, penalties, subsets).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    for o, r in got.items():
        options = []
        for s in subsets:
            z = x[:, ["abc".index(c) for c in s]]
            for p in penalties:
                inner = [mse(z, y, (i % 4 != o) & (i // 4 % 3 != k), (i % 4 != o) & (i // 4 % 3 == k), p) for k in range(3)]
                options.append((np.mean(inner), s, p, mse(z, y, i % 4 != o, i % 4 == o, p)))
        best = min(options, key=lambda v: v[0])
        assert (r["features"], r["penalty"], r["n"]) == (best[1], best[2], 100)
        assert np.allclose([r["inner_mse"], r["mse"]], [best[0], best[3]], rtol=1e-7)


def test_splits(data):
    x, y, df = data
    i = np.arange(400)
    tests = [F.col("id") % 7 == s for s in range(3)] + [F.col("id") < 0, F.col("id") >= 0]
    got = [tuple(r) for r in V.split_validation(df, ["a", "b", "c"], "y", tests).collect()]
    assert [r[:3] for r in got] == [(s, int((i % 7 != s).sum()), int((i % 7 == s).sum())) for s in range(3)]
    assert np.allclose([r[3] for r in got], [mse(x, y, i % 7 != s, i % 7 == s) for s in range(3)], rtol=1e-7)
    many = V.split_validation(df, ["a", "b"], "y", V.random_tests("id", 50, 0.2)).toPandas()
    assert len(many) == 50 and abs(many["n_test"].mean() - 80) < 5 and 0.6 < many["mse"].mean() < 1.6
    with pytest.raises(ValueError):
        V.random_tests("id", 3, 1.0)


@pytest.mark.parametrize("least, step, horizon, most", [(40, 20, 20, None), (50, 7, 3, 60), (30, 90, 11, None)])
def test_rolling(monkeypatch, data, least, step, horizon, most):
    monkeypatch.setattr(V, "BLOCK", 16)
    x, y, df = data
    got = [tuple(r) for r in V.rolling_validation(df, ["a", "b", "c"], "y", ["id"], least, step, horizon, most).orderBy("window").collect()]
    want, i = [], np.arange(400)
    for k, end in enumerate(range(least, 400 - horizon + 1, step)):
        start = max(0, end - most) if most else 0
        want.append((k, start, end, end + horizon, mse(x, y, (i >= start) & (i < end), (i >= end) & (i < end + horizon))))
    assert [r[:4] for r in got] == [w[:4] for w in want]
    assert np.allclose([r[4] for r in got], [w[4] for w in want], rtol=1e-6)


def test_rolling_of_few_rows(data):
    _, _, df = data
    assert V.rolling_validation(df, ["a"], "y", ["id"], 400, 1, 1).collect() == []
    assert V.rolling_validation(df.where("id < 0"), ["a"], "y", ["id"], 4).collect() == []
    with pytest.raises(ValueError):
        V.rolling_validation(df, ["a"], "y", ["id"], 0)
