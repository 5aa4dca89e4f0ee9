"""Diagnostics of series and chains, edge weights, and clusters of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import graph, multivariate, resampling, statespace


def test_volatility_diagnostics(spark):
    r = np.random.default_rng(29)
    series = {"a": r.normal(0, 1, 200), "b": np.cumsum(r.normal(0, 1, 90)), "short": np.array([1.0]), "flat": np.full(30, 2.0)}
    rows = [(s, i, float(v)) for s, x in series.items() for i, v in enumerate(x)] + [("a", 999, None)]
    got = {x["s"]: x for x in statespace.volatility_diagnostics(spark.createDataFrame(rows, "s string, t int, z double"), "z", "t", ["s"], 5).collect()}
    for s in ("a", "b"):
        z, x = series[s], got[s]
        n, c = len(z), z - z.mean()
        v = z.var(ddof=1)
        assert np.allclose([x["mean"], x["variance"], x["skewness"], x["kurtosis"]], [z.mean(), v, (c**3).mean() / v**1.5, (c**4).mean() / v**2 - 3])
        for name, u in (("ljung_box", z), ("ljung_box_squared", z * z)):
            d = u - u.mean()
            assert abs(x[name] - n * (n + 2) * sum(((d[k:] * d[:-k]).sum() / (d * d).sum()) ** 2 / (n - k) for k in range(1, 6))) < 1e-8
        q = z * z
        a = np.column_stack([np.ones(n - 5), *(q[5 - k : n - k] for k in range(1, 6))])
        e = q[5:] - a @ np.linalg.lstsq(a, q[5:], rcond=None)[0]
        assert abs(x["arch"] - (n - 5) * (1 - e @ e / ((q[5:] - q[5:].mean()) ** 2).sum())) < 1e-8
    assert got["short"]["mean"] == 1.0 and got["short"]["variance"] is None
    assert got["flat"]["ljung_box"] == 0.0 and got["flat"]["skewness"] is None and got["flat"]["arch"] == 0.0


def test_chain_diagnostics(spark):
    r = np.random.default_rng(30)
    x = r.normal(0, 1, (3, 300))
    x[2] += 0.5
    rows = [(c, t, float(v)) for c in range(3) for t, v in enumerate(x[c])]
    got = resampling.chain_diagnostics(spark.createDataFrame(rows, "c int, t int, x double"), "c", "x", "t", 20).orderBy("c").collect()
    w, b = x.var(1, ddof=1).mean(), x.mean(1).var(ddof=1)
    assert np.allclose([g["r_hat"] for g in got], np.sqrt((299 / 300 * w + b) / w))
    assert np.allclose([(g["n"], g["mean"], g["sd"]) for g in got], [(300, v.mean(), v.std(ddof=1)) for v in x]) and all(50 < g["effective"] <= 300 for g in got)


def test_edge_weights(spark):
    e = spark.createDataFrame([(1, 2, 2.0), (2, 1, 3.0), (1, 1, 9.0), (3, 1, None), (None, 2, 1.0)], "src int, dst int, w double")
    both = {(r["src"], r["dst"]): r["weight"] for r in graph.edge_weights(e, "w").collect()}
    assert both == {(1, 2): 5.0, (2, 1): 5.0, (3, 1): 1.0, (1, 3): 1.0}
    assert {(r["src"], r["dst"]): r["weight"] for r in graph.edge_weights(e, directed=True).collect()} == {(1, 2): 1.0, (2, 1): 1.0, (3, 1): 1.0}
    assert {r["id"]: r["strength"] for r in graph.strength(e, "w", directed=True).collect()} == {1: 2.0, 2: 3.0, 3: 1.0}
    assert {r["id"]: r["strength"] for r in graph.strength(e, "w").collect()} == {1: 6.0, 2: 5.0, 3: 1.0}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_clusters_of_vectors(spark, size):
    r = np.random.default_rng(31)
    x = np.concatenate([r.normal(0, 0.3, (30, size)), r.normal(4, 0.3, (30, size)), r.uniform(-9, 9, (15, size))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, x array<double>")
    eps, least = 0.5 * size**0.5, 4
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    near = (d <= eps) & ~np.eye(75, dtype=bool)
    pairs = {(p["i"], p["j"]): p["d"] for p in multivariate.vector_band(df, "id", "x", eps).collect()}
    assert set(pairs) == set(zip(*map(list, np.nonzero(near)))) and all(abs(v - d[k]) < 1e-9 for k, v in pairs.items())
    core = near.sum(1) + 1 >= least
    label = {}
    for i in np.flatnonzero(core):
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if label.setdefault(k, i) == i:
                    todo += [j for j in np.flatnonzero(near[k] & core) if j not in label]
    got = {g["id"]: (g["cluster"], g["core"]) for g in multivariate.dbscan_vectors(df, "id", "x", eps, least).collect()}
    for i in range(75):
        want = label.get(i) if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=None)
        assert got[i] == (want, bool(core[i]))
    with pytest.raises(ValueError):
        multivariate.vector_band(df, "id", "x", 0.0)
