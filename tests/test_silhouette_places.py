"""Silhouettes where many rows are at one place."""

import numpy as np

from statloom.operators import multivariate


def test_rows_at_one_place_are_compared_once(spark, monkeypatch):
    r = np.random.default_rng(45)
    x = r.normal(0, 1, (12, 2)).round(3)
    rows = [(k * 12 + i, x[i].tolist(), "abc"[(k * k + i) % 3]) for k in range(8) for i in range(12)] + [(200, [9.0, 9.0], "alone"), (201, [0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id int, x array<double>, g string")
    at, g = np.array([v[1] for v in rows[:-1]]), np.array([v[2] for v in rows[:-1]])
    d = np.sqrt(((at[:, None] - at) ** 2).sum(-1))
    want = {}
    for i, v in enumerate(rows[:-1]):
        own = (g == g[i]).sum() - 1
        a = d[i][g == g[i]].sum() / own if own else 0.0
        b = min(d[i][g == k].mean() for k in set(g) - {g[i]})
        want[v[0]] = (b - a) / max(a, b) if own else 0.0
    seen, plain = [], multivariate._block_pairs
    monkeypatch.setattr(multivariate, "_block_pairs", lambda t, *a: seen.append(t.count()) or plain(t, *a))
    got = {v["id"]: v["silhouette"] for v in multivariate.silhouettes(df, "id", "x", "g", rows=10).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
    assert seen == [len({(tuple(v[1]), v[2]) for v in rows if v[2]})] and seen[0] < 50
