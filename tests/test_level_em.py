"""The local level's EM with numbers against the filter and smoother with matrices, and in time for long series."""

import time

import numpy as np
import pytest

from statloom.operators import statespace as S


def by_matrices(v, rounds, tol):
    f, h = S.MODELS["level"]
    spread = max(np.nanvar(v), 1e-9)
    q, r, last, ll = np.eye(1) * spread / 2, spread / 2, -np.inf, 0.0
    for _ in range(rounds):
        steps, ll = S._filter(v, f, h, q, r)
        ms, ps, gains = S._smooth(steps, f)
        if ll - last < tol * (1 + abs(ll)):
            break
        last, seen = ll, np.isfinite(v)
        r = max(float(np.mean([(y - m[0]) ** 2 + p[0, 0] for y, m, p in zip(v[seen], np.array(ms)[seen], np.array(ps)[seen], strict=True)])), 1e-12)
        total = sum((ms[k][0] - ms[k - 1][0]) ** 2 + ps[k][0, 0] - 2 * ps[k][0, 0] * gains[k - 1][0, 0] + ps[k - 1][0, 0] for k in range(1, len(v)))
        q = np.array([[max(total / max(1, len(v) - 1), 1e-12)]])
    return q[0, 0], r, ll


@pytest.mark.parametrize("case", ["walk", "gaps", "flat", "one"])
def test_equal_to_matrices(case):
    r = np.random.default_rng(44)
    v = np.cumsum(r.normal(0, 1, 120)) + r.normal(0, 2, 120)
    v = {"walk": v, "gaps": np.where(r.uniform(size=120) < 0.2, np.nan, v), "flat": np.full(40, 3.0), "one": v[:1]}[case]
    assert np.allclose(S._level_em(v, 20, 1e-6), by_matrices(v, 20, 1e-6), rtol=1e-7)


def test_many_values(spark):
    df = spark.range(200_000).selectExpr("id % 4 AS s", "id AS t", "sin(id / 900) * 5 + (hash(id) % 1000) / 500 AS x")
    began = time.time()
    assert S.state_space_em(df, "x", "t", ["s"], rounds=20).count() == 4
    S.state_space_em(df, "x", "t", ["s"], rounds=20).collect()
    assert time.time() - began < 60  # 4 million steps of a matrix filter, a smoother and their sums took longer
