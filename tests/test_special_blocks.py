"""Special functions over long arrays: the same values whatever the blocks, and to the last digits."""

import math

import numpy as np

from statloom.functions import special as S


def test_error_functions_to_the_last_digits():
    x = np.concatenate([np.random.default_rng(32).normal(0, 2.5, 20_000), [0.0, 6.0, 6.1, 12.0, 26.0, -27.0, 1e-300, 3.0]])
    want = np.array([math.erf(v) for v in x])
    assert np.allclose(S.erf(x), want, rtol=1e-14, atol=0)
    want = np.array([math.erfc(v) for v in x])
    assert np.allclose(S.erfc(x), want, rtol=3e-13, atol=0)
    with np.errstate(all="raise"):
        assert np.isnan(S.erf(np.array([np.nan, 1.0]))[0]) and S.erf(np.array([np.inf, -np.inf])).tolist() == [1.0, -1.0] and S.erfc(np.array([np.inf, -np.inf])).tolist() == [0.0, 2.0]
    assert math.copysign(1, S.erf(-0.0)) == -1 and np.isnan(S.erfc(np.nan))


def test_blocks_make_no_difference(monkeypatch):
    r = np.random.default_rng(33)
    a, b, u = np.exp(r.uniform(-3, 5, (90, 100))), np.exp(r.uniform(-3, 4, (90, 100))), r.random((90, 100))
    calls = {"gamma_ln": (a,), "gamma": (r.uniform(-20, 30, (90, 100)),), "gamma_p": (a, b), "beta_i": (u, a, b), "erf": (a - 2,), "erfc": (a - 2,)}
    parts = {n: getattr(S, n)(*x) for n, x in calls.items()}
    monkeypatch.setattr(S, "_BLOCK", 10**9)
    for n, x in calls.items():
        whole = getattr(S, n)(*x)
        assert whole.shape == (90, 100) and np.allclose(parts[n], whole, rtol=1e-13, atol=1e-300)
    monkeypatch.setattr(S, "_BLOCK", 7)
    assert np.allclose(S.gamma_p(a[0][:, None], b[0][:5]), [[float(S.gamma_p(p, q)) for q in b[0][:5]] for p in a[0]])
    assert np.allclose(S.beta_i(u[0][:20], 2.0, b[0][:20]), [float(S.beta_i(p, 2.0, q)) for p, q in zip(u[0][:20], b[0][:20])])


def test_incomplete_functions_at_known_values():
    x = np.linspace(0.01, 40, 5000)
    assert np.allclose(S.gamma_p(1.0, x), -np.expm1(-x), rtol=1e-13)
    assert np.allclose(S.gamma_p(0.5, x), [math.erf(math.sqrt(v)) for v in x], rtol=1e-13)
    u = np.linspace(0.001, 0.999, 5000)
    assert np.allclose(S.beta_i(u, 1.0, 3.0), 1 - (1 - u) ** 3, rtol=1e-12) and np.allclose(S.beta_i(u, 0.5, 0.5), 2 / np.pi * np.arcsin(np.sqrt(u)), rtol=1e-12)
    assert np.isnan(S.gamma_p([0.0, -1.0, np.nan, 2.0], [1.0, 1.0, 1.0, np.nan])).all() and S.gamma_p([1.0, 1.0], [0.0, np.inf]).tolist() == [0.0, 1.0]
