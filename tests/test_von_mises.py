"""The circular distribution against sums of its density, and in time for many rows."""

import time

import numpy as np
import pytest

from statloom.functions import special as S


@pytest.mark.parametrize("kappa", [0.0, 0.3, 2.0, 40.0])
def test_cdf_is_the_summed_density(kappa):
    x = np.linspace(-np.pi, np.pi, 200_001)
    f = np.exp(kappa * (np.cos(x - 0.7) - 1))
    total = np.concatenate([[0], np.cumsum((f[1:] + f[:-1]) / 2)])
    assert np.allclose(S.von_mises_cdf(x[::500], 0.7, kappa), total[::500] / total[-1], atol=1e-9)


def test_many_rows_and_own_parameters():
    r = np.random.default_rng(43)
    p = r.uniform(0.001, 0.999, 20_000)
    began = time.thread_time()
    x = S.von_mises_quantile(p, np.full(len(p), 0.4), np.full(len(p), 2.0))
    assert time.thread_time() - began < 10  # over 100 s when each round made the Bessel ratios of every row again
    assert np.allclose(S.von_mises_cdf(x, 0.4, 2.0), p, atol=1e-12)
    mu, kappa = r.uniform(-3, 3, 50), r.uniform(0, 30, 50)
    assert np.allclose(S.von_mises_cdf(S.von_mises_quantile(p[:50], mu, kappa), mu, kappa), p[:50], atol=1e-12)
    assert np.isnan(S.von_mises_cdf(np.array([0.1, np.nan, 0.2]), 0.4, np.array([np.nan, 1.0, 1.0]))).tolist() == [True, True, False]
    assert len(S.von_mises_quantile(np.array([]), np.array([]), np.array([]))) == 0


def test_equal_arguments_once(spark):
    df = spark.range(300).selectExpr("id", "(id % 3 + 1) / 4 AS p", "id % 2 + 1.0D AS a").withColumn("q", S.column("gamma_quantile", "p", "a"))
    got = {(r["p"], r["a"]): r["q"] for r in df.collect()}
    assert len(got) == 6 and all(np.isclose(S.gamma_p(np.array([a]), np.array([q]))[0], p) for (p, a), q in got.items())
