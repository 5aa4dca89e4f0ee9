"""Distributions against numeric integrals, sums and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.distributions import FAMILIES, distribution

CONTINUOUS = {
    "beta": (2.0, 3.0), "cauchy": (1.0, 2.0), "chi_squared": (4.0,), "exponential": (0.7,), "f": (5.0, 9.0), "frechet": (3.5, 2.0, 1.0), "gamma": (2.5, 1.5), "gev": (1.0, 2.0, 0.2), "gpd": (1.0, 2.0, -0.3),
    "gumbel": (0.5, 2.0), "inverse_gamma": (4.0, 3.0), "laplace": (1.0, 2.0), "levy": (0.5, 1.0), "log_logistic": (2.0, 5.0), "log_normal": (0.2, 0.5), "normal": (1.0, 2.0), "pareto": (4.0, 1.5), "rayleigh": (2.0,),
    "student_t": (5.0,), "truncated_normal": (1.0, 2.0, 0.0, 4.0), "uniform": (1.0, 4.0), "von_mises": (0.4, 2.0), "weibull": (1.7, 2.0),
}
DISCRETE = {"bernoulli": (0.3,), "binomial": (12.0, 0.35), "discrete_uniform": (2.0, 9.0), "geometric": (0.3,), "hypergeometric": (40.0, 15.0, 12.0), "negative_binomial": (4.0, 0.45), "poisson": (3.7,), "zero_inflated_poisson": (4.0, 0.3)}


def test_all_families_are_tested():
    assert set(FAMILIES) == {*CONTINUOUS, *DISCRETE}


def test_continuous(spark):
    p = np.linspace(0.001, 0.999, 1200)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "i int, p double").coalesce(1)
    d = {k: distribution(k, *v) for k, v in CONTINUOUS.items()}
    x = df.select("i", "p", *[d[k].quantile("p").alias(k) for k in d])
    rows = x.select("i", "p", *d, *[d[k].cdf(k).alias(f"{k}_c") for k in d], *[d[k].pdf(k).alias(f"{k}_d") for k in d]).toPandas().sort_values("i")
    for k in d:
        assert np.abs(rows[f"{k}_c"] - p).max() < 1e-9, k
        got, dens = rows[k].to_numpy(), rows[f"{k}_d"].to_numpy()
        inside = slice(60, -60)
        area = np.cumsum(np.diff(got) * (dens[1:] + dens[:-1]) / 2)
        assert np.abs(area - (p[1:] - p[0]))[inside].max() < 2e-3, k
    wide = spark.range(1).select(*[d[k].mean().alias(f"{k}_m") for k in d], *[d[k].variance().alias(f"{k}_v") for k in d]).first()
    u = (np.arange(200_000) + 0.5) / 200_000
    many = spark.createDataFrame([(float(v),) for v in u[::40]], "p double").coalesce(1).select(*[d[k].quantile("p").alias(k) for k in d]).toPandas()
    for k in d:
        if k in ("cauchy", "levy"):
            assert not math.isfinite(wide[f"{k}_m"])
        elif k != "von_mises":
            assert many[k].mean() == pytest.approx(wide[f"{k}_m"], rel=0.02, abs=0.02), k
            assert many[k].var() == pytest.approx(wide[f"{k}_v"], rel=0.2), k


def test_discrete(spark):
    d = {k: distribution(k, *v) for k, v in DISCRETE.items()}
    n = 120
    df = spark.range(n).select(F.col("id").cast("double").alias("x")).coalesce(1)
    rows = df.select("x", *[d[k].pdf("x").alias(k) for k in d], *[d[k].cdf("x").alias(f"{k}_c") for k in d]).toPandas().sort_values("x")
    wide = spark.range(1).select(*[d[k].mean().alias(f"{k}_m") for k in d], *[d[k].variance().alias(f"{k}_v") for k in d]).first()
    q = spark.createDataFrame([(float(v),) for v in np.linspace(0.005, 0.995, 200)], "p double").coalesce(1).select("p", *[d[k].quantile("p").alias(k) for k in d]).toPandas()
    for k in d:
        pmf, x = rows[k].to_numpy(), rows["x"].to_numpy()
        assert pmf.sum() == pytest.approx(1, abs=1e-9), k
        assert np.abs(rows[f"{k}_c"].to_numpy() - np.cumsum(pmf)).max() < 1e-9, k
        assert (pmf * x).sum() == pytest.approx(wide[f"{k}_m"]), k
        assert (pmf * x * x).sum() - (pmf * x).sum() ** 2 == pytest.approx(wide[f"{k}_v"]), k
        want = [int(np.argmax(np.cumsum(pmf) >= p - 1e-12)) for p in q["p"]]
        assert q[k].tolist() == want, k


def test_parameters_from_columns_and_samples(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.5), (3.0, 1.0, None)], "k double, s double, x double")
    got = [r[0] for r in df.select(distribution("weibull", "k", "s").cdf("x")).collect()]
    assert got[0] == pytest.approx(1 - math.exp(-0.25)) and got[1] is None
    a = distribution("normal", 3.0, 2.0).sample(spark, 4000, seed=1)
    assert a.collect() == a.repartition(3).orderBy("id").collect()
    m, s = a.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(m - 3) < 0.15 and abs(s - 2) < 0.1
    with pytest.raises(ValueError):
        distribution("normal", 1.0)
