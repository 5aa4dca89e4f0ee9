"""Powers by simulation and tables, intervals by numpy, points of plots by sorting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.functions.distributions import distribution
from statloom.operators import descriptive, effects, regression


def test_noncentral_tails():
    r = np.random.default_rng(17)
    z = r.normal(0, 1, (400_000, 4))
    z[:, 0] += np.sqrt(7.0)
    assert abs(special.noncentral_chi2_sf(10.0, 4.0, 7.0) - ((z**2).sum(1) > 10).mean()) < 3e-3
    d = (r.normal(0, 1, (400_000, 20)) ** 2).mean(1)
    assert abs(special.noncentral_f_sf(2.5, 4.0, 20.0, 7.0) - ((z**2).mean(1) / d > 2.5).mean()) < 3e-3
    assert np.allclose(special.noncentral_chi2_sf([3.0, 9.0], 4.0, 0.0), special.chi2_sf([3.0, 9.0], 4.0))
    assert np.allclose(special.noncentral_f_sf([1.0, 3.0], 3.0, 9.0, 0.0), special.f_sf([1.0, 3.0], 3.0, 9.0))
    assert abs(special.noncentral_chi2_sf(50_300.0, 4.0, 50_000.0) - 0.255) < 0.01  # beyond the mixture: nearly normal
    p = np.array([0.01, 0.5, 0.95, 0.999])
    assert np.allclose(special.f_cdf(special.f_quantile(p, 3.0, 17.0), 3.0, 17.0), p)
    assert abs(special.f_quantile(0.95, 3.0, 36.0) - 2.8663) < 1e-4


def test_powers(spark):
    row = spark.range(1).select(effects.anova_power(F.lit(0.25), 4, F.lit(45.0)).alias("a"), effects.chi_squared_power(F.lit(0.3), 1.0, F.lit(88.0)).alias("c")).first()
    assert abs(row["a"] - 0.804) < 2e-3 and abs(row["c"] - 0.803) < 2e-3  # published tables: 45 a group and 88 rows reach 0.8
    t = spark.createDataFrame([(0.25, 4.0), (0.4, 3.0), (0.1, 2.0), (0.0, 2.0)], "f double, k double")
    got = {(r["f"], r["k"]): r["n"] for r in effects.least_n(t, lambda n: effects.anova_power(F.col("f"), F.col("k"), n), doublings=14).collect()}
    assert got[0.25, 4.0] == 45 and got[0.4, 3.0] == 22 and got[0.1, 2.0] == 394 and got[0.0, 2.0] is None
    w = effects.least_n(spark.createDataFrame([(0.3,), (5.0,)], "w double"), lambda n: effects.chi_squared_power(F.col("w"), 1.0, n), doublings=12).orderBy("w").collect()
    assert [r["n"] for r in w] == [88, 2]


def test_observed_power(spark):
    r = np.random.default_rng(18)
    x = r.normal(0, 1, 300) + np.arange(300) % 3 * 0.3
    got = effects.observed_power(spark.createDataFrame([(float(a), i % 3) for i, a in enumerate(x)], "x double, g int"), "x", "g").first()
    g = [x[k::3] for k in range(3)]
    f = np.sqrt(sum(100 * (a.mean() - x.mean()) ** 2 for a in g) / sum(((a - a.mean()) ** 2).sum() for a in g))
    assert got["groups"] == 3 and abs(got["n"] - 100) < 1e-9 and abs(got["f"] - f) < 1e-9
    cut = special.f_quantile(0.95, 2.0, 297.0)
    assert abs(got["power"] - special.noncentral_f_sf(cut, 2.0, 297.0, 300 * f * f)) < 1e-9


def test_intervals(spark):
    r = np.random.default_rng(19)
    x = r.normal(5, 2, (60, 2))
    y = 1 + x @ [2, -1] + r.normal(0, 1, 60)
    df = spark.createDataFrame([(float(a), float(b), float(c), "g") for (a, b), c in zip(x, y)] + [(1.0, None, None, "h"), (1.0, 2.0, 3.0, "h"), (2.0, 2.0, 3.0, "h")], "a double, b double, y double, g string")

    def want(columns, confidence):
        d = np.column_stack([np.ones(60), x[:, columns]])
        b = np.linalg.lstsq(d, y, rcond=None)[0]
        s = ((y - d @ b) ** 2).sum() / (60 - d.shape[1])
        se = np.sqrt(s * np.diag(np.linalg.inv(d.T @ d)))
        half = special.t_quantile(0.5 + confidence / 2, 60 - d.shape[1]) * se
        return np.column_stack([b, se, b - half, b + half])

    got = regression.ordinary(df.where("g = 'g'"), ["a", "b"], "y").intervals(spark, 0.9).collect()
    assert np.allclose([[r["estimate"], r["se"], r["low"], r["high"]] for r in got], want([0, 1], 0.9))
    rows = regression.simple_intervals(df, "a", "y", 0.99, ["g"]).collect()
    mine = [[r["estimate"], r["se"], r["low"], r["high"]] for r in rows if r["g"] == "g"]
    assert np.allclose(mine, want([0], 0.99)) and all(r["p_value"] < 0.05 for r in rows if r["g"] == "g" and r["term"] == "a")
    assert {(r["se"], r["low"]) for r in rows if r["g"] == "h"} == {(None, None)}


@pytest.mark.parametrize("kind", ["normal", "exponential"])
def test_quantile_points(spark, kind):
    r = np.random.default_rng(20)
    x = r.exponential(2, 501)
    df = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "x double").repartition(5)
    d = distribution("normal", 0.0, 1.0) if kind == "normal" else distribution("exponential", 0.5)
    got = descriptive.quantile_points(df, "x", d.quantile).orderBy("i").toPandas()
    p = (np.arange(501) + 0.6825) / 501.365
    assert np.allclose(got["sample"], np.sort(x)) and np.allclose(got["theoretical"], special.normal_quantile(p) if kind == "normal" else -np.log(1 - p) / 0.5)


def test_pairs_of(spark):
    got = descriptive.pairs_of(spark.createDataFrame([(1.0, 2.0, None)], "a double, b double, c double"), ["a", "b", "c"]).collect()
    assert {(r["x_name"], r["y_name"], r["x"], r["y"]) for r in got} == {("a", "b", 1.0, 2.0), ("b", "a", 2.0, 1.0), ("a", "c", 1.0, None), ("c", "a", None, 1.0), ("b", "c", 2.0, None), ("c", "b", None, 2.0)}
