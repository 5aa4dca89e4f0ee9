"""Replicates against resamples that are built, and their spread against theory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import bootstrap as B
from statloom.operators import resampling


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(24)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 0.7 * y[t - 1] + r.normal()
    y += 3
    rows = [(t, float(v)) for t, v in enumerate(y)] + [(1000, None)]
    return y, spark.createDataFrame(rows, "t int, y double").repartition(4).cache()


@pytest.mark.parametrize("kind", ["moving", "circular", "stationary"])
def test_blocks_equal_built_resamples(spark, monkeypatch, series, kind):
    monkeypatch.setattr(B, "BLOCK", 64)
    y, df = series
    got = {r["rep"]: (r["m"], r["q"]) for r in B.block_means(df, {"m": F.col("y"), "q": F.col("y") * F.col("y")}, ["t"], 17, 60, kind, seed=5).collect()}
    blocks = B.random_blocks(spark, 400, 17, 60, 5) if kind == "stationary" else B.fixed_blocks(spark, 400, 17, 60, 5, kind == "circular")
    built = {}
    for r in blocks.collect():
        assert kind != "moving" or r["start"] + r["length"] <= 400
        built.setdefault(r["rep"], []).append(np.arange(r["start"], r["start"] + r["length"]) % 400)
    assert len(got) == 60
    for rep, at in built.items():
        sample = y[np.concatenate(at)]
        assert len(sample) == 400 and np.allclose(got[rep], [sample.mean(), (sample**2).mean()])


def test_spread_of_blocks(series):
    y, df = series
    reps = B.block_means(df, {"m": F.col("y")}, ["t"], 25, 600, "circular")
    s = B.replicate_summary(reps, "m", y.mean()).first()
    z, n = y - y.mean(), len(y)
    long = sum((1 - abs(k) / 25) * (z[: n - abs(k)] @ z[abs(k) :]) / n for k in range(-24, 25)) / n  # what blocks of 25 see of the long-run variance
    assert abs(s["se"] / np.sqrt(long) - 1) < 0.15 and abs(s["bias"]) < 0.05 and s["low"] < y.mean() < s["high"]
    lengths = B.random_blocks(df.sparkSession, 4000, 20, 50).groupBy("rep").agg(F.sum("length").alias("n"), F.count(F.lit(1)).alias("k")).toPandas()
    assert (lengths["n"] == 4000).all() and abs(lengths["k"].mean() - 200) < 15


def test_block_edges(series):
    _, df = series
    assert B.block_means(df.where("t > 999"), {"m": F.col("y")}, ["t"]).collect() == []
    for bad in ({"kind": "none"}, {"size": 401}):
        with pytest.raises(ValueError):
            B.block_means(df, {"m": F.col("y")}, ["t"], **bad)


def test_wild(spark):
    r = np.random.default_rng(25)
    x = r.uniform(0, 10, 500)
    y = 1 + 2 * x + r.normal(0, 0.3 + x / 5)
    b = np.polyfit(x, y, 1)
    fit = np.polyval(b, x)
    df = spark.createDataFrame([(i, float(a), float(f), float(e)) for i, (a, f, e) in enumerate(zip(x, fit, y - fit))], "i int, x double, f double, e double").repartition(3)
    z = (F.col("x") - float(x.mean())) / float(((x - x.mean()) ** 2).sum())
    robust = np.sqrt((((x - x.mean()) * (y - fit)) ** 2).sum()) / ((x - x.mean()) ** 2).sum()
    for kind in ("rademacher", "mammen"):
        got = B.wild_functionals(df, "f", "e", {"slope": z, "mean": F.lit(1 / 500)}, "i", 1500, kind).toPandas()
        assert len(got) == 1500 and abs(got["slope"].mean() - b[0]) < 4 * robust / np.sqrt(1500) and abs(got["slope"].std() / robust - 1) < 0.08
        assert abs(got["mean"].mean() - y.mean()) < 0.02
    with pytest.raises(ValueError):
        B.wild_functionals(df, "f", "e", {"m": F.lit(1.0)}, "i", kind="none")


def test_corrected_interval(spark):
    x = np.random.default_rng(26).exponential(1, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").repartition(3)
    got = B.corrected_interval(df, "x", "i", 4000).first()
    r = np.random.default_rng(1)
    means = np.sort(x[r.integers(0, 300, (20_000, 300))].mean(1))
    from statloom.functions import special as S

    z0, d = S.normal_quantile((means < x.mean()).mean()), x - x.mean()
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    ends = [np.quantile(means, S.normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (-1.959964, 1.959964)]
    assert abs(got["estimate"] - x.mean()) < 1e-12 and np.allclose([got["low"], got["high"]], ends, atol=0.03) and got["high"] - got["estimate"] > got["estimate"] - got["low"]
    with pytest.raises(ValueError):
        B.corrected_interval(df.where("i = 0"), "x", "i")


def test_permutations_and_poisson(spark):
    r = np.random.default_rng(27)
    x = r.normal(0, 1, 240) + (np.arange(240) % 2) * 0.5
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(x)], "i int, x double, g string")
    got = resampling.permutation_test(df, "x", "g", "a", "b", "i", 2000).first()
    d = x[::2].mean() - x[1::2].mean()
    perm = np.array([(lambda p: p[:120].mean() - p[120:].mean())(r.permutation(x)) for _ in range(4000)])
    assert abs(got["statistic"] - d) < 1e-12 and abs(got["p_value"] - (np.abs(perm) >= abs(d)).mean()) < 0.01
    s = resampling.poisson_bootstrap(df, "x", "i", 1500).first()
    assert abs(s["se"] / (x.std() / np.sqrt(240)) - 1) < 0.1 and abs(s["estimate"] - x.mean()) < 1e-12
