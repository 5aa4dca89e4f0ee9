"""Operators against known values and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import streaming
from statloom.functions import special
from statloom.operators import association, categorical, causal, effects, graph, hypothesis, multiple, multivariate, regression, resampling, series, survival


def _xy(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_special_functions():
    assert special.t_two_sided(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-8)
    assert special.chi2_sf(3.841458820694124, 1.0) == pytest.approx(0.05, abs=1e-10)
    assert special.f_sf(4.0, 2.0, 10.0) == pytest.approx((10 / 18) ** 5)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)


def test_t_test_p_value(spark):
    df = _xy(spark, [(float(v),) for v in (4.8, 5.1, 5.0, 4.9, 5.2, 5.0, 4.8, 5.1)], "x double")
    r = hypothesis.one_sample_t(df, "x", 5.0).first()
    x = np.array([4.8, 5.1, 5.0, 4.9, 5.2, 5.0, 4.8, 5.1])
    assert r["statistic"] == pytest.approx((x.mean() - 5) / (x.std(ddof=1) / np.sqrt(8)))
    assert 0.81 < r["p_value"] < 0.82
    assert hypothesis.one_sample_t(df.limit(0), "x").first()["statistic"] is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kendall_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, 300).astype(float), rng.integers(0, 200, 300).astype(float)
    r = association.kendall(_xy(spark, list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double"), "x", "y", buckets=8).first()
    i, j = np.triu_indices(300, 1)
    dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    assert r["tau"] == pytest.approx((dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum()))


def test_adjusted_p_values(spark):
    df = _xy(spark, [(i, p) for i, p in enumerate((0.01, 0.04, 0.03, None, 0.005))], "i int, p double")
    got = {r["i"]: r["adjusted"] for r in multiple.adjust(df, "p", "holm").collect()}
    assert got == {0: pytest.approx(0.03), 1: pytest.approx(0.06), 2: pytest.approx(0.06), 3: None, 4: pytest.approx(0.02)}


def test_fisher(spark):
    t = _xy(spark, [(3, 1, 1, 3)], "a long, b long, c long, d long")
    assert categorical.fisher_exact(t).first()["p_value"] == pytest.approx(0.4857142857, abs=1e-9)


def test_regression_recovers_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = 1 + 2 * x[:, 0] - 3 * x[:, 1] + rng.normal(size=400)
    t = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x[:, 0])))).astype(float)
    df = _xy(spark, [tuple(map(float, (*a, b, c))) for a, b, c in zip(x, y, t, strict=True)], "a double, b double, y double, t double")
    model = regression.ordinary(df, ["a", "b"], "y")
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert model.coefficients == pytest.approx(want)
    assert regression.elastic_net(df, ["a", "b"], "y", 0.0).coefficients == pytest.approx(want, abs=1e-5)
    logit = regression.logistic(df, ["a", "b"], "t").coefficients
    z = np.column_stack([np.ones(400), x])
    assert z.T @ (1 / (1 + np.exp(-z @ logit)) - t) == pytest.approx(np.zeros(3), abs=1e-4)
    assert [r["term"] for r in regression.stepwise(df, ["a", "b"], "y").table(spark).collect()] == ["(intercept)", "a", "b"]
    assert regression.huber_regression(df, ["a", "b"], "y").coefficients == pytest.approx([1, 2, -3], abs=0.2)


def test_kaplan_meier(spark):
    df = _xy(spark, [(float(t), True) for t in range(1, 6)], "t double, e boolean")
    got = [r["survival"] for r in survival.kaplan_meier(df, "t", "e").orderBy("time").collect()]
    assert got == pytest.approx([0.8, 0.6, 0.4, 0.2, 0.0])


def test_matching_takes_the_nearest_control(spark):
    rng = np.random.default_rng(5)
    e, t = rng.random(300).round(3), (rng.random(300) < 0.3).astype(float)
    df = _xy(spark, [(i, float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(t, e, strict=True))], "id long, y double, t double, e double")
    got = {r["id"]: r["gap"] for r in causal.nearest_score_matching(df, "y", "t", "e", "id", buckets=32).collect()}
    assert got == {int(i): pytest.approx(np.abs(e[t == 0] - e[i]).min(), abs=1e-12) for i in np.flatnonzero(t == 1)}


def test_sample_size(spark):
    r = effects.sample_size(spark, lambda n: effects.two_sample_power(F.lit(0.5), n), 0.8, 1000).first()
    assert r["n"] == 63


def test_components_and_clusters(spark):
    pts = [(i, [float(i % 3 * 10 + d), float(i % 3 * -5 + d)]) for i in range(30) for d in (0.1,)]
    df = _xy(spark, pts, "id long, x array<double>")
    rows, names = multivariate.unpack(df, "x", 2)
    assert multivariate.principal_components(rows, names).explained[0] == pytest.approx(1.0)
    centres, inertia, _ = multivariate.k_means(df, "x", 3)
    assert len(centres) == 3 and inertia == pytest.approx(0, abs=1e-9)
    labelled = multivariate.assign(df, "x", centres)
    assert multivariate.centroid_silhouette(labelled, "x", "cluster").first()[0] == pytest.approx(1.0)


def test_page_rank_and_distances(spark):
    e = _xy(spark, [(0, 1), (1, 2), (2, 3), (3, 3), (None, 1)], "src long, dst long")
    r = {x["id"]: x["rank"] for x in graph.page_rank(e, directed=False).collect()}
    assert sum(r.values()) == pytest.approx(1) and r[0] == pytest.approx(r[3])
    d = graph.distances_from(e, _xy(spark, [(0,)], "id long"))
    assert {x["id"]: x["hops"] for x in d.collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_changepoint(spark):
    df = _xy(spark, [("s", i, (0.0 if i < 50 else 10.0) + 0.3 * float(np.sin(0.73 * i))) for i in range(100)], "s string, t long, x double")
    got = series.mean_changepoints(df, "x", "t", ["s"]).where("segment = 1").agg(F.min("t")).first()[0]
    assert got == 50


def test_stratified_sample_is_exact(spark):
    df = spark.range(1000).withColumn("h", (F.col("id") % 3).cast("string"))
    got = {r["h"]: r["count"] for r in resampling.stratified_sample(df, "h", "id", 0.2).groupBy("h").count().collect()}
    assert got == {"0": 67, "1": 67, "2": 67}


def test_streams(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:{m:02d}:{s:02d}", (0.0 if m < 5 else 9.0) + (s % 7) / 10) for m in range(10) for s in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "k string, at string, x double").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(plan, name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = plan(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    changes = run(lambda s: streaming.stream_changes(s, "x", "ts", "k"), "changes")
    assert changes and changes[0]["direction"] == "up" and changes[0]["ts"].minute == 5
    windows = run(lambda s: streaming.stream_window_stats(s, "x", "ts", ["k"], "1 minute", late="0 seconds"), "windows")
    assert windows and all(r["n"] == 12 for r in windows)
