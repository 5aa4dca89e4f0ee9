"""Values far from the origin, missing and infinite values, and many dimensions."""

import numpy as np
import pytest

from statloom.operators import multivariate, sensitivity, series, statespace
from statloom.operators.descriptive import trimmed_mean
from statloom.plans.order import values_at


@pytest.mark.parametrize("rows", [2000, 40])
def test_distances_far_from_the_origin(spark, rows):
    r = np.random.default_rng(1)
    x = 1e8 + 0.2 * r.random((400, 3))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id int, x array<double>, g int")
    got = multivariate.distance_matrix(df, "id", "x", rows=rows).toPandas()
    want = np.sqrt(((x[got["i"]] - x[got["j"]]) ** 2).sum(1))
    assert len(got) == 400 * 399 // 2 and np.abs(got["d"] - want).max() < 1e-12
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    got = multivariate.silhouettes(df, "id", "x", "g", rows=rows).toPandas().set_index("id")["silhouette"]
    g = np.arange(400) % 3
    for i in (0, 7, 200):
        a = d[i, (g == g[i]) & (np.arange(400) != i)].mean()
        b = min(d[i, g == k].mean() for k in range(3) if k != g[i])
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9


def segments(spark, f, v, **options):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(v)], "t int, x double")
    return [r["segment"] for r in f(df, "x", "t", [], **options).orderBy("t").collect()]


@pytest.mark.parametrize("f", [statespace.binary_segmentation, series.mean_changepoints])
def test_changepoints_with_missing_values(spark, f):
    r = np.random.default_rng(2)
    v = [*r.normal(0, 1, 40), *r.normal(10, 1, 40)]
    v[3] = v[40] = v[79] = None
    got = segments(spark, f, v)
    assert got == [0] * 41 + [1] * 39  # a missing value joins the one before it
    assert segments(spark, f, [None, None, *v])[:3] == [0, 0, 0]
    assert segments(spark, f, [None] * 4) == [0] * 4
    assert segments(spark, f, [1.0, 2.0]) == [0, 0]


def test_costs_of_changepoints(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(5, 1, 80), r.normal(5, 9, 80)])  # the spread changes, not the mean
    for f in (statespace.binary_segmentation, series.mean_changepoints):
        for cost in ("variance", "mean_variance"):
            got = np.array(segments(spark, f, v, cost=cost, penalty=25.0))
            assert got.max() == 1 and abs(int(np.argmax(got > 0)) - 80) <= 4
        assert max(segments(spark, f, v, penalty=1e9)) == 0
    with pytest.raises(ValueError):
        series.segment_cost(v, "none")
    price = series.segment_cost(v, "mean_variance")
    assert abs(price(10, 50) - 40 * (np.log(2 * np.pi * np.var(v[10:50])) + 1)) < 1e-8


def test_optimal_partition_equals_all_partitions(spark):
    from itertools import combinations

    r = np.random.default_rng(4)
    for kind in ("error", "mean", "variance", "mean_variance"):
        v = np.round(r.normal(0, 1, 11) + (np.arange(11) > 6) * 3, 2)
        price = series.segment_cost(v, kind)
        options = []
        for k in range(5):
            for cuts in combinations(range(2, 10), k):
                ends = [0, *cuts, 11]
                if min(np.diff(ends)) >= 2:
                    options.append((sum(float(price(a, b)) for a, b in zip(ends, ends[1:])) + 2.0 * k, cuts))
        cuts = min(options)[1]
        want = np.searchsorted(cuts, np.arange(11), side="right").tolist()
        assert segments(spark, series.mean_changepoints, v, cost=kind, penalty=2.0) == want


def test_values_at_infinities_and_neighbours(spark):
    r = np.random.default_rng(5)
    v = np.append(r.random(20_000), [np.inf, np.inf, -np.inf])
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    ranks = [0, 1, 9_000, 20_000, 20_001, 20_002]
    assert values_at(df, "x", ranks) == np.sort(v)[ranks].tolist()
    close = [1.0 + k * 2**-52 for k in range(6000)] + [1.0] * 100
    assert values_at(spark.createDataFrame([(x,) for x in close], "x double"), "x", [50, 3000]) == np.sort(close)[[50, 3000]].tolist()
    wide = [*(r.random(9000) * 1.7e308), *(-r.random(9000) * 1.7e308)]
    assert values_at(spark.createDataFrame([(float(x),) for x in wide], "x double"), "x", [0, 8999, 17_999]) == np.sort(wide)[[0, 8999, 17_999]].tolist()
    got = trimmed_mean(df, "x", proportion=0.1).first()[0]
    s = np.sort(v)
    assert abs(got - s[2000 : 20_003 - 2000].mean()) < 1e-9


def test_halton_in_many_dimensions(spark):
    got = sensitivity.halton(spark, 20, 50)
    assert got.columns == ["i", *[f"x{k}" for k in range(1, 21)]]
    assert abs(got.where("i = 3").first()["x20"] - 3 / 71) < 1e-15
