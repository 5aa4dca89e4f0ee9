"""State space, ARIMA, volatility, smoothing, changepoints, mixed and additive models, vector autoregressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arma as A
from ..operators import mixed as X
from ..operators import regression as R
from ..operators import statespace as S
from ..registry import register, table


def _events(spark, sf):
    return table(spark, sf, "events")


@register("kalman_level", "WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), k(user_id, i, event_id, m, p) AS (SELECT user_id, 0, NULL::BIGINT, 0.0::DOUBLE, 1e7::DOUBLE FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, m + (p + 1) / (p + 101) * (value - m), (1 - (p + 1) / (p + 101)) * (p + 1) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1) SELECT event_id, m AS level, p AS variance FROM k WHERE i > 0", rounded=("level", "variance"), digits=5)
def _kalman(spark, sf):
    t = table(spark, sf, "events")
    return S.kalman(t, "value", "event_id", ["user_id"], [[1.0]], [1.0], [[1.0]], 100.0).select(F.col("t").alias("event_id"), F.col("state")[0].alias("level"), F.col("variance")[0].alias("variance"))


@register("kalman_smoother")
def _smoother(spark, sf):
    return S.kalman(_events(spark, sf), "value", "event_id", ["user_id"], [[1.0, 1.0], [0.0, 1.0]], [1.0, 0.0], [[1.0, 0.0], [0.0, 0.1]], 100.0, smooth=True).select("user_id", "t", F.col("state")[0].alias("level"))


@register(
    "kalman_predict",
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), k(user_id, i, m, p) AS (SELECT user_id, 0, 0.0::DOUBLE, 1e7::DOUBLE FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, m + (p + 1) / (p + 101) * (value - m), (1 - (p + 1) / (p + 101)) * (p + 1) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1), z AS (SELECT user_id, arg_max(m, i) AS m, arg_max(p, i) AS p, unnest(range(1, 6)) AS h FROM k GROUP BY user_id)
    SELECT user_id, h::INT AS step, m AS mean, m - 1.96 * sqrt(p + h + 100) AS low, m + 1.96 * sqrt(p + h + 100) AS high FROM z""",
    rounded=("mean", "low", "high"), digits=5,
)
def _predict(spark, sf):
    return S.kalman_predict(_events(spark, sf), "value", "event_id", ["user_id"], [[1.0]], [1.0], [[1.0]], 100.0, 5)


@register("state_space_em")
def _em(spark, sf):
    return S.state_space_em(_events(spark, sf), "value", "event_id", ["user_id"], rounds=20)


@register("arima")
def _arima(spark, sf):
    return S.arima(_events(spark, sf), "value", "event_id", ["user_id"], 1, 0, 1)


_LAG = "WITH s AS (SELECT user_id, event_id, value AS y, lag(value, {k}) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events), f AS (SELECT user_id, regr_slope(y, l) AS a, regr_intercept(y, l) AS b, regr_syy(y, l) * (1 - regr_r2(y, l)) AS sse, count(l) AS n FROM s GROUP BY user_id)"


@register("arima_lags", f"{_LAG.format(k=1)} SELECT user_id, a AS lag, b / (1 - a) AS mean, sse / n AS variance, n * ln(sse / n) + 4 AS aic FROM f", rounded=("lag", "mean", "variance", "aic"), digits=4)
def _arima_lags(spark, sf):
    """One lag, whose conditional likelihood is a regression."""
    return S.arima(_events(spark, sf), "value", "event_id", ["user_id"], 1, 0, 0).select("user_id", F.col("ar")[0].alias("lag"), "mean", "variance", "aic")


@register("sarima_lags", f"{_LAG.format(k=7)} SELECT user_id, a AS lag, b / (1 - a) AS mean, sse / n AS variance, n * ln(sse / n) + 4 AS aic FROM f", rounded=("lag", "mean", "variance", "aic"), digits=4)
def _sarima_lags(spark, sf):
    """One seasonal lag of period 7."""
    return A.sarima(_events(spark, sf), "value", "event_id", ["user_id"], A.Orders(0, 0, 0, 1, 0, 0, 7)).select("user_id", F.col("seasonal_ar")[0].alias("lag"), "mean", "variance", "aic")


_WEEKS = "WITH s AS (SELECT user_id, event_id, value - lag(value, 7) OVER (PARTITION BY user_id ORDER BY event_id) AS w, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events), m AS (SELECT user_id, avg(w) AS c, var_pop(w) AS s2 FROM s WHERE w IS NOT NULL GROUP BY user_id)"


@register(
    "sarima_forecast",
    f"{_WEEKS} SELECT user_id, (8 - back)::INT AS step, y + c AS mean, y + c - 1.959963984540054 * sqrt(s2) AS low, y + c + 1.959963984540054 * sqrt(s2) AS high FROM s JOIN m USING (user_id) WHERE back <= 7",
    rounded=("mean", "low", "high"), digits=9,
)
def _sarima_forecast(spark, sf):
    """The next week from the last one and the mean change from week to week."""
    return A.sarima_forecast(_events(spark, sf), "value", "event_id", ["user_id"], A.Orders(0, 0, 0, 0, 1, 0, 7), 7)


@register(
    "broken_trend",
    """WITH e AS (SELECT CAST(event_id AS DOUBLE) AS t, greatest(event_id - 400.0, 0) AS u, value AS y FROM events), c AS (SELECT covar_pop(t, t) AS tt, covar_pop(u, u) AS uu, covar_pop(t, u) AS tu, covar_pop(t, y) AS ty, covar_pop(u, y) AS uy, avg(t) AS mt, avg(u) AS mu, avg(y) AS my FROM e),
    b AS (SELECT *, (ty * uu - uy * tu) / (tt * uu - tu * tu) AS s, (uy * tt - ty * tu) / (tt * uu - tu * tu) AS d FROM c)
    SELECT event_id, my - s * mt - d * mu + s * event_id + d * greatest(event_id - 400.0, 0) AS trend, value - (my - s * mt - d * mu + s * event_id + d * greatest(event_id - 400.0, 0)) AS residual FROM events, b""",
    rounded=("trend", "residual"), digits=5,
)
def _trend(spark, sf):
    """A trend that may break at event 400, without a charge for it."""
    t = table(spark, sf, "events")
    return A.broken_trend(t, "value", "event_id", [400.0], penalty=0.0).apply(t, "event_id", "value").select("event_id", "trend", "residual")


@register(
    "seasonal_trend",
    "SELECT event_id, 40 + 0.01 * event_id + 0.02 * greatest(event_id - 300.0, 0) - 0.05 * greatest(event_id - 700.0, 0) AS trend, 2 * cos(2 * pi() * event_id / 7) - sin(4 * pi() * event_id / 30.5) AS seasonal FROM events",
    rounded=("trend", "seasonal"), digits=7,
)
def _season(spark, sf):
    """The parts of a given model, as columns."""
    model = A.BrokenTrend(40.0, 0.01, (300.0, 700.0), (0.02, -0.05), ((7.0, 1, 2.0, 0.0), (30.5, 2, 0.0, -1.0)))
    return model.apply(table(spark, sf, "events"), "event_id").select("event_id", "trend", "seasonal")


@register(
    "arima_forecast",
    """WITH s AS (SELECT user_id, event_id, value AS y, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM events), l AS (SELECT *, lag(w) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s),
    f AS (SELECT user_id, regr_slope(w, b) AS a, regr_intercept(w, b) / (1 - regr_slope(w, b)) AS c, regr_syy(w, b) * (1 - regr_r2(w, b)) / count(b) AS s2, arg_max(y, event_id) AS y, arg_max(w, event_id) AS w FROM l GROUP BY user_id),
    h AS (SELECT *, unnest(range(1, 6)) AS h FROM f), m AS (SELECT user_id, h::INT AS step, y + h * c + (w - c) * a * (1 - a ** h) / (1 - a) AS mean, 1.959963984540054 * sqrt(s2 * list_sum(list_transform(range(h), lambda j: ((1 - a ** (j + 1)) / (1 - a)) ** 2))) AS half FROM h)
    SELECT user_id, step, mean, mean - half AS low, mean + half AS high FROM m""",
    rounded=("mean", "low", "high"), digits=3,
)
def _forecast(spark, sf):
    return S.arima_forecast(_events(spark, sf), "value", "event_id", ["user_id"], 1, 1, 0, 5)


@register("auto_arima")
def _auto(spark, sf):
    return S.auto_arima(_events(spark, sf), "value", "event_id", ["user_id"], 2, 1, 1)


@register("loess")
def _loess(spark, sf):
    return S.loess(_events(spark, sf).withColumn("x", F.col("event_id").cast("double")), "x", "value", ["user_id"])


@register("cubic_spline", "WITH t AS (SELECT p_partkey, p_size / 10.0 AS x FROM part) SELECT p_partkey, CASE WHEN x < 2 THEN 1 + x * 1.5 - x ** 3 / 8 * 1.0 ELSE 3 - 1.5 * (x - 2) * 0 - 0.75 * (x - 2) ** 2 + (x - 2) ** 3 / 8 END AS y FROM t", rounded=("y",), digits=9)
def _spline(spark, sf):
    """Knots (0, 1), (2, 3), (4, 1): by symmetry its slope is 0 in the middle."""
    return table(spark, sf, "part").select("p_partkey", S.cubic_spline([(0.0, 1.0), (2.0, 3.0), (4.0, 1.0)], F.col("p_size") / 10).alias("y"))


@register("segment_costs", "SELECT user_id, count(*) * ln(greatest(var_pop(value), 1e-12)) AS mean, count(*) * ln(greatest(avg((value - 50) ** 2), 1e-12)) AS variance, count(*) * (ln(greatest(var_pop(value), 1e-12)) + 1 + ln(2 * pi())) AS mean_variance FROM events GROUP BY user_id", rounded=("mean", "variance", "mean_variance"), digits=6)
def _costs(spark, sf):
    return S.segment_costs(table(spark, sf, "events"), "value", ["user_id"], 50.0)


@register("binary_segmentation")
def _binary(spark, sf):
    return S.binary_segmentation(_events(spark, sf), "value", "event_id", ["user_id"])


@register("online_changepoints")
def _online(spark, sf):
    return S.online_changepoints(_events(spark, sf), "value", "event_id", ["user_id"])


@register("garch")
def _garch(spark, sf):
    return S.garch(_events(spark, sf), "value", "event_id", ["user_id"])


@register("garch_forecast")
def _garch_forecast(spark, sf):
    return S.garch_forecast(_events(spark, sf), "value", "event_id", ["user_id"], 4, "gjr")


@register("arch_test", "WITH s AS (SELECT value ** 2 AS q, lag(value ** 2) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events) SELECT count(*) * regr_r2(q, l) AS statistic, 1.0::DOUBLE AS df FROM s WHERE l IS NOT NULL", rounded=("statistic",), digits=5)
def _arch(spark, sf):
    return S.arch_test(table(spark, sf, "events"), "value", "event_id", ["user_id"], 1).drop("p_value")


@register("mixed_intercepts")
def _mixed(spark, sf):
    model, _ = X.mixed_model(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", "l_suppkey", rounds=60)
    return model.table(spark, large=True)


@register("mixed_slopes")
def _slopes(spark, sf):
    model, groups = X.mixed_model(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", "l_suppkey", slope="l_quantity", rounds=30)
    return groups


@register("additive_model")
def _additive(spark, sf):
    model = X.additive_model(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return model.partial_dependence(spark, "l_quantity", 25)


@register("consensus_regression")
def _consensus(spark, sf):
    model, _ = X.consensus_regression(table(spark, sf, "part"), ["p_size"], "p_retailprice", "p_partkey")
    return model.table(spark)


@register("tweedie_regression")
def _tweedie(spark, sf):
    return R.glm(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_quantity", R.tweedie(1.5)).table(spark, large=True)


@register(
    "leave_one_out",
    """WITH r AS (SELECT c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS x FROM customer), m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n FROM r),
    e AS (SELECT (y - a - b * x) / (1 - 1 / n - (x - mx) ** 2 / sxx) AS e FROM r, m) SELECT avg(e * e) AS mse, avg(abs(e)) AS mae FROM e""",
    rounded=("mse", "mae"), digits=3,
)
def _loo(spark, sf):
    return X.leave_one_out(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal")


@register(
    "vector_autoregression",
    """WITH s AS (SELECT value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS a, lag(CAST(hour(ts) AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), c AS (SELECT covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb FROM s WHERE a IS NOT NULL)
    SELECT (ya * bb - yb * ab) / (aa * bb - ab * ab) AS own, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS other FROM c""",
    rounded=("own", "other"), digits=6,
)
def _var(spark, sf):
    m = X.vector_autoregression(table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double")), ["value", "hour"], "event_id", ["user_id"], 1)
    return spark.createDataFrame([(float(m.lags[0, 0, 0]), float(m.lags[0, 0, 1]))], "own double, other double")


@register("johansen")
def _johansen(spark, sf):
    values, trace = X.johansen(table(spark, sf, "events").withColumn("hour", F.hour("ts").cast("double")), ["value", "hour"], "event_id", ["user_id"])
    return spark.createDataFrame([(k, float(v), float(t)) for k, (v, t) in enumerate(zip(values, trace, strict=True))], "rank int, eigenvalue double, trace double")
