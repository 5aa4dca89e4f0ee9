"""Users' events as curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import functional as C
from ..registry import register, table

_LINE = C.Basis("polynomial", 2, 0.0, 24.0)
_FITS = "e AS (SELECT user_id, (hour(ts) + minute(ts) / 60.0) / 24 AS u, value AS y FROM events), f AS (SELECT user_id, count(*) AS n, regr_intercept(y, u) AS a, regr_slope(y, u) AS b FROM e GROUP BY 1)"


def _lines(spark, sf):
    t = table(spark, sf, "events").withColumn("hour", F.hour("ts") + F.minute("ts") / 60)
    return C.smooth_curves(t, ["user_id"], "hour", "value", _LINE)


@register("smooth_curves", f"WITH {_FITS} SELECT user_id, n, a, b FROM f", rounded=("a", "b"), digits=5)
def _smooth(spark, sf):
    """A straight line over the day for each user."""
    return _lines(spark, sf).select("user_id", "n", F.col("coefficients")[0].alias("a"), F.col("coefficients")[1].alias("b"))


@register("curve_norms", f"WITH {_FITS} SELECT user_id, sqrt(24 * (a * a + a * b + b * b * 0.33335)) AS norm FROM f", rounded=("norm",), digits=4)
def _norms(spark, sf):
    """Lengths of the lines; the trapezoidal rule with 100 steps takes a square's integral as 0.33335."""
    w = _LINE.metric(spark)
    return _lines(spark, sf).select("user_id", C.norm("coefficients", w).alias("norm"))


@register(
    "curve_components",
    f"""WITH {_FITS}, s AS (SELECT var_samp(a) AS v, var_samp(b) AS w, covar_samp(a, b) AS c FROM f), t AS (SELECT (v + w) / 2 AS m, sqrt(((v - w) / 2) ** 2 + c * c) AS d FROM s)
    SELECT unnest([1, 2]) AS component, unnest([m + d, m - d]) AS eigenvalue, unnest([(m + d) / (2 * m), (m - d) / (2 * m)]) AS explained FROM t""",
    rounded=("eigenvalue", "explained"), digits=4,
)
def _components(spark, sf):
    found = C.curve_components(_lines(spark, sf), 2)
    return spark.createDataFrame([(k + 1, float(v), float(e)) for k, (v, e) in enumerate(zip(found.values, found.explained, strict=True))], "component int, eigenvalue double, explained double")


@register(
    "mean_curve",
    """WITH e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS t, value AS y FROM events), s AS (SELECT *, lead(t) OVER w AS u, lead(y) OVER w AS v, lag(t) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT unnest([100.0, 300.0, 450.0, 800.0])::DOUBLE AS g)
    SELECT g AS t, count(*) AS n, avg(CASE WHEN g > t AND u IS NOT NULL THEN y + (v - y) * (g - t) / (u - t) ELSE y END) AS mean FROM g JOIN s ON (g >= t OR b IS NULL) AND (g < u OR u IS NULL) GROUP BY 1""",
    rounded=("mean",), digits=7,
)
def _mean(spark, sf):
    return C.mean_curve(table(spark, sf, "events"), ["user_id"], "event_id", "value", [100.0, 300.0, 450.0, 800.0])
