"""Intervals of regressions, powers of observed effects, points of plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import distribution
from ..operators import descriptive as D
from ..operators import effects as E
from ..operators import regression as R
from ..registry import register, table


@register(
    "regression_intervals",
    """WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
      regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / (count(*) - 2) AS mse FROM lineitem GROUP BY 1)
    SELECT l_returnflag, '(intercept)' AS term, a AS estimate, sqrt(mse * (1 / n + m * m / sxx)) AS se, a / sqrt(mse * (1 / n + m * m / sxx)) AS statistic, a AS middle FROM s
    UNION ALL SELECT l_returnflag, 'l_quantity', b, sqrt(mse / sxx), b / sqrt(mse / sxx), b FROM s""",
    rounded=("estimate", "se", "statistic", "middle"), digits=4,
)
def _intervals(spark, sf):
    """Intercept and slope for each flag; the middle of an interval is its estimate."""
    rows = R.simple_intervals(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 0.95, ["l_returnflag"])
    return rows.select("l_returnflag", "term", "estimate", "se", "statistic", ((F.col("low") + F.col("high")) / 2).alias("middle"))


@register(
    "observed_effect",
    """WITH s AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1)
    SELECT count(*) AS groups, count(*) / sum(1 / n) AS n, sqrt((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / sum(n * v)) AS f FROM s""",
    rounded=("n", "f"), digits=8,
)
def _effect(spark, sf):
    """The size of the nations' differences in balance, as an analysis of variance sees it."""
    return E.observed_power(table(spark, sf, "customer"), "c_acctbal", "c_nationkey").drop("power")


@register("quantile_points", "SELECT row_number() OVER (ORDER BY l_quantity) - 1 AS i, -ln(1 - (row_number() OVER (ORDER BY l_quantity) - 0.3175) / (count(*) OVER () + 0.365)) / 0.04 AS theoretical, CAST(l_quantity AS DOUBLE) AS sample FROM lineitem", rounded=("theoretical",), digits=6)
def _quantiles(spark, sf):
    return D.quantile_points(table(spark, sf, "lineitem"), "l_quantity", distribution("exponential", 0.04).quantile)


@register("scatter_pairs", "WITH s AS (SELECT CAST(s_acctbal AS DOUBLE) AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier) SELECT 's_acctbal' AS x_name, 's_nationkey' AS y_name, a AS x, b AS y FROM s UNION ALL SELECT 's_nationkey', 's_acctbal', b, a FROM s")
def _scatter(spark, sf):
    return D.pairs_of(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"])
