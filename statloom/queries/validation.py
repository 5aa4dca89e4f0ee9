"""Nested, repeated and rolling validation of linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from ..registry import register, table

_MSE = "sum((y - i - s * x) ** 2) / count(*)"


@register(
    "nested_cross_validation",
    f"""WITH r AS (SELECT o_orderkey % 5 AS o, o_custkey % 3 AS k, CAST(o_custkey AS DOUBLE) AS a, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS b, CAST(o_totalprice AS DOUBLE) AS y FROM orders),
    f AS (SELECT DISTINCT o FROM r), g AS (SELECT DISTINCT k FROM r), m AS (SELECT o, y, k, unnest(['a', 'b']) AS name, unnest([a, b]) AS x FROM r),
    ti AS (SELECT f.o AS held, g.k AS part, m.name, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM f, g, m WHERE m.o <> f.o AND m.k <> g.k GROUP BY 1, 2, 3),
    si AS (SELECT held, part, name, {_MSE} AS mse FROM ti JOIN m USING (name) WHERE m.o <> held AND m.k = part GROUP BY 1, 2, 3),
    pick AS (SELECT held, arg_min(name, mse) AS name, min(mse) AS inner_mse FROM (SELECT held, name, avg(mse) AS mse FROM si GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT held, name, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM pick JOIN m USING (name) WHERE m.o <> held GROUP BY 1, 2)
    SELECT held::INT AS fold, count(*) AS n, name, any_value(inner_mse) AS inner_mse, {_MSE} AS mse FROM t JOIN m USING (name) JOIN pick USING (held, name) WHERE m.o = held GROUP BY held, name""",
    rounded=("inner_mse", "mse"), digits=0,
)
def _nested(spark, sf):
    """Inner folds choose one of two features for each outer fold."""
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("double").alias("a"), F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double").alias("b"), F.col("o_totalprice").cast("double").alias("y"))
    out = V.nested_validation(t, ["a", "b"], "y", F.col("o_orderkey") % 5, F.col("o_custkey") % 3, subsets=[["a"], ["b"]])
    return out.select("fold", "n", F.col("features")[0].alias("name"), "inner_mse", "mse")


@register(
    "split_validation",
    f"""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS l, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), s AS (SELECT unnest(range(8)) AS split),
    t AS (SELECT split, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, count(*) AS n_train FROM s, r WHERE (k * 7 + l * 3) % 8 <> split GROUP BY 1)
    SELECT split::INT AS split, any_value(n_train) AS n_train, count(*) AS n_test, {_MSE} AS mse FROM t, r WHERE (k * 7 + l * 3) % 8 = split GROUP BY 1""",
    rounded=("mse",), digits=0,
)
def _splits(spark, sf):
    t = table(spark, sf, "lineitem").withColumns({"x": F.col("l_quantity").cast("double"), "y": F.col("l_extendedprice").cast("double")})
    return V.split_validation(t, ["x"], "y", [(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 8 == s for s in range(8)])


@register(
    "rolling_validation",
    f"""WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS p, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM customer), w AS (SELECT unnest(range(0, greatest(0, (count(*) - 80) // 30 + 1))) AS w FROM r HAVING count(*) >= 80),
    t AS (SELECT w, greatest(60 + 30 * w - 90, 0) AS a, 60 + 30 * w AS b, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM w, r WHERE p >= 60 + 30 * w - 90 AND p < 60 + 30 * w GROUP BY w)
    SELECT w AS window, a AS train_start, b AS train_end, b + 20 AS test_end, {_MSE} AS mse FROM t, r WHERE p >= b AND p < b + 20 GROUP BY w, a, b""",
    rounded=("mse",), digits=0,
)
def _rolling(spark, sf):
    t = table(spark, sf, "customer").withColumns({"x": F.col("c_nationkey").cast("double"), "y": F.col("c_acctbal").cast("double")})
    return V.rolling_validation(t, ["x"], "y", ["c_custkey"], 60, 30, 20, 90)
