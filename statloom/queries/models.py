"""Regression, survival, causal estimates and meta-analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, survival
from ..operators import regression as R
from ..registry import register, table


@register("linear_simple", "SELECT l_returnflag, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1", rounded=("slope", "intercept", "r2"), digits=4)
def _simple(spark, sf):
    return R.simple_linear(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


_COV = """WITH c AS (SELECT covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_extendedprice, l_quantity) AS ya,
covar_pop(l_extendedprice, l_discount) AS yb, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
b AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b2 FROM c)"""


@register("linear_multiple", f"{_COV} SELECT '(intercept)' AS term, my - b1 * ma - b2 * mb AS estimate FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b", rounded=("estimate",), digits=3)
def _multiple(spark, sf):
    model = R.ordinary(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return model.table(spark).select("term", "estimate")


@register("ridge", f"{_COV.replace('aa * bb - ab * ab', '(aa * (1 + l)) * (bb * (1 + l)) - ab * ab').replace('ya * bb', 'ya * (bb * (1 + l))').replace('yb * aa', 'yb * (aa * (1 + l))').replace('FROM c)', 'FROM c, (SELECT 10.0 / count(*) AS l FROM lineitem))')} SELECT '(intercept)' AS term, my - b1 * ma - b2 * mb AS estimate FROM b UNION ALL SELECT 'l_quantity', b1 FROM b UNION ALL SELECT 'l_discount', b2 FROM b", rounded=("estimate",), digits=3)
def _ridge(spark, sf):
    return R.ridge(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 10.0).table(spark).select("term", "estimate")


@register("lasso")
def _lasso(spark, sf):
    return R.lasso(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 50.0).table(spark).select("term", "estimate")


@register("polynomial")
def _polynomial(spark, sf):
    return R.polynomial(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 3).table(spark)


@register("stepwise")
def _stepwise(spark, sf):
    return R.stepwise(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").table(spark)


@register("logistic")
def _logistic(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("y", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return R.logistic(rows, ["l_quantity", "l_discount"], "y").table(spark, large=True)


@register("glm_poisson")
def _poisson(spark, sf):
    return R.glm(table(spark, sf, "lineitem"), ["l_discount", "l_tax"], "l_quantity", "poisson").table(spark, large=True)


@register("quantile_regression")
def _quantile(spark, sf):
    return R.quantile_regression(table(spark, sf, "part"), ["p_size"], "p_retailprice", 0.75, rounds=30).table(spark).select("term", "estimate")


@register("huber_regression")
def _huber(spark, sf):
    return R.huber_regression(table(spark, sf, "part"), ["p_size"], "p_retailprice").table(spark).select("term", "estimate")


@register("variance_inflation", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) ** 2 AS r2 FROM lineitem) SELECT f AS feature, 1 / (1 - r2) AS vif FROM r, (VALUES ('l_quantity'), ('l_extendedprice')) AS v(f)", rounded=("vif",))
def _vif(spark, sf):
    return R.variance_inflation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@register(
    "influence",
    """WITH r AS (SELECT c_custkey, c_acctbal AS y, CAST(c_nationkey AS DOUBLE) AS x FROM customer),
    m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, count(*) AS n, (regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) / (count(*) - 2) AS mse FROM r),
    e AS (SELECT c_custkey, y - a - b * x AS e, 1 / n + (x - mx) ** 2 / sxx AS h, mse, n FROM r, m),
    s AS (SELECT *, sqrt(((n - 2) * mse - e * e / (1 - h)) / (n - 3)) AS s FROM e)
    SELECT c_custkey, e AS residual, h AS leverage, e / (s * sqrt(1 - h)) AS studentized, e * e * h / (2 * mse * (1 - h) ** 2) AS cooks_distance, e * sqrt(h) / (s * (1 - h)) AS dffits FROM s""",
    rounded=("residual", "leverage", "studentized", "cooks_distance", "dffits"), digits=5,
)
def _influence(spark, sf):
    return R.influence(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"]).select("c_custkey", "residual", "leverage", "studentized", "cooks_distance", "dffits")


@register("durbin_watson", "WITH d AS (SELECT user_id, value AS e, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) SELECT user_id, sum(d * d) / sum(e * e) AS durbin_watson FROM d GROUP BY user_id", rounded=("durbin_watson",))
def _dw(spark, sf):
    return R.residual_tests(table(spark, sf, "events"), "value", "ts", ["user_id"]).select("user_id", "durbin_watson")


@register(
    "breusch_pagan",
    "WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), e AS (SELECT (l_extendedprice - a - b * l_quantity) ** 2 AS e, l_quantity AS q FROM lineitem, m) SELECT count(*) * regr_r2(e, q) AS statistic, 1.0::DOUBLE AS df FROM e",
    rounded=("statistic",), digits=4,
)
def _bp(spark, sf):
    rows = table(spark, sf, "lineitem")
    model = R.ordinary(rows, ["l_quantity"], "l_extendedprice")
    rows = model.transform(rows).withColumn("e", F.col("l_extendedprice") - F.col("prediction"))
    return R.breusch_pagan(rows, ["l_quantity"], "e").drop("p_value")


@register("reset_test")
def _reset(spark, sf):
    return R.reset_test(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")


@register(
    "icc",
    """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) * count(*) AS s FROM orders GROUP BY 1),
    t AS (SELECT count(*) AS k, sum(n) AS a, sum(n * n) AS q, sum(s) AS w, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS b FROM g),
    u AS (SELECT b / (k - 1) AS ms_between, w / (a - k) AS ms_within, (a - q / a) / (k - 1) AS n0 FROM t) SELECT (ms_between - ms_within) / (ms_between + (n0 - 1) * ms_within) AS icc, n0 FROM u""",
    rounded=("icc", "n0"), digits=5,
)
def _icc(spark, sf):
    return R.icc(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").select("icc", "n0")


_LIFE = """WITH c AS (SELECT l_linestatus AS g, l_quantity AS time, count(*) FILTER (l_returnflag <> 'N') AS d, count(*) AS c FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY g ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM c)"""


def _lived(spark, sf):
    return table(spark, sf, "lineitem").withColumn("event", F.col("l_returnflag") != "N")


@register(
    "kaplan_meier",
    f"""{_LIFE}, s AS (SELECT *, CASE WHEN min(n - d) OVER w = 0 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS s, sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER w AS v FROM r WINDOW w AS (PARTITION BY g ORDER BY time))
    SELECT g AS l_linestatus, time, CAST(n AS BIGINT) AS at_risk, d AS events, CAST(s AS DOUBLE) AS survival, s * sqrt(v) AS se FROM s""",
    rounded=("survival", "se"),
)
def _km(spark, sf):
    return survival.kaplan_meier(_lived(spark, sf), "l_quantity", "event", ["l_linestatus"]).drop("low", "high")


@register("nelson_aalen", f"{_LIFE} SELECT g AS l_linestatus, time, CAST(n AS BIGINT) AS at_risk, d AS events, sum(d / n) OVER (PARTITION BY g ORDER BY time) AS hazard, sum(d / (n * n)) OVER (PARTITION BY g ORDER BY time) AS variance FROM r", rounded=("hazard", "variance"))
def _na(spark, sf):
    return survival.nelson_aalen(_lived(spark, sf), "l_quantity", "event", ["l_linestatus"])


@register("kaplan_meier_all", "WITH c AS (SELECT l_extendedprice AS time, count(*) FILTER (l_returnflag <> 'N') AS d, count(*) AS c FROM lineitem GROUP BY 1), r AS (SELECT *, sum(c) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM c), s AS (SELECT time, exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER (ORDER BY time)) AS s, min(n - d) OVER (ORDER BY time) AS z FROM r) SELECT min(time) AS median FROM s WHERE z = 0 OR s <= 0.5")
def _km_all(spark, sf):
    return survival.median_survival(survival.kaplan_meier(_lived(spark, sf), "l_extendedprice", "event"))


@register(
    "log_rank",
    """WITH c AS (SELECT l_quantity AS t, count(*) FILTER (l_returnflag <> 'N') AS d, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O') AS d1, count(*) AS c, count(*) FILTER (l_linestatus = 'O') AS c1 FROM lineitem GROUP BY 1),
    r AS (SELECT d, d1, sum(c) OVER w AS n, sum(c1) OVER w AS n1 FROM c WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    s AS (SELECT sum(d1) AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r)
    SELECT CAST(o AS BIGINT) AS observed, e AS expected, v AS variance, (o - e) ** 2 / v AS statistic FROM s""",
    rounded=("expected", "variance", "statistic"), digits=4,
)
def _log_rank(spark, sf):
    return survival.log_rank(_lived(spark, sf), "l_quantity", "event", "l_linestatus", "O", "F").drop("p_value")


_TREATED = "SELECT o_orderkey, o_totalprice AS y, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS t, 0.1 + (o_custkey % 97) / 120.0 AS e FROM orders"


def _treated(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("t"), (0.1 + (F.col("o_custkey") % 97) / 120.0).alias("e"))


@register("inverse_probability", f"WITH r AS (SELECT y, t, CAST(e AS DOUBLE) AS e FROM ({_TREATED})) SELECT avg(t * y / e - (1 - t) * y / (1 - e)) AS ate, sum(t * y) / sum(t) - sum((1 - t) * e / (1 - e) * y) / sum((1 - t) * e / (1 - e)) AS att, count(*) AS n FROM r", rounded=("ate", "att"), digits=3)
def _ipw(spark, sf):
    return causal.inverse_probability(_treated(spark, sf), "y", "t", "e")


@register(
    "score_matching",
    f"""WITH r AS (SELECT o_orderkey AS id, y, t, CAST(e AS DOUBLE) AS e FROM ({_TREATED})), c AS (SELECT e, min(id) AS id FROM r WHERE t = 0 GROUP BY e), k AS (SELECT DISTINCT e FROM r WHERE t = 1),
    g AS (SELECT k.e, min(abs(k.e - c.e)) AS gap FROM k, c GROUP BY k.e) SELECT r.id, g.gap FROM r JOIN g USING (e) WHERE t = 1""",
    rounded=("gap",),
)
def _matching(spark, sf):
    return causal.nearest_score_matching(_treated(spark, sf), "y", "t", "e", "o_orderkey").select("id", "gap")


@register(
    "difference_in_differences",
    """WITH r AS (SELECT o_totalprice AS v, o_orderstatus = 'F' AS t, year(o_orderdate) >= 1998 AS p FROM orders),
    s AS (SELECT avg(v) FILTER (t AND p) AS m11, avg(v) FILTER (t AND NOT p) AS m10, avg(v) FILTER (NOT t AND p) AS m01, avg(v) FILTER (NOT t AND NOT p) AS m00,
      sqrt(var_samp(v) FILTER (t AND p) / count(*) FILTER (t AND p) + var_samp(v) FILTER (t AND NOT p) / count(*) FILTER (t AND NOT p) + var_samp(v) FILTER (NOT t AND p) / count(*) FILTER (NOT t AND p) + var_samp(v) FILTER (NOT t AND NOT p) / count(*) FILTER (NOT t AND NOT p)) AS se FROM r)
    SELECT m11, m10, m01, m00, m11 - m10 - (m01 - m00) AS estimate, se FROM s""",
    rounded=("m11", "m10", "m01", "m00", "estimate", "se"), digits=3,
)
def _did(spark, sf):
    return causal.difference_in_differences(table(spark, sf, "orders"), "o_totalprice", F.col("o_orderstatus") == "F", F.year("o_orderdate") >= 1998).drop("p_value")


@register(
    "regression_discontinuity",
    "WITH r AS (SELECT l_extendedprice AS y, l_quantity - 25 AS r FROM lineitem WHERE abs(l_quantity - 25) <= 15), s AS (SELECT regr_intercept(y, r) FILTER (r >= 0) AS above, regr_intercept(y, r) FILTER (r < 0) AS below, count(*) FILTER (r >= 0) AS n_above, count(*) FILTER (r < 0) AS n_below FROM r) SELECT above - below AS estimate, above, below, n_above, n_below FROM s",
    rounded=("estimate", "above", "below"), digits=3,
)
def _rdd(spark, sf):
    return causal.regression_discontinuity(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 25, 15)


@register("two_stage_least_squares")
def _two_stage(spark, sf):
    return causal.two_stage(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_discount", "l_tax"]).table(spark, large=True)


_STUDIES = "WITH s AS (SELECT p_brand, avg(p_retailprice) AS y, var_samp(p_retailprice) / count(*) AS v FROM part GROUP BY 1)"


def _studies(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("y"), (F.var_samp("p_retailprice") / F.count(F.lit(1))).alias("v"))


@register("meta_fixed", f"{_STUDIES} SELECT sum(y / v) / sum(1 / v) AS estimate, sqrt(1 / sum(1 / v)) AS se FROM s", rounded=("estimate", "se"), digits=4)
def _fixed(spark, sf):
    return causal.fixed_effects(_studies(spark, sf), "y", "v").select("estimate", "se")


@register("meta_random", f"{_STUDIES}, m AS (SELECT sum(y / v) / sum(1 / v) AS m, sum(1 / v) AS w1, sum(1 / v ** 2) AS w2, count(*) - 1 AS df FROM s), q AS (SELECT sum((y - m) ** 2 / v) AS q, any_value(df) AS df, any_value(w1) AS w1, any_value(w2) AS w2 FROM s, m), t AS (SELECT q, df, greatest(0, (q - df) / (w1 - w2 / w1)) AS tau2 FROM q) SELECT sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS estimate, sqrt(1 / sum(1 / (v + tau2))) AS se, any_value(tau2) AS tau2, any_value(q) AS q FROM s, t", rounded=("estimate", "se", "tau2", "q"), digits=4)
def _random(spark, sf):
    return causal.random_effects(_studies(spark, sf), "y", "v").select("estimate", "se", "tau2", "q")


@register("eggers_test")
def _eggers(spark, sf):
    rows = _studies(spark, sf).withColumn("se", F.sqrt("v"))
    return causal.eggers_test(rows, "y", "se")
