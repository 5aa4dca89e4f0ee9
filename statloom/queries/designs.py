"""Distributions, item response, experimental designs, meta-analysis plots, proportional hazards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.distributions import distribution
from ..operators import causal, designs, irt, survival
from ..registry import register, table
from .models import _STUDIES, _studies

#: name: parameters, and the SQL of pdf and cdf at x, and of the quantile at p.
_CLOSED = {
    "cauchy": ((1.0, 2.0), "1 / (pi() * 2 * (1 + ((x - 1) / 2) ** 2))", "0.5 + atan((x - 1) / 2) / pi()", "1 + 2 * tan(pi() * (p - 0.5))"),
    "exponential": ((0.7,), "0.7 * exp(-0.7 * x)", "1 - exp(-0.7 * x)", "-ln(1 - p) / 0.7"),
    "frechet": ((3.5, 2.0, 0.0), "3.5 / 2 * (x / 2) ** -4.5 * exp(-((x / 2) ** -3.5))", "exp(-((x / 2) ** -3.5))", "2 * (-ln(p)) ** (-1 / 3.5)"),
    "gev": ((1.0, 2.0, 0.2), "(1 + 0.2 * (x - 1) / 2) ** -6 * exp(-((1 + 0.2 * (x - 1) / 2) ** -5)) / 2", "exp(-((1 + 0.2 * (x - 1) / 2) ** -5))", "1 + 2 * ((-ln(p)) ** -0.2 - 1) / 0.2"),
    "gpd": ((0.0, 2.0, 0.3), "(1 + 0.3 * x / 2) ** (-1 / 0.3 - 1) / 2", "1 - (1 + 0.3 * x / 2) ** (-1 / 0.3)", "2 * ((1 - p) ** -0.3 - 1) / 0.3"),
    "gumbel": ((0.5, 2.0), "exp(-(x - 0.5) / 2 - exp(-(x - 0.5) / 2)) / 2", "exp(-exp(-(x - 0.5) / 2))", "0.5 - 2 * ln(-ln(p))"),
    "laplace": ((1.0, 2.0), "exp(-abs(x - 1) / 2) / 4", "CASE WHEN x < 1 THEN exp((x - 1) / 2) / 2 ELSE 1 - exp((1 - x) / 2) / 2 END", "CASE WHEN p < 0.5 THEN 1 + 2 * ln(2 * p) ELSE 1 - 2 * ln(2 - 2 * p) END"),
    "log_logistic": ((2.0, 5.0), "2.5 * (x / 2) ** 4 / (1 + (x / 2) ** 5) ** 2", "1 / (1 + (x / 2) ** -5)", "2 * (p / (1 - p)) ** 0.2"),
    "pareto": ((4.0, 0.05), "4 * 0.05 ** 4 / x ** 5", "1 - (0.05 / x) ** 4", "0.05 * (1 - p) ** -0.25"),
    "rayleigh": ((2.0,), "x / 4 * exp(-x * x / 8)", "1 - exp(-x * x / 8)", "2 * sqrt(-2 * ln(1 - p))"),
    "uniform": ((0.0, 8.0), "1 / 8.0", "x / 8", "8 * p"),
    "weibull": ((1.7, 2.0), "1.7 / 2 * (x / 2) ** 0.7 * exp(-((x / 2) ** 1.7))", "1 - exp(-((x / 2) ** 1.7))", "2 * (-ln(1 - p)) ** (1 / 1.7)"),
    "geometric": ((0.3,), "CASE WHEN x = floor(x) THEN 0.3 * 0.7 ** x ELSE 0 END", "1 - 0.7 ** (floor(x) + 1)", "greatest(0, ceil(ln(1 - p) / ln(0.7) - 1e-12) - 1)"),
    "discrete_uniform": ((0.0, 9.0), "CASE WHEN x = floor(x) AND x <= 9 THEN 0.1 ELSE 0 END", "least(1, (floor(x) + 1) / 10)", "greatest(0, ceil(p * 10 - 1e-12) - 1)"),
    "bernoulli": ((0.3,), "CASE x WHEN 1 THEN 0.3 WHEN 0 THEN 0.7 ELSE 0 END", "CASE WHEN x < 1 THEN 0.7 ELSE 1 END", "CASE WHEN p <= 0.7 THEN 0 ELSE 1 END"),
    "normal": ((1.0, 2.0), "exp(-(((x - 1) / 2) ** 2) / 2) / (2 * sqrt(2 * pi()))", None, None),
    "log_normal": ((0.2, 0.5), "exp(-(((ln(x) - 0.2) / 0.5) ** 2) / 2) / (x * 0.5 * sqrt(2 * pi()))", None, None),
    "levy": ((0.0, 1.0), "sqrt(1 / (2 * pi())) * exp(-1 / (2 * x)) / x ** 1.5", None, None),
    "gamma": ((2.5, 1.5), "exp(2.5 * ln(1.5) + 1.5 * ln(x) - 1.5 * x - lgamma(2.5))", None, None),
    "inverse_gamma": ((4.0, 3.0), "exp(4 * ln(3) - 5 * ln(x) - 3 / x - lgamma(4))", None, None),
    "chi_squared": ((4.0,), "x * exp(-x / 2) / 4", "1 - exp(-x / 2) * (1 + x / 2)", None),
    "f": ((2.0, 9.0), "(1 + 2 * x / 9) ** -5.5", "1 - (1 + 2 * x / 9) ** -4.5", "4.5 * ((1 - p) ** (-1 / 4.5) - 1)"),
    "student_t": ((2.0,), "1 / (2 * sqrt(2) * (1 + x * x / 2) ** 1.5)", "0.5 + x / (2 * sqrt(2) * sqrt(1 + x * x / 2))", "(2 * p - 1) * sqrt(2 / (4 * p * (1 - p)))"),
    "poisson": ((3.7,), "CASE WHEN x = floor(x) THEN exp(x * ln(3.7) - 3.7 - lgamma(x + 1)) ELSE 0 END", None, None),
    "binomial": ((12.0, 0.35), "CASE WHEN x = floor(x) AND x <= 12 THEN exp(lgamma(13) - lgamma(x + 1) - lgamma(greatest(1e-9, 13 - x)) + x * ln(0.35) + (12 - x) * ln(0.65)) ELSE 0 END", None, None),
    "negative_binomial": ((4.0, 0.45), "CASE WHEN x = floor(x) THEN exp(lgamma(x + 4) - lgamma(x + 1) - lgamma(4) + 4 * ln(0.45) + x * ln(0.55)) ELSE 0 END", None, None),
    "zero_inflated_poisson": ((4.0, 0.3), "CASE WHEN x = floor(x) THEN CASE WHEN x = 0 THEN 0.3 ELSE 0 END + 0.7 * exp(x * ln(4) - 4 - lgamma(x + 1)) ELSE 0 END", None, None),
}
_X, _P = "(p_size / 10.0)::DOUBLE", "((p_partkey % 97 + 1) / 99.0)::DOUBLE"


def _parts():
    """(column, method, SQL) of every family's functions that SQL has."""
    for name, (_, *sql) in _CLOSED.items():
        for method, at, text in zip(("pdf", "cdf", "quantile"), "xxp", sql, strict=True):
            if text:
                yield f"{name}_{method}", name, method, at, text


@register(
    "distribution_functions",
    f"WITH t AS (SELECT p_partkey, {_X} AS x, {_P} AS p FROM part) SELECT p_partkey, " + ", ".join(f"CAST({text} AS DOUBLE) AS {c}" for c, _, _, _, text in _parts()) + " FROM t",
    rounded=tuple(c for c, *_ in _parts()), digits=8,
)
def _distributions(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 10).alias("x"), ((F.col("p_partkey") % 97 + 1) / 99).alias("p"))
    return t.select("p_partkey", *[getattr(distribution(name, *_CLOSED[name][0]), method)(at).cast("double").alias(c) for c, name, method, at, _ in _parts()])


@register("distribution_round_trip")
def _round_trip(spark, sf):
    """Quantiles of every family without a closed form in SQL, back through their cdf."""
    own = {"beta": (2.0, 3.0), "von_mises": (0.4, 2.0), "truncated_normal": (1.0, 2.0, 0.0, 4.0), "hypergeometric": (40.0, 15.0, 12.0), "levy": (0.5, 1.0), "gamma": (2.5, 1.5), "inverse_gamma": (4.0, 3.0), "log_normal": (0.2, 0.5), "normal": (1.0, 2.0), "poisson": (3.7,), "binomial": (12.0, 0.35), "negative_binomial": (4.0, 0.45), "zero_inflated_poisson": (4.0, 0.3)}
    t = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 97 + 1) / 99).alias("p"))
    d = {k: distribution(k, *v) for k, v in own.items()}
    t = t.select("*", *[d[k].quantile("p").alias(k) for k in d])
    return t.select("p_partkey", "p", *d, *[d[k].cdf(k).alias(f"{k}_cdf") for k in d])


_IRT = "(SELECT p_partkey AS item, 0.5 + p_size / 50.0 AS a, (p_partkey % 7 - 3) / 2.0 AS b, 0.2 AS c FROM part)"


def _items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), (0.5 + F.col("p_size") / 50).alias("a"), ((F.col("p_partkey") % 7 - 3) / 2).alias("b"), F.lit(0.2).alias("c"))


@register("item_curves", f"WITH t AS (SELECT item, a, b, c, -4 + k * 0.5 AS theta FROM {_IRT}, range(17) AS r(k)), p AS (SELECT *, c + (1 - c) / (1 + exp(-a * (theta - b))) AS probability FROM t) SELECT item, theta, probability, a * a * ((probability - c) / (1 - c)) ** 2 * (1 - probability) / probability AS information FROM p", rounded=("theta", "probability", "information"), digits=8)
def _curves(spark, sf):
    return irt.curve(_items(spark, sf), points=17).select("item", "theta", "probability", "information")


@register("test_information", f"WITH t AS (SELECT a, b, c, -4 + k * 0.1 AS theta FROM {_IRT}, range(81) AS r(k)), p AS (SELECT *, c + (1 - c) / (1 + exp(-a * (theta - b))) AS p FROM t) SELECT round(theta, 6) AS theta, sum(a * a * ((p - c) / (1 - c)) ** 2 * (1 - p) / p) AS information FROM p GROUP BY 1", rounded=("theta", "information"), digits=6)
def _test_information(spark, sf):
    return irt.test_information(_items(spark, sf))


@register("graded_items", "WITH t AS (SELECT p_partkey, p_size / 10.0 - 2.5 AS theta FROM part) SELECT p_partkey, 1 - 1 / (1 + exp(-1.3 * (theta + 1))) AS c0, 1 / (1 + exp(-1.3 * (theta + 1))) - 1 / (1 + exp(-1.3 * (theta - 0.2))) AS c1, 1 / (1 + exp(-1.3 * (theta - 0.2))) - 1 / (1 + exp(-1.3 * (theta - 1.5))) AS c2, 1 / (1 + exp(-1.3 * (theta - 1.5))) AS c3 FROM t", rounded=("c0", "c1", "c2", "c3"), digits=9)
def _graded(spark, sf):
    p = irt.graded_probabilities(F.col("p_size") / 10 - 2.5, 1.3, F.array(F.lit(-1.0), F.lit(0.2), F.lit(1.5)))
    return table(spark, sf, "part").select("p_partkey", p.alias("p")).select("p_partkey", *[F.col("p")[k].alias(f"c{k}") for k in range(4)])


_NODES = list(zip(*(v.tolist() for v in np.polynomial.hermite_e.hermegauss(21)), strict=True))


@register(
    "abilities",
    f"""WITH n(x, w) AS (VALUES {", ".join(f"({x!r}::DOUBLE, {w!r}::DOUBLE)" for x, w in _NODES)}), r AS (SELECT l_suppkey AS person, l_partkey % 9 AS item, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem),
    t AS (SELECT person, x, w, y, greatest(1e-15, least(1 - 1e-15, 0.1 + 0.9 / (1 + exp(-(0.8 + item / 10.0) * (x - (item - 4) / 3.0))))) AS p FROM r, n), l AS (SELECT person, x, any_value(w) AS w, sum(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS l, count(*) AS k FROM t GROUP BY 1, 2),
    m AS (SELECT *, w * exp(l - max(l) OVER (PARTITION BY person)) AS m FROM l), s AS (SELECT person, any_value(k) AS n, sum(m * x) / sum(m) AS theta, sum(m * x * x) / sum(m) AS q FROM m GROUP BY 1) SELECT person, n, theta, sqrt(greatest(0, q - theta * theta)) AS sd FROM s""",
    rounded=("theta", "sd"), digits=5,
)
def _abilities(spark, sf):
    items = spark.range(9).select(F.col("id").alias("item"), (0.8 + F.col("id") / 10).alias("a"), ((F.col("id") - 4) / 3).alias("b"), F.lit(0.1).alias("c"))
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), (F.col("l_partkey") % 9).cast("long").alias("item"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"))
    return irt.abilities(rows, items, "person", "item", "y")


@register("full_factorial", "SELECT a.x AS a, b.x AS b, c.x AS c FROM (VALUES (-1.0::DOUBLE), (1.0)) a(x), (VALUES (0.0::DOUBLE), (0.5), (1.0)) b(x), (VALUES (2.0::DOUBLE), (4.0)) c(x)")
def _factorial(spark, sf):
    return designs.full_factorial(spark, {"a": [-1, 1], "b": [0, 0.5, 1], "c": [2, 4]})


@register("latin_square", "SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS \"column\", CAST((r + c) % 7 AS INTEGER) AS treatment FROM range(7) AS a(r), range(7) AS b(c)")
def _latin(spark, sf):
    return designs.latin_square(spark, 7)


@register("central_composite", "SELECT 'corner' AS kind, a.x AS x1, b.x AS x2 FROM (VALUES (-1.0::DOUBLE), (1.0)) a(x), (VALUES (-1.0::DOUBLE), (1.0)) b(x) UNION ALL SELECT 'axial', x, y FROM (VALUES (-sqrt(2), 0.0), (sqrt(2), 0.0), (0.0, -sqrt(2)), (0.0, sqrt(2))) v(x, y) UNION ALL SELECT 'centre', 0.0, 0.0 FROM range(3)", rounded=("x1", "x2"), digits=9)
def _composite(spark, sf):
    return designs.central_composite(spark, 2)


def _balanced(spark, sf):
    """Means of the events' values by user, kind and day of month: cells of a design."""
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 4).alias("a"), (F.col("l_partkey") % 3).alias("b"), (F.col("l_suppkey") % 5).alias("c"), "l_extendedprice")
    return t.groupBy("a", "b", "c").agg(F.avg("l_extendedprice").alias("y"))


_CELLS = "WITH d AS (SELECT l_orderkey % 4 AS a, l_partkey % 3 AS b, l_suppkey % 5 AS c, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1, 2, 3), g AS (SELECT avg(y) AS m, count(*) AS n, var_pop(y) * count(*) AS t FROM d)"
_SS = "(SELECT sum(k * (u - m) ** 2) AS ss, count(*) - 1 AS df FROM (SELECT count(*) AS k, avg(y) AS u FROM d GROUP BY {0}), g)"


@register(
    "factorial_anova",
    _CELLS
    + f""", a AS {_SS.format("a")}, b AS {_SS.format("b")}, c AS {_SS.format("c")}, ab AS {_SS.format("a, b")}, r AS (SELECT 'a' AS source, ss, df * 1.0 AS df FROM a UNION ALL SELECT 'b', ss, df FROM b UNION ALL SELECT 'c', ss, df FROM c
    UNION ALL SELECT 'a+b', ab.ss - a.ss - b.ss, ab.df - a.df - b.df FROM ab, a, b), e AS (SELECT 'error' AS source, any_value(t) - sum(ss) AS ss, any_value(n) - 1 - sum(df) AS df FROM r, g)
    SELECT source, ss, CAST(df AS DOUBLE) AS df, ss / df AS ms, CASE WHEN source <> 'error' THEN ss / df / (SELECT ss / df FROM e) END AS statistic FROM (SELECT * FROM r UNION ALL SELECT * FROM e) UNION ALL SELECT 'total', t, n - 1.0, NULL, NULL FROM g""",
    rounded=("ss", "df", "ms", "statistic"), digits=2,
)
def _factorial_anova(spark, sf):
    return designs.additive_anova(_balanced(spark, sf), "y", ["a", "b", "c"], [("a", "b")]).drop("p_value")


@register("factor_effects", _CELLS + " SELECT 'a' AS factor, (SELECT avg(y) FROM d WHERE a = 3) - (SELECT avg(y) FROM d WHERE a = 0) AS effect UNION ALL SELECT 'b', (SELECT avg(y) FROM d WHERE b = 2) - (SELECT avg(y) FROM d WHERE b = 0) UNION ALL SELECT 'c', (SELECT avg(y) FROM d WHERE c = 4) - (SELECT avg(y) FROM d WHERE c = 0)", rounded=("effect",), digits=4)
def _effects(spark, sf):
    return designs.factor_effects(_balanced(spark, sf), "y", ["a", "b", "c"])


@register("response_surface")
def _surface(spark, sf):
    model, at = designs.response_surface(table(spark, sf, "lineitem").withColumn("d", F.col("l_discount") * 10), ["l_quantity", "d"], "l_extendedprice")
    return model.table(spark).unionByName(spark.createDataFrame([("stationary:l_quantity", float(at[0]), None, None, None), ("stationary:d", float(at[1]), None, None, None)], model.table(spark).schema))


_DL = ", m AS (SELECT sum(y / v) / sum(1 / v) AS m, sum(1 / v) AS w1, sum(1 / v ** 2) AS w2, count(*) - 1 AS df FROM s), q AS (SELECT greatest(0, (sum((y - m) ** 2 / v) - any_value(df)) / (any_value(w1) - any_value(w2) / any_value(w1))) AS tau2 FROM s, m)"


@register("forest", f"{_STUDIES.replace('SELECT', 'SELECT p_brand,', 1) if 'p_brand,' not in _STUDIES else _STUDIES}{_DL} SELECT p_brand, y AS effect, y - 1.959963984540054 * sqrt(v) AS low, y + 1.959963984540054 * sqrt(v) AS high, 100 / (v + tau2) / sum(1 / (v + tau2)) OVER () AS weight FROM s, q", rounded=("effect", "low", "high", "weight"), digits=4)
def _forest(spark, sf):
    return causal.forest(_studies(spark, sf), "y", "v", ["p_brand"])


@register("funnel", f"{_STUDIES}, o AS (SELECT sum(y / v) / sum(1 / v) AS centre, max(sqrt(v)) AS most FROM s) SELECT CAST(k AS INTEGER) AS step, most * k / 50 AS se, centre - 1.959963984540054 * most * k / 50 AS low, centre + 1.959963984540054 * most * k / 50 AS high FROM o, range(51) AS r(k)", rounded=("se", "low", "high"), digits=4)
def _funnel(spark, sf):
    return causal.funnel(_studies(spark, sf).withColumn("se", F.sqrt("v")), "y", "se")


@register("beggs_test", f"{_STUDIES}, m AS (SELECT sum(y / v) / sum(1 / v) AS m, sum(1 / v) AS w FROM s), t AS (SELECT (y - m) / sqrt(v - 1 / w) AS t, v FROM s, m), k AS (SELECT count(*) AS p, sum(sign(a.t - b.t) * sign(a.v - b.v)) AS s FROM t a, t b WHERE a.v < b.v) SELECT (SELECT count(*) FROM t) AS n, CAST(s / p AS DOUBLE) AS tau FROM k", rounded=("tau",), digits=9)
def _begg(spark, sf):
    return causal.beggs_test(_studies(spark, sf), "y", "v").select("n", "tau")


@register("trim_and_fill")
def _trim(spark, sf):
    return causal.trim_and_fill(_studies(spark, sf), "y", "v")


@register(
    "cox_regression",
    """WITH RECURSIVE c AS (SELECT l_quantity AS t, count(*) FILTER (l_returnflag <> 'N') AS d, sum(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) FILTER (l_returnflag <> 'N') AS dx, count(*) FILTER (l_linestatus = 'F') AS k1, count(*) FILTER (l_linestatus <> 'F') AS k0 FROM lineitem GROUP BY 1),
    r AS (SELECT d, coalesce(dx, 0) AS dx, sum(k1) OVER (ORDER BY t DESC) AS n1, sum(k0) OVER (ORDER BY t DESC) AS n0 FROM c),
    b(i, b) AS (SELECT 0, 0.0::DOUBLE UNION ALL SELECT i + 1, b + (SELECT sum(dx - d * n1 * exp(b) / (n0 + n1 * exp(b))) / sum(d * n0 * n1 * exp(b) / (n0 + n1 * exp(b)) ** 2) FROM r) FROM b WHERE i < 20)
    SELECT 'f' AS term, b AS estimate, exp(b) AS hazard_ratio, (SELECT 1 / sqrt(sum(d * n0 * n1 * exp(b) / (n0 + n1 * exp(b)) ** 2)) FROM r) AS se FROM b WHERE i = 20""",
    rounded=("estimate", "hazard_ratio", "se"), digits=5,
)
def _cox(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("f", F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))
    return survival.cox_regression(rows, "l_quantity", F.col("l_returnflag") != "N", ["f"]).table(spark).select("term", "estimate", "hazard_ratio", "se")
