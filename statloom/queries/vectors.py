"""Multivariate densities and mixtures over pairs of columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import multivariate as D
from ..operators import mixtures as M
from ..registry import register, table

_XY = "x AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0 AS a, l_discount * 100.0 - 5 AS b FROM lineitem)"


def _pairs(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).cast("double").alias("a"), (F.col("l_discount") * 100 - 5).cast("double").alias("b"))
    return t.withColumn("x", F.array("a", "b"))


#: Mean (2.5, 0) and covariance ((2, 0.5), (0.5, 10)); its determinant is 19.75.
_MEAN, _COV = (2.5, 0.0), ((2.0, 0.5), (0.5, 10.0))
_QUAD = "(10 * (a - 2.5) ** 2 - (a - 2.5) * b + 2 * b ** 2) / 19.75"


@register("multivariate_densities", f"WITH {_XY} SELECT l_orderkey, l_linenumber, -0.5 * ({_QUAD} + 2 * ln(2 * pi()) + ln(19.75)) AS normal, -ln(2 * pi()) - 0.5 * ln(19.75) - 4 * ln(1 + {_QUAD} / 6) AS student FROM x", rounded=("normal", "student"), digits=9)
def _densities(spark, sf):
    """Log densities under a normal and a t distribution of 6 degrees, whose constant in two dimensions is 1 / (2 pi)."""
    t = _pairs(spark, sf)
    return t.select("l_orderkey", "l_linenumber", D.MultivariateNormal(_MEAN, _COV).log_pdf(F.col("x")).alias("normal"), D.MultivariateT(6.0, _MEAN, _COV).log_pdf(F.col("x")).alias("student"))


@register(
    "composition_densities",
    """WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)
    SELECT l_orderkey, lgamma(a + n + r + 1.0) - lgamma(a + 1.0) - lgamma(n + 1.0) - lgamma(r + 1.0) + a * ln(0.3) + n * ln(0.5) + r * ln(0.2) AS multinomial,
      ln(60) + ln((n + 1) / (a + n + r + 3.0)) + 2 * ln((r + 1) / (a + n + r + 3.0)) AS dirichlet FROM s WHERE a + n + r = 4""",
    rounded=("multinomial", "dirichlet"), digits=8,
)
def _compositions(spark, sf):
    """Orders of four lines: the chance of their flags, and the density of their smoothed shares."""
    flags = [F.sum(F.when(F.col("l_returnflag") == f, 1.0).otherwise(0.0)) for f in "ANR"]
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array(*flags).alias("x"))
    t = t.where(F.aggregate("x", F.lit(0.0), lambda s, v: s + v) == 4)
    shares = F.transform("x", lambda v: (v + 1) / 7)
    return t.select("l_orderkey", D.Multinomial(4, (0.3, 0.5, 0.2)).log_pmf(F.col("x")).alias("multinomial"), D.Dirichlet((1.0, 2.0, 3.0)).log_pdf(shares).alias("dirichlet"))


@register(
    "mixture_of_one",
    f"""WITH {_XY}, m AS (SELECT count(*) AS n, avg(a) AS a, avg(b) AS b, var_pop(a) AS v, var_pop(b) AS w, covar_pop(a, b) AS c FROM x)
    SELECT a, b, v * (1 + 1e-6) AS v, w * (1 + 1e-6) AS w, c FROM m""",
    rounded=("a", "b", "v", "w", "c"), digits=7,
)
def _one(spark, sf):
    """One component is the mean and covariance of all rows, with the floor on its diagonal."""
    fit = M.fit_mixtures(_pairs(spark, sf), ["a", "b"], 1)[1]
    (a, b), ((v, c), (_, w)) = fit.means[0], fit.covariances[0]
    return spark.createDataFrame([tuple(map(float, (a, b, v, w, c)))], "a double, b double, v double, w double, c double")


@register(
    "mixture_labels",
    f"""WITH {_XY}, p AS (SELECT *, ln(0.7) - 0.5 * ((a - 1.5) ** 2 / 0.5 + (b + 2) ** 2 / 4 + ln(2.0)) AS p, ln(0.3) - 0.5 * ((a - 4) ** 2 + (b - 3) ** 2 / 2 + ln(2.0)) AS q FROM x)
    SELECT l_orderkey, l_linenumber, CASE WHEN q > p THEN 1 ELSE 0 END AS component, 1 / (1 + exp(least(p, q) - greatest(p, q))) AS probability FROM p""",
    rounded=("probability",), digits=9,
)
def _labels(spark, sf):
    """The likelier of two given components."""
    given = M.Mixture(["a", "b"], np.array([0.7, 0.3]), np.array([[1.5, -2.0], [4.0, 3.0]]), np.array([[[0.5, 0], [0, 4.0]], [[1.0, 0], [0, 2.0]]]), 0.0, 0, 0, True)
    return given.transform(_pairs(spark, sf).drop("x")).select("l_orderkey", "l_linenumber", "component", "probability")
