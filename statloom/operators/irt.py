"""Item response models as columns, and abilities by quadrature.

An item has discrimination ``a``, difficulty ``b`` and guessing ``c``; the
two-parameter model has c = 0, the Rasch model a = 1 as well.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def probability(theta, b, a=1.0, c=0.0) -> Column:
    """The chance of a right answer at an ability."""
    theta, a, b, c = map(_c, (theta, a, b, c))
    return c + (1 - c) / (1 + F.exp(-a * (theta - b)))


def information(theta, b, a=1.0, c=0.0) -> Column:
    """Fisher's information of an item at an ability."""
    p, a, c = probability(theta, b, a, c), _c(a), _c(c)
    return a * a * F.pow((p - c) / (1 - c), 2) * (1 - p) / p


def graded_probabilities(theta, a, thresholds: Column) -> Column:
    """The chances of the categories of a graded item with ascending thresholds (an array)."""
    theta, a = _c(theta), _c(a)
    above = F.transform(thresholds, lambda b: 1 / (1 + F.exp(-a * (theta - b))))
    return F.zip_with(F.concat(F.array(F.lit(1.0)), above), F.concat(above, F.array(F.lit(0.0))), lambda x, y: x - y)


def curve(items: DataFrame, low: float = -4.0, high: float = 4.0, points: int = 81) -> DataFrame:
    """The items (with a, b, c) at a grid of abilities: theta, probability, information."""
    step = (high - low) / (points - 1)
    grid = items.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(low) + k * step)))
    return grid.withColumns({"probability": probability("theta", "b", "a", "c"), "information": information("theta", "b", "a", "c")})


def test_information(items: DataFrame, low: float = -4.0, high: float = 4.0, points: int = 81) -> DataFrame:
    """The information of all items together at a grid of abilities."""
    return curve(items, low, high, points).groupBy("theta").agg(F.sum("information").alias("information"))


def abilities(responses: DataFrame, items: DataFrame, person: str, item: str, right: str, nodes: int = 21) -> DataFrame:
    """Expected ability and its sd for each person, under a standard normal prior.

    ``items`` has the item's key, a, b and c.  The log-likelihood at each
    quadrature node is one sum, so a person's answers are never gathered.
    """
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    rows = responses.where(F.col(right).isNotNull()).select(person, item, F.col(right).cast("double").alias("__y")).join(items.select(item, "a", "b", "c"), item)

    def term(t: float) -> Column:
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), probability(t, "b", "a", "c")))
        return F.when(F.col("__y") > 0.5, F.ln(p)).otherwise(F.ln(1 - p))

    sums = rows.groupBy(person).agg(*[F.sum(term(float(t))).alias(f"l{k}") for k, t in enumerate(x)], F.count(F.lit(1)).alias("n"))
    top = F.greatest(*[F.col(f"l{k}") for k in range(nodes)])
    mass = [float(w[k]) * F.exp(F.col(f"l{k}") - top) for k in range(nodes)]
    total = sum(mass[1:], mass[0])
    mean = sum((float(x[k]) * mass[k] for k in range(1, nodes)), float(x[0]) * mass[0]) / total
    square = sum((float(x[k] ** 2) * mass[k] for k in range(1, nodes)), float(x[0] ** 2) * mass[0]) / total
    return sums.select(person, "n", mean.alias("theta"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sd"))


def rasch(spark: SparkSession, difficulties: list[float]) -> DataFrame:
    """Items 0, 1, ... of the Rasch model."""
    return spark.createDataFrame([(k, 1.0, float(b), 0.0) for k, b in enumerate(difficulties)], "item int, a double, b double, c double")
