"""Sensitivity of a model to its inputs, and low-discrepancy designs.

A model is a function from a list of input columns (each uniform in 0..1) to a
column, so its runs are expressions over a table of design points, and every
index is one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import uniform
from ..plans.order import with_row_index

#: The first primes, bases of Halton sequences.
def primes(n: int) -> list[int]:
    """The first n primes, by trial division."""
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out

Model = Callable[[list[Column]], Column]


def radical_inverse(index: Column, base: int, digits: int = 0) -> Column:
    """The digits of a whole number in a base, mirrored at the point."""
    digits = digits or math.ceil(62 / math.log2(base))
    step = lambda a, k: F.struct(F.floor(a["rest"] / base).cast("long").alias("rest"), (a["out"] + (a["rest"] % base) * F.pow(F.lit(float(base)), -k.cast("double"))).alias("out"))
    start = F.struct(index.cast("long").alias("rest"), F.lit(0.0).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda a: a["out"])


def halton(spark: SparkSession, dimensions: int, n: int, skip: int = 0) -> DataFrame:
    """Rows (i, x1, x2, ...) of a Halton sequence; i starts at skip + 1."""
    rows = spark.range(skip + 1, skip + n + 1).select(F.col("id").alias("i"))
    digits = max(1, (skip + n).bit_length())
    return rows.select("i", *[radical_inverse(F.col("i"), b, math.ceil(digits / math.log2(b)) + 1).alias(f"x{k + 1}") for k, b in enumerate(primes(dimensions))])


def latin_hypercube(spark: SparkSession, dimensions: int, n: int, seed: int = 0) -> DataFrame:
    """Rows (i, x1, x2, ...): in each dimension every n-th of 0..1 has one point, in an order by hash."""
    out = spark.range(n).select(F.col("id").alias("i"))
    for k in range(dimensions):
        place = with_row_index(spark.range(n).select(F.col("id").alias("i")), F.xxhash64(F.lit(seed), F.lit(k), F.col("i")), "i", name="place")
        out = out.join(place.select("i", ((F.col("place") + uniform(F.col("i"), seed * 1009 + k + 1)) / n).alias(f"x{k + 1}")), "i")
    return out


def _inputs(spark: SparkSession, n: int, dimensions: int, seed: int, names: str) -> DataFrame:
    rows = spark.range(n)
    return rows.select("id", *[uniform(F.col("id"), seed * 7919 + 101 * k + ord(m)).alias(f"{m}{k}") for m in names for k in range(dimensions)])


def sobol_indices(spark: SparkSession, model: Model, dimensions: int, n: int = 10_000, seed: int = 42) -> DataFrame:
    """First-order and total indices of each input: two designs, and mixtures that swap one column."""
    rows = _inputs(spark, n, dimensions, seed, "ab")
    a, b = ([F.col(f"{m}{k}") for k in range(dimensions)] for m in "ab")
    rows = rows.select(model(a).alias("fa"), model(b).alias("fb"), *[model([b[j] if j == k else a[j] for j in range(dimensions)]).alias(f"m{k}") for k in range(dimensions)])
    mean = rows.agg(F.avg((F.col("fa") + F.col("fb")) / 2).alias("m")).first()["m"]
    fa, fb = F.col("fa") - float(mean), F.col("fb") - float(mean)
    cells = [F.struct(F.lit(k).alias("input"), F.avg(fb * (F.col(f"m{k}") - F.col("fa"))).alias("first"), (F.avg(F.pow(F.col("fa") - F.col(f"m{k}"), 2)) / 2).alias("total")) for k in range(dimensions)]
    one = rows.agg(F.array(*cells).alias("c"), F.avg((fa * fa + fb * fb) / 2).alias("v"))
    return one.select(F.explode("c").alias("c"), "v").select("c.input", (F.col("c.first") / F.col("v")).alias("first"), (F.col("c.total") / F.col("v")).alias("total"))


def morris(spark: SparkSession, model: Model, dimensions: int, n: int = 1000, step: float = 0.5, seed: int = 42) -> DataFrame:
    """Elementary effects of each input around random points: mean, mean of sizes, sd."""
    rows = _inputs(spark, n, dimensions, seed, "a")
    base = [F.col(f"a{k}") * (1 - step) for k in range(dimensions)]
    effects = [((model([x + step if j == k else x for j, x in enumerate(base)]) - model(base)) / step).alias(f"e{k}") for k in range(dimensions)]
    cells = [F.struct(F.lit(k).alias("input"), F.avg(f"e{k}").alias("mean"), F.avg(F.abs(f"e{k}")).alias("size"), F.stddev_samp(f"e{k}").alias("sd")) for k in range(dimensions)]
    return rows.select(*effects).agg(F.array(*cells).alias("c")).select(F.inline("c"))


def fourier_indices(spark: SparkSession, model: Model, dimensions: int, harmonics: int = 4) -> DataFrame:
    """First-order indices by a search curve on which each input has its own frequency (FAST)."""
    top = 2 * harmonics * max(8, dimensions) + 1
    frequencies = [top * (2 * k + 3) // 2 | 1 for k in range(dimensions)]
    n = 2 * harmonics * max(frequencies) + 1
    s = (2 * math.pi * F.col("id") + math.pi) / n - math.pi
    rows = spark.range(n).select(s.alias("s"), model([0.5 + F.asin(F.sin(w * s)) / math.pi for w in frequencies]).alias("f"))
    power = lambda w: F.pow(F.avg(F.col("f") * F.cos(w * F.col("s"))), 2) + F.pow(F.avg(F.col("f") * F.sin(w * F.col("s"))), 2)
    cells = [F.struct(F.lit(k).alias("input"), (2 * sum((power(w * h) for h in range(2, harmonics + 1)), power(w))).alias("p")) for k, w in enumerate(frequencies)]
    one = rows.agg(F.array(*cells).alias("c"), F.var_pop("f").alias("v"))
    return one.select(F.explode("c").alias("c"), "v").select("c.input", (F.col("c.p") / F.col("v")).alias("first"))


def correlation_screening(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Pearson and partial correlation of each feature with y, and its rank by size."""
    import numpy as np

    from ..plans.gram import centred
    from .regression import complete

    _, _, s = centred(complete(df, [*features, y]), [*features, y])
    d = np.sqrt(np.diag(s))
    r, inverse = s / np.outer(d, d), np.linalg.inv(s)
    partial = -inverse[:-1, -1] / np.sqrt(np.diag(inverse)[:-1] * inverse[-1, -1])
    order = np.argsort(np.argsort(-np.abs(r[:-1, -1]), kind="stable"), kind="stable") + 1
    rows = [(f, float(a), float(b), int(k)) for f, a, b, k in zip(features, r[:-1, -1], partial, order, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, pearson double, partial double, place int")
