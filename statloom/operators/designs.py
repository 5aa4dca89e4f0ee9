"""Experimental designs and their analysis of variance."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from .descriptive import beside, observed
from .regression import LinearModel, ordinary


def full_factorial(spark: SparkSession, levels: dict[str, list[float]]) -> DataFrame:
    """All combinations of the factors' levels."""
    out = spark.range(1).drop("id").select(F.lit(1).alias("__one"))
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out.drop("__one")


def latin_square(spark: SparkSession, n: int) -> DataFrame:
    """Rows (row, column, treatment) of the cyclic square."""
    grid = spark.range(n).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("column"))
    return grid.withColumn("treatment", ((F.col("row") + F.col("column")) % n).cast("int"))


def central_composite(spark: SparkSession, k: int, alpha: float | None = None, centres: int = 3) -> DataFrame:
    """Corners, axial points at ``alpha`` (default: the fourth root of the number of corners) and centre points of k factors."""
    if not 2 <= k <= 5:
        raise ValueError("two to five factors")
    alpha = alpha or (2.0**k) ** 0.25
    rows = [("corner", *map(float, x)) for x in itertools.product((-1, 1), repeat=k)]
    rows += [("axial", *[s * alpha if i == j else 0.0 for i in range(k)]) for j in range(k) for s in (-1, 1)]
    rows += [("centre", *[0.0] * k)] * centres
    return spark.createDataFrame(rows, "kind string, " + ", ".join(f"x{i + 1} double" for i in range(k)))


def additive_anova(df: DataFrame, y: str, factors: list[str], interactions: list[tuple[str, str]] = ()) -> DataFrame:
    """Sums of squares of factors and pairs of them in a balanced design, with the rest as the error.

    Blocks and treatments, the rows, columns and treatments of a Latin square,
    and factorials are all cases of it.  One pass sums every grouping; columns:
    source, ss, df, ms, statistic, p_value.
    """
    keys = ["+".join(x) for x in [*[(f,) for f in factors], *interactions]]
    sets = [*[(f,) for f in factors], *interactions]
    rows = df.select(*factors, observed(y).alias("__y")).dropna()
    labels = [F.struct(F.lit(k).alias("source"), F.concat_ws("\x1f", *[F.col(c).cast("string") for c in s]).alias("level")) for k, s in zip(keys, sets, strict=True)]
    labels.append(F.struct(F.lit("total").alias("source"), F.lit("").alias("level")))
    cells = rows.select("__y", F.inline(F.array(*labels))).groupBy("source", "level").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("__y").alias("s"), F.var_pop("__y").alias("v"))
    whole = cells.where("source = 'total'").select((F.col("s") / F.col("n")).alias("gm"), F.col("n").alias("all"), (F.col("v") * F.col("n")).alias("sst"))
    own = beside(cells.where("source != 'total'"), whole, []).groupBy("source").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("gm"), 2)).alias("ss"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    found = {r["source"]: (r["ss"], r["df"]) for r in own.collect()}  # one row for each source
    total = whole.first()
    for k, s in zip(keys, sets, strict=True):
        if len(s) == 2 and k in found:  # a pair's cells hold both factors' effects as well
            found[k] = (max(0.0, found[k][0] - found[s[0]][0] - found[s[1]][0]), found[k][1] - found[s[0]][1] - found[s[1]][1])
    if not found:
        raise ValueError("no complete rows")
    ss = max(0.0, total["sst"] - sum(x[0] for x in found.values()))
    free = total["all"] - 1 - sum(x[1] for x in found.values())
    out = []
    for k in keys:
        s, d = found[k]
        f = s / d / (ss / free) if d and free > 0 and ss > 0 else None
        out.append((k, float(s), float(d), float(s / d) if d else None, f, float(special.f_sf(f, d, free)) if f is not None else None))
    out += [("error", float(ss), float(free), ss / free if free > 0 else None, None, None), ("total", float(total["sst"]), float(total["all"] - 1), None, None, None)]
    return df.sparkSession.createDataFrame(out, "source string, ss double, df double, ms double, statistic double, p_value double")


def factor_effects(df: DataFrame, y: str, factors: list[str]) -> DataFrame:
    """The mean at each factor's highest level less that at its lowest."""
    rows = df.select(*factors, observed(y).alias("__y")).dropna()
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("level")) for f in factors])
    means = rows.select("__y", F.inline(pairs)).groupBy("factor", "level").agg(F.avg("__y").alias("m"))
    return means.groupBy("factor").agg((F.max_by("m", "level") - F.min_by("m", "level")).alias("effect"))


def response_surface(df: DataFrame, factors: list[str], y: str) -> tuple[LinearModel, np.ndarray]:
    """A full quadratic model and its stationary point."""
    pairs = list(itertools.combinations(factors, 2))
    rows = df.select(*[observed(f).alias(f) for f in factors], observed(y).alias(y))
    squares, crossed = [f"{f}^2" for f in factors], [f"{a}*{b}" for a, b in pairs]
    rows = rows.withColumns({f"{f}^2": F.col(f) * F.col(f) for f in factors} | {f"{a}*{b}": F.col(a) * F.col(b) for a, b in pairs})
    model = ordinary(rows, [*factors, *squares, *crossed], y)
    k = len(factors)
    b = model.coefficients[1:]
    shape = np.diag(b[k : 2 * k])
    for (p, q), v in zip(pairs, b[2 * k :], strict=True):
        i, j = factors.index(p), factors.index(q)
        shape[i, j] = shape[j, i] = v / 2
    return model, np.linalg.solve(-2 * shape, b[:k])
