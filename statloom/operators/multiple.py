"""Adjusted p-values for many tests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.order import running, with_row_index
from .descriptive import beside

METHODS = ("bonferroni", "sidak", "holm", "hochberg", "benjamini_hochberg", "benjamini_yekutieli")


def adjust(df: DataFrame, p: str, method: str, alpha: float = 0.05, name: str = "adjusted") -> DataFrame:
    """Adds the adjusted p-value and whether it is at most alpha (rejected).

    The stepwise methods need a global order: rows are sorted by range, and
    running extremes are folded block by block.  Null p-values stay null and
    don't count as tests.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    rows = df.where(F.col(p).isNotNull())
    m = rows.agg(F.count(F.lit(1)).cast("double").alias("__m"), F.sum(F.lit(0.0)).alias("__z"))
    if method in ("bonferroni", "sidak"):
        out = beside(df, m, [])
        v = F.col(p) * F.col("__m") if method == "bonferroni" else 1 - F.pow(1 - F.col(p), F.col("__m"))
    else:
        count = rows.count()
        out = with_row_index(rows, p, name="__i").withColumn("__m", F.lit(float(count)))
        rank = F.col("__i") + 1
        if method in ("holm", "hochberg"):
            step = F.col(p) * (F.col("__m") - F.col("__i"))
        else:
            harmonic = 1.0 if method == "benjamini_hochberg" else df.sparkSession.range(1, count + 1).agg(F.sum(1 / F.col("id"))).first()[0] or 1.0
            step = F.col(p) * F.col("__m") * harmonic / rank
        out = out.withColumn("__s", step)
        out = running(out, "__i", "__s", "__v", "max") if method == "holm" else running(out, "__i", "__s", "__v", "min", backward=True)
        v = F.col("__v")
    adjusted = F.least(F.lit(1.0), v)
    done = out.select(*df.columns, F.when(F.col(p).isNotNull(), adjusted).alias(name))
    if method not in ("bonferroni", "sidak"):
        done = done.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))
    return done.withColumn("rejected", F.col(name) <= alpha)
