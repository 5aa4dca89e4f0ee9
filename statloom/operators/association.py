"""Correlation by moments, by ranks and by concordance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import staged, with_average_rank
from .descriptive import observed


def _finish(s: DataFrame) -> DataFrame:
    """Adds t and the p-value to rows with n and r."""
    r, free = F.col("r"), (F.col("n") - 2).cast("double")
    t = F.when(F.abs(r) < 1, r * F.sqrt(free / (1 - r * r)))
    return s.withColumn("p_value", F.when(F.abs(r) >= 1, 0.0).when(F.col("n") > 2, special.column("t_two_sided", t, free)))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """n, r and p_value; r is null without spread."""
    u, v = observed(x), observed(y)
    full = df.where(u.isNotNull() & v.isNotNull())
    return _finish(full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(u, v).alias("r")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks, which come from counts of different values."""
    rows = df.select(observed(x).alias("x"), observed(y).alias("y")).dropna()
    rows = with_average_rank(with_average_rank(rows, "x", "rx"), "y", "ry")
    return _finish(rows.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("r")))


def _later_pairs(y: np.ndarray, c: np.ndarray) -> tuple[float, float]:
    """(pairs that rise, pairs that fall) among weighted values in order; merges halves bottom up."""
    up = down = 0.0
    n, width = len(y), 1
    while width < n:
        for i in range(0, n - width, 2 * width):
            a, b = y[i : i + width], y[i + width : i + 2 * width]
            wa = np.append(0.0, np.cumsum(c[i : i + width]))
            wb = c[i + width : i + 2 * width]
            lo, hi = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
            up += float(wb @ wa[lo])
            down += float(wb @ (wa[-1] - wa[hi]))
            order = np.argsort(y[i : i + 2 * width], kind="stable")
            y[i : i + 2 * width] = y[i : i + 2 * width][order]
            c[i : i + 2 * width] = c[i : i + 2 * width][order]
        width *= 2
    return up, down


def _within(first: str, second: str, skip: str | None):
    """Concordant minus discordant pairs of one bucket, ties in ``first`` left out.

    With ``skip``, pairs of one bucket of the other axis are left out too: the
    whole bucket's score less that of each sub-bucket.
    """

    def score(t: pd.DataFrame) -> float:
        t = t.sort_values([first, second], kind="stable")
        x, y, c = (t[k].to_numpy(float).copy() for k in (first, second, "c"))
        up, down = _later_pairs(y, c)
        total = up - down
        # rows of equal first are in rising order of second: those rises don't count
        start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        c, y = t["c"].to_numpy(float), t[second].to_numpy(float)
        for a, b in zip(start, [*start[1:], len(x)], strict=True):
            if b - a > 1:
                w = c[a:b]
                same = np.bincount(np.unique(y[a:b], return_inverse=True)[1], weights=w)
                total -= (w.sum() ** 2 - (same**2).sum()) / 2
        return total

    def run(t: pd.DataFrame) -> pd.DataFrame:
        s = score(t)
        if skip:
            s -= sum(score(g) for _, g in t.groupby(skip))
        return pd.DataFrame({"s": [s]})

    return run


def kendall(df: DataFrame, x: str, y: str, buckets: int = 256) -> DataFrame:
    """Kendall's tau-b, z (variance without ties) and p_value, without comparing all pairs.

    Both axes are cut into buckets at quantiles.  Pairs of different buckets on
    both axes come from cumulated counts of the bucket grid; pairs within a
    bucket of either axis are counted by merge sort in that bucket's task.  Equal
    pairs of values are one weighted row, and a bucket of a single value on its
    axis has no pairs to count, so a hot value needs no large task.
    """
    rows = df.select(observed(x).alias("x"), observed(y).alias("y")).dropna()
    rows = staged(rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "pairs")
    n = rows.agg(F.sum("c")).first()[0] or 0
    if n < 2:
        return df.sparkSession.createDataFrame([(n, None, None, None)], "n long, tau double, z double, p_value double")
    cuts = [k / buckets for k in range(1, buckets)]

    def bucket(v: str) -> Column:
        edges = sorted(set(rows.approxQuantile(v, cuts, 0.25 / buckets)))  # at most ``buckets`` numbers
        return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(v))) if len(edges) > 1 else F.lit(0)

    rows = staged(rows.withColumns({"bx": bucket("x"), "by": bucket("y")}), "bucketed")
    grid = np.zeros((buckets + 1, buckets + 1))
    for r in rows.groupBy("bx", "by").agg(F.sum("c").alias("c")).collect():  # at most buckets ** 2 numbers
        grid[r["bx"], r["by"]] = r["c"]
    below = np.cumsum(np.cumsum(grid, 0), 1)
    pad = np.pad(below, ((1, 0), (1, 0)))
    rise = pad[:-1, :-1]  # less in both
    fall = pad[:-1, -1:] - pad[:-1, 1:]  # less in x, more in y
    score = float((grid * (rise - fall)).sum())
    wide_x = rows.groupBy("bx").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("bx")
    wide_y = rows.groupBy("by").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo < hi").select("by")
    parts = rows.join(F.broadcast(wide_x), "bx").groupBy("bx").applyInPandas(_within("x", "y", None), "s double")
    parts = parts.unionByName(rows.join(F.broadcast(wide_y), "by").groupBy("by").applyInPandas(_within("y", "x", "bx"), "s double"))
    score += parts.agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
    pairs = n * (n - 1) / 2

    def ties(v: str) -> float:
        c = F.col("c").cast("double")
        return rows.groupBy(v).agg(F.sum("c").alias("c")).agg(F.sum(c * (c - 1) / 2)).first()[0]

    size = float(np.sqrt((pairs - ties("x")) * (pairs - ties("y"))))
    tau = score / size if size else None
    z = 3 * tau * float(np.sqrt(n * (n - 1))) / float(np.sqrt(2 * (2 * n + 5))) if tau is not None else None
    p = float(special.normal_two_sided(z)) if z is not None else None
    return df.sparkSession.createDataFrame([(n, tau, z, p)], "n long, tau double, z double, p_value double")
