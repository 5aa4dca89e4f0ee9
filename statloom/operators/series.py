"""Time series: one series is one group; order is explicit.

Everything with a bounded look-back is a window.  Recursions over a whole series
run once per series in ``applyInPandas``; a series is one group's rows, so a
single endless series belongs into the streaming module instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .descriptive import beside, observed


def _by(series: list[str], t: str):
    return Window.partitionBy(*series).orderBy(t)


def moving_average(df: DataFrame, x: str, t: str, series: list[str], width: int, name: str = "average", weighted: bool = False) -> DataFrame:
    """Trailing means of ``width`` rows (weights 1..width with ``weighted``); a series' first width - 1 rows are left out."""
    if width < 1:
        raise ValueError("width must be positive")
    w = _by(series, t)
    if weighted:
        total = sum((F.lag(observed(x), k).over(w) * (width - k) for k in range(width)), F.lit(0.0))
        value = total / (width * (width + 1) / 2)
    else:
        value = F.avg(observed(x)).over(w.rowsBetween(-(width - 1), 0))
    return df.withColumns({"__i": F.row_number().over(w), name: value}).where(F.col("__i") >= width).drop("__i")


def difference(df: DataFrame, x: str, t: str, series: list[str], d: int = 1, name: str = "difference") -> DataFrame:
    """The d-fold first difference, by binomial weights of d lags in one window."""
    w = _by(series, t)
    c, total = 1.0, F.lit(0.0)
    for k in range(d + 1):
        total = total + F.lag(observed(x), k).over(w) * c
        c = -c * (d - k) / (k + 1)
    return df.withColumn(name, total).where(F.col(name).isNotNull())


def autocorrelation(df: DataFrame, x: str, t: str, series: list[str], lags: int) -> DataFrame:
    """Per series and lag: autocovariance over n, and autocorrelation, in one window and one aggregate."""
    rows = df.select(*series, F.col(t).alias("__t"), observed(x).alias("__x"))
    rows = beside(rows, rows.groupBy(*series).agg(F.avg("__x").alias("__m")), list(series))
    rows = rows.withColumn("__d", F.col("__x") - F.col("__m"))
    w = _by(series, "__t")
    products = [F.col("__d") * (F.lag("__d", k).over(w) if k else F.col("__d")) for k in range(lags + 1)]
    rows = rows.select(*series, *[p.alias(f"__p{k}") for k, p in enumerate(products)])
    sums = rows.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__p{k}").alias(f"__s{k}") for k in range(lags + 1)])
    out = sums.select(*series, "n", F.posexplode(F.array(*[F.col(f"__s{k}") for k in range(lags + 1)])).alias("lag", "__c"), F.col("__s0").alias("__v"))
    return out.select(*series, "lag", "n", (F.coalesce("__c", F.lit(0.0)) / F.col("n")).alias("autocovariance"), F.when(F.col("__v") > 0, F.coalesce("__c", F.lit(0.0)) / F.col("__v")).alias("autocorrelation"), (1.96 / F.sqrt("n")).alias("bound"))


def partial_autocorrelation(acf: DataFrame, series: list[str]) -> DataFrame:
    """Durbin-Levinson on the lags of each series (as many numbers as lags)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        r = g.sort_values("lag")["autocorrelation"].to_numpy()
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            top = r[k] - phi @ r[k - 1 : 0 : -1]
            low = 1 - phi @ r[1:k]
            last = top / low if abs(low) > 1e-15 else 0.0
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        keys = {c: [g[c].iloc[0]] * len(out) for c in series}
        return pd.DataFrame({**keys, "lag": range(len(out)), "partial": out})

    kinds = dict(acf.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in series), "lag int", "partial double"])
    return acf.groupBy(*series).applyInPandas(run, schema)


def seasonal_decompose(df: DataFrame, x: str, t: str, series: list[str], period: int) -> DataFrame:
    """Adds trend (centred mean, null at the ends), seasonal and residual of an additive decomposition."""
    if period < 2:
        raise ValueError("period must be at least 2")
    w, half = _by(series, t), period // 2
    v = observed(x)
    whole = F.sum(v).over(w.rowsBetween(-half, half))
    if period % 2:
        mid = whole / period
    else:
        mid = (whole - (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2) / period
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*series))})
    inside = (F.col("__i") >= half) & (F.col("__i") < F.col("__n") - half)
    rows = rows.withColumns({"trend": F.when(inside, mid), "__k": F.col("__i") % period})
    keys = [*series, "__k"]
    season = rows.groupBy(*keys).agg(F.coalesce(F.avg(v - F.col("trend")), F.lit(0.0)).alias("__s"))
    season = beside(season, season.groupBy(*series).agg(F.avg("__s").alias("__a")), list(series))
    season = season.select(*keys, (F.col("__s") - F.col("__a")).alias("seasonal"))
    rows = beside(rows, season, keys)
    return rows.withColumn("residual", v - F.col("trend") - F.col("seasonal")).drop("__i", "__n", "__k")


def cusum(df: DataFrame, x: str, t: str, series: list[str]) -> DataFrame:
    """Per series: the largest cumulated deviation over sd * sqrt(n), and where it is."""
    rows = df.select(*series, F.col(t).alias("t"), observed(x).alias("x")).where("x is not null")
    s = rows.groupBy(*series).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count(F.lit(1)).alias("n"))
    rows = beside(rows, s, list(series))
    rows = rows.withColumn("c", F.abs(F.sum(F.col("x") - F.col("m")).over(_by(series, "t"))) / (F.col("s") * F.sqrt("n")))
    return rows.groupBy(*series).agg(F.max("c").alias("statistic"), F.max_by("t", "c").alias("at"))


def _per_series(df: DataFrame, x: str, t: str, series: list[str], fields: str, run) -> DataFrame:
    """Runs a recursion over each series in order; run(values) gives a dict of columns as long as the values."""
    rows = df.select(*series, F.col(t).alias("t"), observed(x).alias("x"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in series), f"t {kinds['t']}", "x double", fields])

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        return g.assign(**run(g["x"].to_numpy()))

    return rows.groupBy(*series).applyInPandas(one, schema)


def exponential_average(df: DataFrame, x: str, t: str, series: list[str], alpha: float) -> DataFrame:
    """s[0] = x[0], then alpha * x + (1 - alpha) * s."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return _per_series(df, x, t, series, "average double", lambda v: {"average": pd.Series(v).ewm(alpha=alpha, adjust=False).mean().to_numpy()})


def holt(df: DataFrame, x: str, t: str, series: list[str], alpha: float, beta: float) -> DataFrame:
    """Level and trend by Holt's linear recursion, and the one-step fit."""

    def run(v: np.ndarray) -> dict:
        level, trend, fit = np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v))
        for i, y in enumerate(v):
            if i == 0:
                level[0], trend[0], fit[0] = y, v[1] - y if len(v) > 1 else 0.0, y
                continue
            fit[i] = level[i - 1] + trend[i - 1]
            level[i] = alpha * y + (1 - alpha) * fit[i]
            trend[i] = beta * (level[i] - level[i - 1]) + (1 - beta) * trend[i - 1]
        return {"level": level, "trend": trend, "fitted": fit}

    return _per_series(df, x, t, series, "level double, trend double, fitted double", run)


def local_level(df: DataFrame, x: str, t: str, series: list[str], q: float, r: float) -> DataFrame:
    """Kalman filter of a random walk seen with noise: filtered state and variance; missing values only predict."""

    def run(v: np.ndarray) -> dict:
        state, var = np.zeros(len(v)), np.zeros(len(v))
        m, p = 0.0, 1e7
        for i, y in enumerate(v):
            p += q
            if np.isfinite(y):
                k = p / (p + r)
                m, p = m + k * (y - m), (1 - k) * p
            state[i], var[i] = m, p
        return {"state": state, "variance": var}

    return _per_series(df, x, t, series, "state double, variance double", run)


def segment_cost(v: np.ndarray, kind: str = "error"):
    """cost(a, b) of the pieces a to b (arrays or numbers) of a series, from running sums about its mean.

    ``error``: squared error about the piece's mean; with n values of a piece,
    ``mean``: n ln(variance); ``variance``: n ln(mean square about the series'
    mean); ``mean_variance``: n (ln(2 pi variance) + 1).
    """
    c = v - v.mean() if len(v) else v
    s1, s2 = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(c * c))

    def cost(a, b):
        n, square = b - a, s2[b] - s2[a]
        error = np.maximum(square - (s1[b] - s1[a]) ** 2 / n, 0)
        if kind == "error":
            return error
        spread = np.log(np.maximum((square if kind == "variance" else error) / n, 1e-12))
        return n * (spread + 1 + np.log(2 * np.pi)) if kind == "mean_variance" else n * spread

    if kind not in ("error", "mean", "variance", "mean_variance"):
        raise ValueError(f"no cost {kind!r}")
    return cost


def cut_penalty(v: np.ndarray, kind: str, penalty: float | None) -> float:
    """A given penalty, or twice the log of the length (times the variance for squared errors, times the parameters else)."""
    if penalty is not None:
        return penalty
    base = np.log(max(len(v), 2))
    return 2 * base * max(np.var(v), 1e-12) if kind == "error" and len(v) else base * (2 if kind == "mean_variance" else 1)


def piecewise(v: np.ndarray, cut) -> np.ndarray:
    """Segment numbers of a series from the cuts of its known values; a missing value joins the one before it."""
    known = np.isfinite(v)
    segment = np.zeros(len(v), int)
    cuts = np.sort(np.asarray(cut(v[known]), int))
    place = np.maximum(np.cumsum(known) - 1, 0)
    return np.searchsorted(cuts, place, side="right").astype(int) if len(cuts) else segment


def mean_changepoints(df: DataFrame, x: str, t: str, series: list[str], penalty: float | None = None, least: int = 2, cost: str = "error") -> DataFrame:
    """Adds segment: the piece of a series' optimal partition under a ``segment_cost`` (pruned dynamic program)."""

    def cuts(v: np.ndarray) -> list[int]:
        n, price, pen = len(v), segment_cost(v, cost), cut_penalty(v, cost, penalty)
        if n < 2 * least:
            return []
        best, prior, open_ = np.append(-pen, np.full(n, np.inf)), np.zeros(n + 1, int), np.array([0])
        until = np.full(n + 1, n + 1)  # a start that loses to a cut here can still win till that cut's piece is long enough
        for e in range(least, n + 1):
            open_ = open_[until[open_] > e]
            s = open_[open_ <= e - least]
            total = best[s] + price(s, e)
            k = int(np.argmin(total))
            best[e], prior[e] = total[k] + pen, s[k]
            late = s[total > best[e]]
            until[late] = np.minimum(until[late], e + least)
            open_ = np.append(open_, e)
        found, e = [], n
        while e > 0:
            e = int(prior[e])
            found.append(e)
        return found[:-1]

    return _per_series(df, x, t, series, "segment int", lambda v: {"segment": piecewise(v, cuts)})


def ljung_box(acf: DataFrame, series: list[str]) -> DataFrame:
    """Ljung-Box statistic over the lags of ``autocorrelation``, with its p-value."""
    from ..functions import special

    r, n, k = F.col("autocorrelation"), F.col("n"), F.col("lag")
    s = acf.where("lag > 0").groupBy(*series).agg(F.sum(n * (n + 2) * r * r / (n - k)).alias("statistic"), F.max("lag").cast("double").alias("df"))
    return s.withColumn("p_value", special.column("chi2_sf", F.col("statistic"), F.col("df")))


def lagged(df: DataFrame, columns: list[str], t: str, series: list[str], lags: int) -> DataFrame:
    """Adds <column>_<k> for each lag: the design of vector autoregressions; incomplete rows are left out."""
    w = _by(series, t)
    new = {f"{c}_{k}": F.lag(observed(c), k).over(w) for c in columns for k in range(1, lags + 1)}
    return df.withColumns(new).dropna(subset=list(new))


def granger(df: DataFrame, cause: str, effect: str, t: str, series: list[str], lags: int) -> DataFrame:
    """F test that the cause's lags add to the effect's own: both fits from the lag columns' products."""
    from ..functions import special
    from .regression import ordinary

    rows = lagged(df, [cause, effect], t, series, lags)
    own = [f"{effect}_{k}" for k in range(1, lags + 1)]
    small, large = ordinary(rows, own, effect), ordinary(rows, own + [f"{cause}_{k}" for k in range(1, lags + 1)], effect)
    free = large.n - 2 * lags - 1
    f = float((small.stats["rss"] - large.stats["rss"]) / lags / (large.stats["rss"] / free))
    return df.sparkSession.createDataFrame([(f, float(lags), float(free), float(special.f_sf(f, lags, free)))], "statistic double, df1 double, df2 double, p_value double")


def unit_root(df: DataFrame, x: str, t: str, series: list[str], lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t ratio with a constant, over all series with common coefficients."""
    from .regression import ordinary

    w = _by(series, t)
    rows = df.withColumns({"__d": observed(x) - F.lag(observed(x)).over(w), "__l": F.lag(observed(x)).over(w)}).dropna(subset=["__d", "__l"])
    rows = lagged(rows, ["__d"], t, series, lags)
    model = ordinary(rows, ["__l", *[f"__d_{k}" for k in range(1, lags + 1)]], "__d")
    tau = float(model.coefficients[1] / model.se[1])
    return df.sparkSession.createDataFrame([(tau, lags, model.n, bool(tau < -2.86))], "statistic double, lags int, n long, stationary boolean")
