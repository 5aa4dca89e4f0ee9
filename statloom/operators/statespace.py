"""Models of one series at a time: state space, autoregressions, volatility, smoothing, changepoints.

A recursion needs its series in order, so each series is one group of a pandas
function; many series spread over all executors.  Values that are missing only
predict in the state-space filters and are dropped elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import arma
from .descriptive import observed
from .series import _per_series, cut_penalty, piecewise, segment_cost


def _each(df: DataFrame, x: str, t: str, series: list[str], fields: str, run) -> DataFrame:
    """run(values) gives the rows of a series as a dict of columns, of any length."""
    rows = df.select(*series, F.col(t).alias("__t"), observed(x).alias("__x"))
    kinds = dict(rows.dtypes)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run(g.sort_values("__t", kind="stable")["__x"].to_numpy()))
        for c in reversed(series):
            out.insert(0, c, g[c].iloc[0])
        return out

    return rows.groupBy(*series).applyInPandas(one, ", ".join([*(f"`{c}` {kinds[c]}" for c in series), fields]))


def _filter(v, transition, observe, q, r):
    """Filtered and predicted means and covariances, and the log-likelihood, of a model with one observed value."""
    k = len(transition)
    m, p, ll = np.zeros(k), np.eye(k) * 1e7, 0.0
    out = []
    for y in v:
        pm, pp = transition @ m, transition @ p @ transition.T + q
        m, p = pm, pp
        if np.isfinite(y):
            s = float(observe @ pp @ observe + r)
            gain = pp @ observe / s
            e = y - float(observe @ pm)
            m, p = pm + gain * e, pp - np.outer(gain, observe @ pp)
            ll -= 0.5 * (np.log(2 * np.pi * s) + e * e / s)
        out.append((m, p, pm, pp))
    return out, ll


def _smooth(steps, transition):
    """Backward means, covariances and gains (Rauch, Tung and Striebel)."""
    ms, ps, gains = [steps[-1][0]], [steps[-1][1]], []
    for (m, p, _, _), (_, _, pm, pp) in zip(steps[-2::-1], steps[:0:-1], strict=True):
        gain = p @ transition.T @ np.linalg.pinv(pp)
        ms.append(m + gain @ (ms[-1] - pm))
        ps.append(p + gain @ (ps[-1] - pp) @ gain.T)
        gains.append(gain)
    return ms[::-1], ps[::-1], gains[::-1]


#: transition and observation of the named models.
MODELS = {"level": (np.eye(1), np.ones(1)), "trend": (np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0]))}


def kalman(df: DataFrame, x: str, t: str, series: list[str], transition, observe, q, r: float, smooth: bool = False) -> DataFrame:
    """Adds state and variance (arrays) of a linear gaussian model: filtered, or smoothed by all of the series."""
    f, h, q = (np.asarray(a, float) for a in (transition, observe, q))

    def run(v):
        steps, _ = _filter(v, f, h, q, r)
        ms, ps = _smooth(steps, f)[:2] if smooth else ([s[0] for s in steps], [s[1] for s in steps])
        return {"state": [m.tolist() for m in ms], "variance": [np.diag(p).tolist() for p in ps]}

    return _per_series(df, x, t, series, "state array<double>, variance array<double>", run)


def kalman_predict(df: DataFrame, x: str, t: str, series: list[str], transition, observe, q, r: float, horizon: int) -> DataFrame:
    """Rows (step, mean, low, high) of each series' next values, with bounds of 95 %."""
    f, h, q = (np.asarray(a, float) for a in (transition, observe, q))

    def run(v):
        m, p = _filter(v, f, h, q, r)[0][-1][:2]
        out = {"step": [], "mean": [], "low": [], "high": []}
        for k in range(1, horizon + 1):
            m, p = f @ m, f @ p @ f.T + q
            half = 1.96 * np.sqrt(float(h @ p @ h) + r)
            for name, value in zip(out, (k, float(h @ m), float(h @ m) - half, float(h @ m) + half), strict=True):
                out[name].append(value)
        return out

    return _each(df, x, t, series, "step int, mean double, low double, high double", run)


def _level_em(v: np.ndarray, rounds: int, tol: float) -> tuple[float, float, float]:
    """(q, r, log-likelihood) of a local level by EM: ``_filter`` and ``_smooth`` with numbers in place of matrices."""
    seen = np.isfinite(v)
    some, whole = seen.tolist(), bool(seen.all())
    y = np.where(seen, v, 0.0).tolist()
    spread = max(np.nanvar(v), 1e-9)
    q, r, last, ll = spread / 2, spread / 2, -np.inf, 0.0
    for _ in range(rounds):
        before, after, gains, p = [], [], [], 1e7  # variances of the state before and after each value
        for known in some:
            pp = p + q
            gain = pp / (pp + r) if known else 0.0
            new = pp - gain * pp
            before.append(pp)
            after.append(new)
            gains.append(gain)
            if whole and new == p:  # and so it stays
                more = len(y) - len(before)
                before += [pp] * more
                after += [new] * more
                gains += [gain] * more
                break
            p = new
        means, errors, m = [], [], 0.0
        for value, gain in zip(y, gains, strict=True):
            e = value - m
            m += gain * e
            errors.append(e)
            means.append(m)
        s, e = np.array(before)[seen] + r, np.array(errors)[seen]
        ll = -0.5 * float((np.log(2 * np.pi * s) + e * e / s).sum())
        if ll - last < tol * (1 + abs(ll)):
            break
        last = ll
        back = [a / b for a, b in zip(after, before[1:], strict=False)]
        p = after[-1]
        smooth, spreads = [m], [p]
        for k in range(len(y) - 2, -1, -1):
            gain = back[k]
            m = means[k] + gain * (m - means[k])  # the mean before the next value is the mean after this one
            p = after[k] + gain * (p - before[k + 1]) * gain
            smooth.append(m)
            spreads.append(p)
        m, p = np.array(smooth[::-1]), np.array(spreads[::-1])
        r = max(float(np.mean((v[seen] - m[seen]) ** 2 + p[seen])), 1e-12)
        total = float((np.diff(m) ** 2 + p[1:] - 2 * p[1:] * np.array(back) + p[:-1]).sum())
        q = np.maximum(total / max(1, len(y) - 1), 1e-12)
    return float(q), r, ll


def state_space_em(df: DataFrame, x: str, t: str, series: list[str], model: str = "level", rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Per series: state variances q (array), noise variance r and log-likelihood of a local level or trend, by EM."""
    f, h = MODELS[model]

    def run(v):
        if model == "level":
            q, r, ll = _level_em(v, rounds, tol)
            return {"q": [[q]], "r": [r], "log_likelihood": [ll]}
        spread = max(np.nanvar(v), 1e-9)
        q, r, last, ll = np.eye(len(h)) * spread / 2, spread / 2, -np.inf, 0.0
        for _ in range(rounds):
            steps, ll = _filter(v, f, h, q, r)
            ms, ps, gains = _smooth(steps, f)
            if ll - last < tol * (1 + abs(ll)):
                break
            last = ll
            seen = np.isfinite(v)
            noise = [(y - h @ m) ** 2 + h @ p @ h for y, m, p in zip(v[seen], np.array(ms)[seen], np.array(ps)[seen], strict=True)]
            r = max(float(np.mean(noise)), 1e-12)
            total = np.zeros_like(q)
            for k in range(1, len(v)):
                cross = ps[k] @ gains[k - 1].T
                d = ms[k] - f @ ms[k - 1]
                total += np.outer(d, d) + ps[k] - f @ cross.T - cross @ f.T + f @ ps[k - 1] @ f.T
            q = np.diag(np.maximum(np.diag(total) / max(1, len(v) - 1), 1e-12))
        return {"q": [np.diag(q).tolist()], "r": [r], "log_likelihood": [ll]}

    return _each(df, x, t, series, "q array<double>, r double, log_likelihood double", run)


def arima(df: DataFrame, x: str, t: str, series: list[str], p: int, d: int, q: int) -> DataFrame:
    """Per series: ar, ma (arrays), mean of the differenced values, variance of the errors, aic; nulls where it is too short."""
    return arma.sarima(df, x, t, series, arma.Orders(p, d, q)).drop("seasonal_ar", "seasonal_ma")


def arima_forecast(df: DataFrame, x: str, t: str, series: list[str], p: int, d: int, q: int, horizon: int, confidence: float = 0.95) -> DataFrame:
    """Rows (step, mean, low, high) of each series."""
    return arma.sarima_forecast(df, x, t, series, arma.Orders(p, d, q), horizon, confidence)


def auto_arima(df: DataFrame, x: str, t: str, series: list[str], most_p: int = 3, most_d: int = 2, most_q: int = 3) -> DataFrame:
    """Per series: the orders of least aic, differenced until a unit-root test at 5 % rejects; nulls where it is too short."""

    def run(v):
        v, d = v[np.isfinite(v)], 0
        while d < most_d and arma.unit_root(np.diff(v, n=d)) >= -2.86:
            d += 1
        fits = [(p, q, arma.fit(v, arma.Orders(p, d, q))) for p in range(most_p + 1) for q in range(most_q + 1) if p + q]
        best = min(((f.aic, p, q) for p, q, f in fits if f is not None), default=None)
        return {"p": [best[1]], "d": [d], "q": [best[2]], "aic": [best[0]]} if best else {c: [None] for c in ("p", "d", "q", "aic")}

    return _each(df, x, t, series, "p int, d int, q int, aic double", run)


def loess(df: DataFrame, x: str, y: str, series: list[str], span: float = 0.3) -> DataFrame:
    """Adds fitted: local lines with tricube weights over the nearest share of a series' points."""
    rows = df.select(*series, observed(x).alias("x"), observed(y).alias("y")).dropna(subset=["x", "y"])
    kinds = dict(rows.dtypes)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        u, v = g["x"].to_numpy(), g["y"].to_numpy()
        k = min(len(u), max(2, int(span * len(u))))
        fit = np.zeros(len(u))
        for i, a in enumerate(u):
            d = np.abs(u - a)
            near = np.argpartition(d, k - 1)[:k]
            w = (1 - np.minimum(1, d[near] / max(d[near].max(), 1e-300)) ** 3) ** 3
            s, m = w.sum(), (w * u[near]).sum()
            if s <= 0:
                fit[i] = v[near].mean()
                continue
            m /= s
            sxx = (w * (u[near] - m) ** 2).sum()
            b = (w * (u[near] - m) * v[near]).sum() / sxx if sxx > 1e-12 * s else 0.0
            fit[i] = (w * v[near]).sum() / s + b * (a - m)
        return g.assign(fitted=fit)

    return rows.groupBy(*series).applyInPandas(one, ", ".join([*(f"`{c}` {kinds[c]}" for c in series), "x double, y double, fitted double"]))


def cubic_spline(knots: list[tuple[float, float]], x):
    """A natural cubic spline through given knots, as a column of x; the end pieces go on outside."""
    k = sorted(knots)
    t, y = np.array([a for a, _ in k], float), np.array([b for _, b in k], float)
    n = len(t)
    if n < 2 or (np.diff(t) <= 0).any():
        raise ValueError("two knots at different places, at least")
    h, slope = np.diff(t), np.diff(y) / np.diff(t)
    a, rhs = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * (slope[i] - slope[i - 1])
    m = np.linalg.solve(a, rhs)
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    out = None
    for i in range(n - 2, -1, -1):
        d = x - float(t[i])
        piece = float(y[i]) + d * (float(slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + d * (float(m[i] / 2) + d * float((m[i + 1] - m[i]) / (6 * h[i]))))
        out = piece if out is None else F.when(x < float(t[i + 1]), piece).otherwise(out)
    return out


def segment_costs(df: DataFrame, x: str, segment: list[str], centre: float = 0.0) -> DataFrame:
    """Costs of segments, groups of rows: about the mean, of the variance about a centre, of mean and variance."""
    v = observed(x)
    s = df.groupBy(*segment).agg(F.count(v).cast("double").alias("n"), F.var_pop(v).alias("v"), F.avg(F.pow(v - centre, 2)).alias("u"))
    n, least = F.col("n"), F.lit(1e-12)
    return s.select(*segment, (n * F.ln(F.greatest("v", least))).alias("mean"), (n * F.ln(F.greatest("u", least))).alias("variance"), (n * (F.ln(F.greatest("v", least)) + 1 + float(np.log(2 * np.pi)))).alias("mean_variance"))


def binary_segmentation(df: DataFrame, x: str, t: str, series: list[str], penalty: float | None = None, least: int = 2, cost: str = "error") -> DataFrame:
    """Adds segment: a series is cut in two where its ``segment_cost`` falls most, again and again while it pays."""

    def cut(v: np.ndarray) -> list[int]:
        price, pen = segment_cost(v, cost), cut_penalty(v, cost, penalty)
        cuts, open_ = [], [(0, len(v))]
        while open_:
            a, b = open_.pop()
            at = np.arange(a + least, b - least + 1)
            if not len(at):
                continue
            gain = price(a, b) - price(a, at) - price(at, b)
            k = int(np.argmax(gain))
            if gain[k] > pen:
                cuts.append(int(at[k]))
                open_ += [(a, int(at[k])), (int(at[k]), b)]
        return cuts

    return _per_series(df, x, t, series, "segment int", lambda v: {"segment": piecewise(v, cut)})


def online_changepoints(df: DataFrame, x: str, t: str, series: list[str], hazard: float = 1 / 250, floor: float = 1e-10) -> DataFrame:
    """Adds run_length (the likeliest) and change (the chance that a new run began), by Bayes with Student predictions.

    Run lengths whose chance is under ``floor`` are forgotten.
    """

    def run(v):
        mu, kappa, alpha, beta = (np.array([a]) for a in (float(np.nanmean(v[:10])), 1.0, 1.0, max(float(np.nanvar(v[:10])), 1e-6)))
        chance, length = np.ones(1), np.zeros(1, int)
        start = (mu[0], kappa[0], alpha[0], beta[0])
        longest, change = [], []
        for y in v:
            if np.isfinite(y):
                df_, scale = 2 * alpha, np.sqrt(beta * (kappa + 1) / (alpha * kappa))
                like = special.t_pdf((y - mu) / scale, df_) / scale
                grow, new = chance * like * (1 - hazard), (chance * like * hazard).sum()
                chance = np.append(new, grow)
                chance = chance / max(chance.sum(), 1e-300)
                length = np.append(0, length + 1)
                mu, kappa, alpha, beta = (np.append(a, b) for a, b in zip(start, ((kappa * mu + y) / (kappa + 1), kappa + 1, alpha + 0.5, beta + kappa * (y - mu) ** 2 / (2 * (kappa + 1))), strict=True))
                kept = chance > floor
                chance, length, mu, kappa, alpha, beta = (a[kept] for a in (chance, length, mu, kappa, alpha, beta))
            longest.append(int(length[chance.argmax()]))
            change.append(float(chance[length <= 1].sum()))
        return {"run_length": longest, "change": change}

    return _per_series(df, x, t, series, "run_length int, change double", run)


def _simplex(f, start, rounds=400, tol=1e-9):
    """The least point of a function by Nelder and Mead's simplex."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (0.1 * abs(start[i]) + 0.02) for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < tol * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        got = f(tried)
        if got < values[0]:
            far = centre + 2 * (centre - points[-1])
            value = f(far)
            points[-1], values[-1] = (far, value) if value < got else (tried, got)
        elif got < values[-2]:
            points[-1], values[-1] = tried, got
        else:
            near = centre + 0.5 * ((tried if got < values[-1] else points[-1]) - centre)
            value = f(near)
            if value < min(got, values[-1]):
                points[-1], values[-1] = near, value
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))], min(values)


def _variances(kind, b, e):
    """Conditional variances of errors under the parameters omega, alpha, beta (and gamma)."""
    s = np.empty(len(e))
    s[0] = np.var(e)
    omega, alpha, beta, gamma = (*b, 0.0)[:4]
    for k in range(1, len(e)):
        if kind == "egarch":
            z = e[k - 1] / np.sqrt(s[k - 1])
            s[k] = np.exp(np.clip(omega + beta * np.log(s[k - 1]) + alpha * abs(z) + gamma * z, -60, 60))
        else:
            s[k] = omega + (alpha + gamma * (e[k - 1] < 0)) * e[k - 1] ** 2 + beta * s[k - 1]
    return s


def _fit_garch(v, kind):
    v = v[np.isfinite(v)]
    e = v - v.mean()
    var = max(np.var(e), 1e-12)
    unit = e / np.sqrt(var)

    def loss(b):
        full = np.insert(b, 2, 0.0) if kind == "arch" else b
        if kind != "egarch" and (min(full[:3]) < 0 or full[1] + full[2] + (full[3] / 2 if len(full) > 3 else 0) >= 0.9999 or len(full) > 3 and full[1] + full[3] < 0):
            return 1e12
        if kind == "egarch" and abs(full[2]) >= 0.9999:
            return 1e12
        s = _variances(kind, full, unit)
        return 0.5 * float(np.sum(np.log(2 * np.pi * s) + unit * unit / s)) if (s > 0).all() else 1e12

    starts = {"arch": [[0.7, 0.2]], "garch": [[0.1, 0.1, 0.8], [0.3, 0.2, 0.5]], "gjr": [[0.1, 0.05, 0.8, 0.05]], "egarch": [[-0.1, 0.15, 0.9, 0.0]]}[kind]
    b, value = min((_simplex(loss, s) for s in starts), key=lambda r: r[1])
    full = np.insert(b, 2, 0.0) if kind == "arch" else np.array(b)
    s = _variances(kind, full, unit) * var
    if kind == "egarch":
        full[0] += (1 - full[2]) * np.log(var)
    else:
        full[0] *= var
    return full, e, s, -value - 0.5 * len(e) * np.log(var)


def garch(df: DataFrame, x: str, t: str, series: list[str], kind: str = "garch") -> DataFrame:
    """Per series: parameters (omega, alpha, beta and, for gjr and egarch, gamma), log-likelihood and last variance, of order (1, 1); kind arch has no beta."""
    if kind not in ("arch", "garch", "gjr", "egarch"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(v):
        b, _, s, ll = _fit_garch(v, kind)
        return {"parameters": [b.tolist()], "log_likelihood": [ll], "variance": [float(s[-1])], "aic": [2 * (len(b) - (kind == "arch")) - 2 * ll]}

    return _each(df, x, t, series, "parameters array<double>, log_likelihood double, variance double, aic double", run)


def garch_forecast(df: DataFrame, x: str, t: str, series: list[str], horizon: int, kind: str = "garch") -> DataFrame:
    """Rows (step, variance) of each series: expected variances of the next values (arch, garch or gjr)."""

    def run(v):
        b, e, s, _ = _fit_garch(v, kind)
        omega, alpha, beta, gamma = (*b, 0.0)[:4]
        out = [omega + (alpha + gamma * (e[-1] < 0)) * e[-1] ** 2 + beta * s[-1]]
        for _ in range(horizon - 1):
            out.append(omega + (alpha + gamma / 2 + beta) * out[-1])
        return {"step": range(1, horizon + 1), "variance": out}

    return _each(df, x, t, series, "step int, variance double", run)


def arch_test(df: DataFrame, x: str, t: str, series: list[str], lags: int = 5) -> DataFrame:
    """Engle's test over all series: rows times R squared of squared errors on their lags, by products of lag columns."""
    from .regression import ordinary
    from .series import lagged

    rows = lagged(df.withColumn("__q", F.pow(observed(x), 2)), ["__q"], t, series, lags)
    model = ordinary(rows, [f"__q_{k}" for k in range(1, lags + 1)], "__q")
    s = model.n * model.stats["r2"]
    return df.sparkSession.createDataFrame([(float(s), float(lags), float(special.chi2_sf(s, float(lags))))], "statistic double, df double, p_value double")


def volatility_diagnostics(df: DataFrame, z: str, t: str, series: list[str], lags: int = 10) -> DataFrame:
    """Per series of standardised residuals: n, mean, variance, skewness, kurtosis, ljung_box, ljung_box_squared, arch, arch_lags.

    The Ljung-Box statistics of the residuals and their squares are over ``lags``
    lags; ``arch`` is n times R squared of the squares on their lags, at most a
    third of the series.  Missing values are left out; what a series is too short
    for is null.
    """

    def box(v: np.ndarray) -> float | None:
        n, c = len(v), v - v.mean()
        total = c @ c
        if n <= lags or total < 1e-14 * n:
            return 0.0 if n > lags else None
        return float(n * (n + 2) * sum((c[k:] @ c[:-k] / total) ** 2 / (n - k) for k in range(1, lags + 1)))

    def run(v: np.ndarray) -> dict:
        v = v[np.isfinite(v)]
        n = len(v)
        if n < 2:
            return {"n": [n], "mean": [float(v[0]) if n else None], **{c: [None] for c in ("variance", "skewness", "kurtosis", "ljung_box", "ljung_box_squared", "arch", "arch_lags")}}
        m, s = v.mean(), v.var(ddof=1)
        k, q = min(lags, n // 3), v * v
        arch = None
        if k and n - k > k + 1:
            x = np.column_stack([np.ones(n - k), *(q[k - i : n - i] for i in range(1, k + 1))])
            y = q[k:]
            r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            spread = ((y - y.mean()) ** 2).sum()
            arch = float((n - k) * (1 - r @ r / spread)) if spread > 0 else 0.0
        third, fourth = ((v - m) ** 3).mean(), ((v - m) ** 4).mean()
        return {"n": [n], "mean": [m], "variance": [s], "skewness": [third / s**1.5 if s > 0 else None], "kurtosis": [fourth / s**2 - 3 if s > 0 else None], "ljung_box": [box(v)], "ljung_box_squared": [box(q)], "arch": [arch], "arch_lags": [k]}

    return _each(df, z, t, series, "n long, mean double, variance double, skewness double, kurtosis double, ljung_box double, ljung_box_squared double, arch double, arch_lags int", run)
