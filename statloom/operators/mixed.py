"""Mixed models, additive models, consensus regression and vector autoregressions.

All rest on sums of products: per group once for mixed models, per basis column
for additive models, per lag column for autoregressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.gram import centred
from ..plans.order import staged
from .descriptive import observed
from .regression import LinearModel, complete, linear
from .series import lagged


def mixed_model(df: DataFrame, features: list[str], y: str, group: str, slope: str | None = None, rounds: int = 200, tol: float = 1e-9) -> tuple[LinearModel, DataFrame]:
    """Random intercepts, and with ``slope`` a random slope of that feature, by expectation-maximisation of the likelihood.

    The rows are read once, for each group's sums of products; a round is one
    aggregate over the groups.  Returns the fixed effects (stats: residual
    variance, the random effects' covariance, log_likelihood) and a table of the
    groups' effects (group, intercept, slope).
    """
    rows = complete(df, [*features, y], group).where(F.col(group).isNotNull())
    cols = [F.lit(1.0), *map(F.col, features), F.col(y)]
    p, q = len(features) + 1, 2 if slope else 1
    at = [0, 1 + features.index(slope)] if slope else [0]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = staged(rows.groupBy(group).agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in pairs]), "groups")
    s = lambda i, j: F.col(f"s{min(i, j)}_{max(i, j)}")
    whole = sums.agg(*[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("groups")).first()
    g = np.zeros((p + 1, p + 1))
    for i, j in pairs:
        g[i, j] = g[j, i] = whole[f"s{i}_{j}"] or 0.0
    n, m = g[0, 0], whole["groups"]
    if n <= p + q:
        raise ValueError("there must be more rows than parameters")
    b = np.linalg.lstsq(g[:p, :p], g[:p, p], rcond=None)[0]
    error = max(float(g[p, p] - b @ g[:p, p]) / n, 1e-12)
    cov = np.eye(q) * error / 2
    last, ll = -np.inf, 0.0

    def effects(b, error, cov):
        """Posterior means u and covariances c of a group's effects, and log |I + cov Z'Z / error|, as columns of its sums."""
        w = np.linalg.inv(cov)
        r = [s(a, p) - sum((float(b[k]) * s(a, k) for k in range(1, p)), float(b[0]) * s(a, 0)) for a in at]
        if q == 1:
            c = error / (s(0, 0) + error * float(w[0, 0]))
            return [c / error * r[0]], [[c]], F.ln(1 + s(0, 0) * float(cov[0, 0]) / error), r
        a, d, e = s(0, 0) / error + float(w[0, 0]), s(at[1], at[1]) / error + float(w[1, 1]), s(0, at[1]) / error + float(w[0, 1])
        det = a * d - e * e
        c = [[d / det, -e / det], [-e / det, a / det]]
        u = [(c[i][0] * r[0] + c[i][1] * r[1]) / error for i in (0, 1)]
        return u, c, F.ln(det) + float(np.log(np.linalg.det(cov))), r

    done = 0
    for done in range(1, rounds + 1):
        u, c, log_det, r = effects(b, error, cov)
        view = sums.select("*", *[u[i].alias(f"u{i}") for i in range(q)], *[c[i][j].alias(f"c{i}_{j}") for i in range(q) for j in range(i, q)], log_det.alias("ld"), *[r[i].alias(f"r{i}") for i in range(q)])
        cc = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
        zz = sum((s(at[i], at[j]) * (F.col(f"u{i}") * F.col(f"u{j}") + cc(i, j)) for i in range(q) for j in range(q)), F.lit(0.0))
        got = view.agg(
            *[F.sum(F.col(f"u{i}") * F.col(f"u{j}") + cc(i, j)).alias(f"t{i}_{j}") for i in range(q) for j in range(i, q)],
            *[F.sum(sum((s(at[i], k) * F.col(f"u{i}") for i in range(q)), F.lit(0.0))).alias(f"x{k}") for k in range(p + 1)],
            F.sum(zz).alias("zz"), F.sum("ld").alias("ld"), F.sum(sum((F.col(f"r{i}") * F.col(f"u{i}") for i in range(q)), F.lit(0.0))).alias("ru"),
        ).first()
        rss = float(g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b)
        ll = -0.5 * (n * np.log(2 * np.pi * error) + got["ld"] + (rss - got["ru"]) / error)
        if abs(ll - last) < tol * (1 + abs(ll)):
            break
        last = ll
        zu = np.array([got[f"x{k}"] for k in range(p)])
        b = np.linalg.solve(g[:p, :p], g[:p, p] - zu)
        fit = float(g[p, p] - 2 * b @ g[:p, p] + b @ g[:p, :p] @ b)
        error = max((fit - 2 * (got[f"x{p}"] - b @ zu) + got["zz"]) / n, 1e-12)
        for i in range(q):
            for j in range(i, q):
                cov[i, j] = cov[j, i] = got[f"t{i}_{j}"] / m
        cov += np.eye(q) * 1e-12
    u, c, _, _ = effects(b, error, cov)
    # the fixed effects' information: X'X less what the groups' effects explain, over the error
    info = np.zeros((p, p))
    terms = [F.sum(s(i, j) - sum((s(at[a], i) * c[a][d] * s(at[d], j) for a in range(q) for d in range(q)), F.lit(0.0)) / error).alias(f"i{i}_{j}") for i in range(p) for j in range(i, p)]
    row = sums.agg(*terms).first()
    for i in range(p):
        for j in range(i, p):
            info[i, j] = info[j, i] = row[f"i{i}_{j}"] / error
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(info)), 0))
    table = sums.select(group, u[0].alias("intercept"), *([u[1].alias("slope")] if slope else []))
    return LinearModel(features, b, se, int(n), done, {"residual": error, "random": cov, "log_likelihood": float(ll)}), table


def likelihood_ratio(restricted: float, full: float, df: float) -> tuple[float, float]:
    """Twice the difference of log-likelihoods of nested models, and its p-value."""
    s = max(0.0, 2 * (full - restricted))
    return s, float(special.chi2_sf(s, df))


def spline_basis(x: Column | str, knots: list[float]) -> list[Column]:
    """x and truncated cubes at knots, scaled to the knots' range."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    low, wide = knots[0], max(knots[-1] - knots[0], 1e-12)
    u = (x - float(low)) / float(wide)
    return [u, *[F.pow(F.greatest(u - float((k - low) / wide), F.lit(0.0)), 3) for k in knots]]


def thin_plate_basis(x: Column | str, knots: list[float]) -> list[Column]:
    """x and r squared log r of the distances to knots, scaled to the knots' range."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    low, wide = knots[0], max(knots[-1] - knots[0], 1e-12)
    u = (x - float(low)) / float(wide)
    r = [F.abs(u - float((k - low) / wide)) for k in knots]
    return [u, *[F.when(v > 0, v * v * F.ln(v)).otherwise(0.0) for v in r]]


def tensor_basis(a: list[Column], b: list[Column]) -> list[Column]:
    """All products of two bases."""
    return [x * y for x in a for y in b]


@dataclass
class AdditiveModel:
    """Intercept, each smooth term's basis and coefficients, and what the fit is measured by."""

    intercept: float
    terms: dict[str, tuple[list[float], np.ndarray]]
    penalty: float
    stats: dict = field(default_factory=dict)

    def effect(self, name: str, x: Column | str | None = None) -> Column:
        """The partial effect of a feature, about its mean over the rows."""
        knots, b = self.terms[name]
        basis = spline_basis(name if x is None else x, knots)
        centre = self.stats["means"][name]
        return sum((float(w) * (c - float(m)) for w, c, m in zip(b, basis, centre, strict=True)), F.lit(0.0))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, sum((self.effect(t) for t in self.terms), F.lit(float(self.intercept))))

    def partial_dependence(self, spark, name: str, points: int = 100) -> DataFrame:
        """Rows (x, effect) over the range of a feature's knots."""
        low, high = self.terms[name][0][0], self.terms[name][0][-1]
        grid = spark.range(points).select((F.lit(low) + F.col("id") * ((high - low) / (points - 1))).alias("x"))
        return grid.select("x", self.effect(name, F.col("x")).alias("effect"))


def additive_model(df: DataFrame, features: list[str], y: str, knots: int = 8) -> AdditiveModel:
    """Smooth effects by penalised splines; the penalty of least generalised cross-validation.

    Knots are quantiles; one pass sums the products of all basis columns, and
    every penalty is tried on that matrix alone.
    """
    rows = complete(df, [*features, y])
    cuts = [k / (knots - 1) for k in range(knots)]
    places = {f: sorted(set(rows.approxQuantile(f, cuts, 0.001))) for f in features}
    bases = {f: spline_basis(f, places[f]) for f in features}
    names = {f: [f"__{i}_{k}" for k in range(len(bases[f]))] for i, f in enumerate(features)}
    flat = [n for f in features for n in names[f]]
    wide = rows.select(*[c.alias(n) for f in features for c, n in zip(bases[f], names[f], strict=True)], F.col(y).alias("__y"))
    n, mean, s = centred(wide, [*flat, "__y"])
    p = len(flat)
    g, c, yy = s[:p, :p], s[:p, p], s[p, p]
    bent = np.array([0.0 if k == 0 else 1.0 for f in features for k in range(len(bases[f]))])
    best = None
    for penalty in np.logspace(-6, 3, 28):
        a = g + np.diag(bent * penalty * n + 1e-9 * max(1.0, np.trace(g) / p))
        inverse = np.linalg.inv(a)
        b = inverse @ c
        edf = 1 + float(np.trace(inverse @ g))
        rss = max(float(yy - 2 * b @ c + b @ g @ b), 0.0)
        score = n * rss / max(n - edf, 1e-9) ** 2
        if best is None or score < best[0]:
            best = (score, penalty, b, edf, rss)
    score, penalty, b, edf, rss = best
    terms, means, at = {}, {}, 0
    for f in features:
        k = len(bases[f])
        terms[f], means[f] = (places[f], b[at : at + k]), mean[at : at + k]
        at += k
    return AdditiveModel(float(mean[p]), terms, float(penalty), {"means": means, "edf": edf, "gcv": float(score), "rss": rss, "r2": 1 - rss / yy if yy else float("nan"), "n": n})


def consensus_regression(df: DataFrame, features: list[str], y: str, key: str, threshold: float | None = None, trials: int = 64, seed: int = 0) -> tuple[LinearModel, int]:
    """(model of the largest consensus, its rows): lines through small random samples, judged by all rows at once.

    The samples are the rows of least hash, one small set for each trial; one
    aggregate counts the rows near every trial's line, and the winner's rows are
    fitted anew.  The usual threshold is three scaled median deviations.
    """
    from .regression import ordinary

    rows = complete(df, [*features, y], key)
    if threshold is None:
        middle = rows.agg(F.median(y)).first()[0]
        threshold = 3 * 1.4826 * rows.agg(F.median(F.abs(F.col(y) - middle))).first()[0] or 1e-9
    size = len(features) + 1
    sample = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__h", key).limit(trials * size).collect()
    lines = []
    for k in range(len(sample) // size):
        part = sample[k * size : (k + 1) * size]
        a = np.array([[1.0, *[r[f] for f in features]] for r in part])
        if abs(np.linalg.det(a)) > 1e-9 * max(1.0, np.abs(a).max()):
            lines.append(np.linalg.solve(a, np.array([r[y] for r in part])))
    if not lines:
        raise ValueError("no sample defines a line")
    near = [F.abs(F.col(y) - linear(b, features)) <= threshold for b in lines]
    counts = rows.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(near)]).first()
    best = max(range(len(lines)), key=lambda k: counts[f"n{k}"])
    return ordinary(rows.where(near[best]), features, y), counts[f"n{best}"]


@dataclass
class VectorModel:
    """Intercepts, lag matrices (lags, equations, columns), error covariance and criteria of a vector autoregression."""

    columns: list[str]
    intercept: np.ndarray
    lags: np.ndarray
    covariance: np.ndarray
    n: int
    criteria: dict

    def impulse_response(self, horizon: int) -> np.ndarray:
        """Responses (step, of, to) to orthogonal shocks of one sd (Cholesky, in the columns' order)."""
        p, k, _ = self.lags.shape
        psi = [np.eye(k)]
        for h in range(1, horizon + 1):
            psi.append(sum(psi[h - 1 - i] @ self.lags[i] for i in range(min(p, h))))
        return np.array(psi) @ np.linalg.cholesky(self.covariance)

    def variance_decomposition(self, horizon: int) -> np.ndarray:
        """Shares (of, to) of the forecast error variance at a horizon."""
        r = (self.impulse_response(horizon - 1) ** 2).sum(axis=0)
        return r / r.sum(axis=1, keepdims=True)

    def forecast(self, last: np.ndarray, steps: int) -> np.ndarray:
        """Next values after the last rows of a series, newest last."""
        past = [np.asarray(r, float) for r in last]
        for _ in range(steps):
            past.append(self.intercept + sum(self.lags[i] @ past[-1 - i] for i in range(len(self.lags))))
        return np.array(past[len(last) :])


def vector_autoregression(df: DataFrame, columns: list[str], t: str, series: list[str], lags: int) -> VectorModel:
    """Least squares of each column on the lags of all, common to all series, from one matrix of products."""
    rows = lagged(df.select(*series, t, *[observed(c).alias(c) for c in columns]), columns, t, series, lags).dropna(subset=columns)
    names = [f"{c}_{k}" for k in range(1, lags + 1) for c in columns]
    n, mean, s = centred(rows, [*names, *columns])
    p, k = len(names), len(columns)
    b = np.linalg.solve(s[:p, :p], s[:p, p:])
    residual = s[p:, p:] - s[:p, p:].T @ b
    cov = residual / n
    free = k * (p + 1)
    ld = float(np.linalg.slogdet(cov)[1])
    criteria = {"aic": ld + 2 * free / n, "bic": ld + np.log(n) * free / n, "hq": ld + 2 * np.log(np.log(n)) * free / n}
    return VectorModel(columns, mean[p:] - b.T @ mean[:p], b.T.reshape(k, lags, k).transpose(1, 0, 2), cov, n, criteria)


def select_lags(df: DataFrame, columns: list[str], t: str, series: list[str], most: int) -> dict[str, int]:
    """The number of lags with the least aic, bic and hq."""
    models = {k: vector_autoregression(df, columns, t, series, k) for k in range(1, most + 1)}
    return {c: min(models, key=lambda k: models[k].criteria[c]) for c in ("aic", "bic", "hq")}


def johansen(df: DataFrame, columns: list[str], t: str, series: list[str], lags: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, trace statistics of rank 0, 1, ...) of cointegration, from the products of levels and differences."""
    rows = df.select(*series, t, *[observed(c).alias(c) for c in columns])
    rows = lagged(rows, columns, t, series, 1).withColumns({f"__d{i}": F.col(c) - F.col(f"{c}_1") for i, c in enumerate(columns)})
    d = [f"__d{i}" for i in range(len(columns))]
    if lags:
        rows = lagged(rows, d, t, series, lags)
    short = [f"{c}_{k}" for k in range(1, lags + 1) for c in d]
    n, _, s = centred(rows, [*d, *[f"{c}_1" for c in columns], *short])
    k, m = len(columns), 2 * len(columns)
    s = s / n
    clean = s[:m, :m] - (s[:m, m:] @ np.linalg.solve(s[m:, m:], s[m:, :m]) if short else 0.0)
    s00, s01, s11 = clean[:k, :k], clean[:k, k:], clean[k:, k:]
    root = np.linalg.inv(np.linalg.cholesky(s11))
    values = np.sort(np.linalg.eigvalsh(root @ s01.T @ np.linalg.solve(s00, s01) @ root.T))[::-1]
    values = np.clip(values, 0, 1 - 1e-15)
    return values, np.array([-n * np.log1p(-values[r:]).sum() for r in range(k)])


def leave_one_out(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """mse and mae of predictions that leave out the row itself, from residuals and leverages."""
    from .regression import influence

    e = F.col("residual") / (1 - F.col("leverage"))
    return influence(df, features, y).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
