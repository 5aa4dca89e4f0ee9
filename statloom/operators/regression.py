"""Least squares, penalised, robust and generalised linear models.

Every step is one aggregate of products, map-side combined; the driver solves a
system as large as the number of features.  Iterative models scan a persisted
projection once a round.  Rows with a missing value take no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.gram import centred, matrix, products
from .descriptive import observed


def complete(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    rows = df.select(*keep, *[observed(c).alias(c) for c in columns])
    return rows.dropna(subset=columns)


def linear(coef, features: list[str]) -> Column:
    """Intercept plus the weighted sum of feature columns."""
    out = F.lit(float(coef[0]))
    for b, c in zip(coef[1:], features, strict=True):
        out = out + F.lit(float(b)) * F.col(c)
    return out


@dataclass
class LinearModel:
    """Coefficients (intercept first), standard errors, and what the fit is measured by."""

    features: list[str]
    coefficients: np.ndarray
    se: np.ndarray | None = None
    n: int = 0
    rounds: int = 0
    stats: dict = field(default_factory=dict)

    def table(self, spark, large: bool = False) -> DataFrame:
        """One row for each coefficient: term, estimate, se, statistic, p_value."""
        names = ["(intercept)", *self.features]
        free = self.n - len(names)
        rows = []
        for k, name in enumerate(names):
            b, s = float(self.coefficients[k]), float(self.se[k]) if self.se is not None else None
            t = b / s if s else None
            p = None if t is None else float(special.normal_two_sided(t) if large else special.t_two_sided(t, free))
            rows.append((name, b, s, t, p))
        return spark.createDataFrame(rows, "term string, estimate double, se double, statistic double, p_value double")

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, linear(self.coefficients, self.features))

    def intervals(self, spark, confidence: float = 0.95) -> DataFrame:
        """``table`` with the low and high end of each coefficient's t interval."""
        half = float(special.t_quantile(0.5 + confidence / 2, self.n - len(self.features) - 1))
        return self.table(spark).withColumns({"low": F.col("estimate") - half * F.col("se"), "high": F.col("estimate") + half * F.col("se")})


def simple_linear(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """n, slope, intercept and R squared of y on x for each group, in one aggregate."""
    u, v = observed(x), observed(y)
    both = u.isNotNull() & v.isNotNull()
    return df.where(both).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(v, u).alias("slope"), F.regr_intercept(v, u).alias("intercept"), F.regr_r2(v, u).alias("r2"))


def simple_intervals(df: DataFrame, x: str, y: str, confidence: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Rows (term, estimate, se, statistic, p_value, low, high) of the intercept and slope of each group, from one aggregate.

    Groups with fewer than three complete rows, or one x only, have nulls from se on.
    """
    u, v = observed(x), observed(y)
    both = u.isNotNull() & v.isNotNull()
    s = df.where(both).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("m"), F.regr_sxx(v, u).alias("sxx"), F.regr_syy(v, u).alias("syy"), F.regr_sxy(v, u).alias("sxy"), F.regr_slope(v, u).alias("b"), F.regr_intercept(v, u).alias("a"))
    free = F.when((F.col("n") > 2) & (F.col("sxx") > 0), (F.col("n") - 2).cast("double"))
    s = s.withColumn("df", free).withColumn("mse", F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / F.col("df"))
    terms = F.array(
        F.struct(F.lit("(intercept)").alias("term"), F.col("a").alias("estimate"), F.sqrt(F.col("mse") * (1 / F.col("n") + F.col("m") * F.col("m") / F.col("sxx"))).alias("se")),
        F.struct(F.lit(x).alias("term"), F.col("b").alias("estimate"), F.sqrt(F.col("mse") / F.col("sxx")).alias("se")),
    )
    rows = s.select(*by, "df", F.inline(terms)).withColumn("statistic", F.col("estimate") / F.col("se"))
    half = special.column("t_quantile", F.lit(0.5 + confidence / 2), F.col("df")) * F.col("se")
    rows = rows.withColumns({"p_value": special.column("t_two_sided", F.col("statistic"), F.col("df")), "__h": half})
    return rows.select(*by, "term", "estimate", "se", "statistic", "p_value", (F.col("estimate") - F.col("__h")).alias("low"), (F.col("estimate") + F.col("__h")).alias("high"))


def from_moments(features: list[str], n: int, mean: np.ndarray, s: np.ndarray) -> LinearModel:
    """Ordinary least squares from centred sums of products; the last column is the response."""
    p = len(features)
    if n <= p + 1:
        raise ValueError("there must be more rows than coefficients")
    sxx, sxy, syy = s[:p, :p], s[:p, p], s[p, p]
    inverse = np.linalg.inv(sxx) if p else np.zeros((0, 0))
    beta = inverse @ sxy
    rss = max(0.0, float(syy - beta @ sxy))
    mse = rss / (n - p - 1)
    b0 = mean[p] - mean[:p] @ beta
    se = np.sqrt(mse * np.append(1 / n + mean[:p] @ inverse @ mean[:p], np.diag(inverse)))
    r2 = 1 - rss / syy if syy else float("nan")
    f = (syy - rss) / p / mse if p and mse else float("nan")
    stats = {"rss": rss, "mse": mse, "r2": r2, "adjusted_r2": 1 - (1 - r2) * (n - 1) / (n - p - 1), "f": f, "f_p_value": float(special.f_sf(f, p, n - p - 1)) if f == f else float("nan"), "inverse": inverse, "mean": mean, "sums": s}
    return LinearModel(features, np.append(b0, beta), se, n, 0, stats)


def ordinary(df: DataFrame, features: list[str], y: str) -> LinearModel:
    """Multiple regression: two stable passes."""
    rows = complete(df, [*features, y])
    return from_moments(features, *centred(rows, [*features, y]))


def polynomial(df: DataFrame, x: str, y: str, degree: int) -> LinearModel:
    """Powers of the centred and scaled x: features z1..z<degree>, z = (x - stats['centre']) / stats['scale']."""
    if degree < 1:
        raise ValueError("degree must be positive")
    rows = complete(df, [x, y])
    s = rows.agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s")).first()
    centre, scale = s["m"] or 0.0, s["s"] or 1.0
    z = (F.col(x) - centre) / scale
    names = [f"z{k}" for k in range(1, degree + 1)]
    rows = rows.select(*[F.pow(z, k).alias(n) for k, n in enumerate(names, 1)], F.col(y).alias(y))
    model = ordinary(rows, names, y)
    model.stats |= {"centre": centre, "scale": scale}
    return model


def elastic_net(df: DataFrame, features: list[str], y: str, penalty: float, mix: float = 1.0, rounds: int = 1000, tol: float = 1e-7) -> LinearModel:
    """Coordinate descent on the standardised sums of products (mix 1: lasso, 0: ridge by descent)."""
    n, mean, s = centred(complete(df, [*features, y]), [*features, y])
    p = len(features)
    sd = np.sqrt(np.diag(s)[:p] / n)
    unit = np.where(sd > 0, sd, 1.0)
    g, c = s[:p, :p] / np.outer(unit, unit), s[:p, p] / unit
    b = np.zeros(p)
    for done in range(1, rounds + 1):
        step = 0.0
        for j in range(p):
            if sd[j] == 0:
                continue
            r = c[j] - g[j] @ b + g[j, j] * b[j]
            new = np.sign(r) * max(0.0, abs(r) - penalty * mix * n) / (g[j, j] + penalty * (1 - mix) * n)
            step, b[j] = max(step, abs(new - b[j])), new
        if step < tol:
            break
    beta = b / unit
    return LinearModel(features, np.append(mean[p] - mean[:p] @ beta, beta), None, n, done)


def lasso(df: DataFrame, features: list[str], y: str, penalty: float) -> LinearModel:
    return elastic_net(df, features, y, penalty, 1.0)


def ridge(df: DataFrame, features: list[str], y: str, penalty: float) -> LinearModel:
    """Standardised features, penalty added to the diagonal of their products."""
    n, mean, s = centred(complete(df, [*features, y]), [*features, y])
    p = len(features)
    sd = np.sqrt(np.diag(s)[:p] / n)
    unit = np.where(sd > 0, sd, 1.0)
    b = np.linalg.solve(s[:p, :p] / np.outer(unit, unit) + penalty * np.eye(p), s[:p, p] / unit)
    beta = b / unit
    return LinearModel(features, np.append(mean[p] - mean[:p] @ beta, beta), None, n)


def stepwise(df: DataFrame, features: list[str], y: str, criterion: str = "aic", direction: str = "both") -> LinearModel:
    """Forward, backward or two-way selection; all candidate fits use one matrix of products."""
    if criterion not in ("aic", "bic") or direction not in ("forward", "backward", "both"):
        raise ValueError("criterion is aic or bic, direction forward, backward or both")
    n, mean, s = centred(complete(df, [*features, y]), [*features, y])
    last = len(features)

    def fit(chosen: list[int]) -> LinearModel:
        at = [*chosen, last]
        return from_moments([features[k] for k in chosen], n, mean[at], s[np.ix_(at, at)])

    def score(chosen: list[int]) -> float:
        rss = max(fit(chosen).stats["rss"], 1e-300)
        return n * np.log(rss / n) + (len(chosen) + 1) * (2 if criterion == "aic" else np.log(n))

    chosen = list(range(last)) if direction == "backward" else []
    best = score(chosen)
    while True:
        tries = []
        if direction != "backward":
            tries += [[*chosen, k] for k in range(last) if k not in chosen]
        if direction != "forward":
            tries += [[k for k in chosen if k != out] for out in chosen]
        scored = sorted((score(t), t) for t in tries)
        if not scored or scored[0][0] >= best - 1e-10:
            break
        best, chosen = scored[0]
    model = fit(sorted(chosen))
    model.stats[criterion] = best
    return model


def _weighted_fit(rows: DataFrame, features: list[str], response: Column, weight: Column, more: list[Column] = ()) -> tuple[np.ndarray, np.ndarray, object]:
    """Solution and inverse of one weighted least squares step, and the row of further sums."""
    cols = [F.lit(1.0), *map(F.col, features), response]
    row = rows.agg(*products(cols, weight), *more).first()
    g = matrix(row, len(cols))
    p = len(features) + 1
    inverse = np.linalg.pinv(g[:p, :p])
    return inverse @ g[:p, p], inverse, row


def _reweighted(rows: DataFrame, features: list[str], y: str, weight_of, start: np.ndarray, rounds: int, tol: float) -> tuple[np.ndarray, int]:
    b, done = start, 0
    while done < rounds:
        new, _, _ = _weighted_fit(rows, features, F.col(y), weight_of(F.col(y) - linear(b, features), b))
        done += 1
        step, b = np.max(np.abs(new - b)), new
        if step < tol:
            break
    return b, done


def quantile_regression(df: DataFrame, features: list[str], y: str, tau: float = 0.5, rounds: int = 100, tol: float = 1e-6) -> LinearModel:
    """Reweighted least squares on the check loss."""
    if not 0 < tau < 1:
        raise ValueError("tau must be between 0 and 1")
    rows = complete(df, [*features, y]).persist()
    try:
        start = ordinary(rows, features, y)
        b, done = _reweighted(rows, features, y, lambda r, _: F.when(r >= 0, tau).otherwise(1 - tau) / (F.abs(r) + 1e-6), start.coefficients, rounds, tol)
    finally:
        rows.unpersist()
    return LinearModel(features, b, None, start.n, done)


def huber_regression(df: DataFrame, features: list[str], y: str, delta: float = 1.345, rounds: int = 50, tol: float = 1e-6) -> LinearModel:
    """Reweighted least squares; the scale is the median absolute residual / 0.6745 in each round."""
    rows = complete(df, [*features, y]).persist()
    try:
        start = ordinary(rows, features, y)

        def weight(r: Column, b: np.ndarray) -> Column:
            scale = max((rows.agg(F.median(F.abs(r))).first()[0] or 0.0) / 0.6745, 1e-12)
            u = F.abs(r) / scale
            return F.when(u <= delta, 1.0).otherwise(delta / u)

        b, done = _reweighted(rows, features, y, weight, start.coefficients, rounds, tol)
    finally:
        rows.unpersist()
    return LinearModel(features, b, None, start.n, done)


#: Link: name -> (eta of mu, mu of eta, derivative of mu by eta at eta).
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: F.lit(1.0)),
    "log": (F.ln, F.exp, F.exp),
    "logit": (lambda m: F.ln(m / (1 - m)), lambda e: 1 / (1 + F.exp(-e)), lambda e: F.exp(-F.abs(e)) / F.pow(1 + F.exp(-F.abs(e)), 2)),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / (e * e)),
    "cloglog": (lambda m: F.ln(-F.ln(1 - m)), lambda e: 1 - F.exp(-F.exp(e)), lambda e: F.exp(e - F.exp(e))),
    "probit": (lambda m: special.column("normal_quantile", m), lambda e: special.column("normal_cdf", e), lambda e: F.exp(-e * e / 2) / float(np.sqrt(2 * np.pi))),
}


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)


#: Family: name -> (variance of mu, unit deviance, usual link, dispersion is 1).
FAMILIES = {
    "gaussian": (lambda m: F.lit(1.0), lambda y, m: (y - m) * (y - m), "identity", False),
    "binomial": (lambda m: m * (1 - m), lambda y, m: 2 * (_xlogy(y, m) + _xlogy(1 - y, 1 - m)), "logit", True),
    "poisson": (lambda m: m, lambda y, m: 2 * (_xlogy(y, m) - (y - m)), "log", True),
    "gamma": (lambda m: m * m, lambda y, m: 2 * ((y - m) / m - F.ln(y / m)), "inverse", False),
}


def negative_binomial(theta: float):
    """A family with variance mu + mu^2 / theta."""
    return (lambda m: m + m * m / theta, lambda y, m: 2 * (_xlogy(y, m) - (y + theta) * F.ln((y + theta) / (m + theta))), "log", True)


def quasi(variance, link: str):
    """A family of a given variance function; its deviance is the sum of squared Pearson residuals."""
    return (variance, lambda y, m: (y - m) * (y - m) / variance(m), link, False)


def tweedie(power: float):
    """A family with variance mu ** power, for powers over 1 other than 2."""
    a, b = 1 - power, 2 - power
    return (lambda m: F.pow(m, power), lambda y, m: 2 * (F.when(y > 0, F.pow(y, b)).otherwise(0.0) / (a * b) - y * F.pow(m, a) / a + F.pow(m, b) / b), "log", False)


def glm(df: DataFrame, features: list[str], y: str, family="gaussian", link: str | None = None, rounds: int = 25, tol: float = 1e-8) -> LinearModel:
    """Iteratively reweighted least squares; stats has deviance, dispersion and pearson."""
    variance, deviance, usual, fixed = FAMILIES[family] if isinstance(family, str) else family
    name = link or usual
    to_eta, to_mu, slope = LINKS[name]
    rows = complete(df, [*features, y]).persist()
    try:
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m")).first()
        n, mean = s["n"], s["m"]
        if not n:
            raise ValueError("no complete rows")
        low = 1e-6
        mean = min(max(mean, low), 1 - low) if name in ("logit", "probit", "cloglog") else max(mean, low) if name in ("log", "inverse") else mean
        start = {"identity": lambda m: m, "log": np.log, "logit": lambda m: np.log(m / (1 - m)), "inverse": lambda m: 1 / m, "cloglog": lambda m: np.log(-np.log(1 - m)), "probit": special.normal_quantile}[name](mean)
        b = np.append(start, np.zeros(len(features)))
        inverse, done, last = None, 0, np.inf
        while done < rounds:
            e = linear(b, features)
            e = F.least(F.greatest(e, F.lit(-30.0)), F.lit(30.0)) if name in ("logit", "cloglog", "probit", "log") else e
            m, d = to_mu(e), slope(e)
            w = d * d / F.greatest(variance(m), F.lit(1e-12))
            z = e + (F.col(y) - m) / d
            new, inverse, row = _weighted_fit(rows.withColumns({"__z": z, "__w": w, "__d": deviance(F.col(y), m)}), features, F.col("__z"), F.col("__w"), [F.sum("__d").alias("dev")])
            done += 1
            change, b, now = np.max(np.abs(new - b)), new, row["dev"] or 0.0
            if change < tol or abs(now - last) < tol * (abs(now) + 0.1) * 1e-2:
                break
            last = now
        m = to_mu(linear(b, features))
        end = rows.agg(F.sum(deviance(F.col(y), m)).alias("dev"), F.sum(F.pow(F.col(y) - m, 2) / variance(m)).alias("pearson")).first()
    finally:
        rows.unpersist()
    scale = 1.0 if fixed else end["pearson"] / max(1, n - len(b))
    stats = {"deviance": end["dev"], "pearson": end["pearson"], "dispersion": end["pearson"] / max(1, n - len(b)), "link": name}
    return LinearModel(features, b, np.sqrt(np.maximum(np.diag(inverse) * scale, 0)), n, done, stats)


def logistic(df: DataFrame, features: list[str], y: str, rounds: int = 100) -> LinearModel:
    return glm(df, features, y, "binomial", rounds=rounds)


def variance_inflation(df: DataFrame, features: list[str]) -> DataFrame:
    """1 / (1 - R2) of each feature on the others: the diagonal of the inverse correlation matrix."""
    _, _, s = centred(complete(df, features), features)
    d = np.sqrt(np.diag(s))
    v = np.diag(np.linalg.inv(s / np.outer(d, d)))
    return df.sparkSession.createDataFrame([(f, float(x)) for f, x in zip(features, v, strict=True)], "feature string, vif double")


def influence(df: DataFrame, features: list[str], y: str, keep: list[str] = ()) -> DataFrame:
    """Rows with residual, leverage, studentized residual, Cook's distance, dffits and dfbetas.

    Deletion statistics have closed forms: the fit's inverse goes out as literals, and each row needs only itself.
    """
    model = ordinary(df, features, y)
    inv, mean, n, p = model.stats["inverse"], model.stats["mean"], model.n, len(features) + 1
    rows = complete(df, [*features, y], *keep)
    d = [F.col(c) - float(m) for c, m in zip(features, mean[:-1], strict=True)]
    project = [sum((float(inv[i, j]) * d[j] for j in range(len(d))), F.lit(0.0)) for i in range(len(d))]
    h = sum((a * b for a, b in zip(d, project, strict=True)), F.lit(1.0 / n))
    rows = rows.withColumns({"residual": F.col(y) - linear(model.coefficients, features), "leverage": h})
    e, h, mse = F.col("residual"), F.col("leverage"), model.stats["mse"]
    left = F.sqrt(F.greatest(F.lit(0.0), ((n - p) * mse - e * e / (1 - h)) / (n - p - 1)))  # sd without the row
    rows = rows.withColumn("__s", left)
    s = F.col("__s")
    own = [sum((float(inv[i, j]) * d[j] for j in range(len(d))), F.lit(0.0)) * e / (1 - h) / (s * float(np.sqrt(inv[i, i]))) for i in range(len(d))]
    return rows.withColumns({
        "studentized": e / (s * F.sqrt(1 - h)),
        "cooks_distance": e * e * h / (p * mse * F.pow(1 - h, 2)),
        "dffits": e * F.sqrt(h) / (s * (1 - h)),
        "dfbetas": F.array(*own),
    }).drop("__s")


def residual_tests(df: DataFrame, residual: str, order: str, series: list[str] = ()) -> DataFrame:
    """Durbin-Watson in the given order, and Jarque-Bera with its p-value."""
    from pyspark.sql import Window

    if series:
        lag = F.lag(residual).over(Window.partitionBy(*series).orderBy(order))
        rows = df.withColumn("__d", F.col(residual) - lag)
    else:
        from ..plans.order import with_row_index

        rows = with_row_index(df.select(F.col(residual).alias("__e"), F.col(order).alias("__o")), "__o", name="__i")
        prior = rows.select((F.col("__i") + 1).alias("__j"), F.col("__e").alias("__p"))
        rows = rows.join(prior, F.col("__i") == F.col("__j"), "left").select(F.col("__e").alias(residual), (F.col("__e") - F.col("__p")).alias("__d"))
    e, n = observed(residual), F.count(observed(residual)).cast("double")
    jb = n / 6 * (F.pow(F.skewness(e), 2) + F.pow(F.kurtosis(e), 2) / 4)
    out = rows.groupBy(*series).agg((F.sum(F.col("__d") * F.col("__d")) / F.sum(e * e)).alias("durbin_watson"), jb.alias("jarque_bera"))
    return out.withColumn("jb_p_value", special.column("chi2_sf", F.col("jarque_bera"), F.lit(2.0)))


def breusch_pagan(df: DataFrame, features: list[str], residual: str, squares: bool = False) -> DataFrame:
    """n R2 of the squared residuals on the features; with ``squares`` White's test, with squares and products."""
    rows = complete(df, [*features, residual])
    names, cols = list(features), {}
    if squares:
        for i, a in enumerate(features):
            for b in features[i:]:
                cols[f"{a}__{b}"] = F.col(a) * F.col(b)
        names += list(cols)
    rows = rows.withColumns({**cols, "__e2": F.col(residual) * F.col(residual)})
    model = ordinary(rows, names, "__e2")
    stat = model.n * model.stats["r2"]
    return df.sparkSession.createDataFrame([(float(stat), float(len(names)), float(special.chi2_sf(stat, len(names))))], "statistic double, df double, p_value double")


def reset_test(df: DataFrame, features: list[str], y: str, powers: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Ramsey's test: do powers of the fitted values add to the fit?"""
    small = ordinary(df, features, y)
    rows = complete(df, [*features, y]).withColumn("__f", linear(small.coefficients, features))
    s = rows.agg(F.avg("__f").alias("m"), F.stddev_pop("__f").alias("s")).first()
    z = (F.col("__f") - s["m"]) / (s["s"] or 1.0)
    names = [f"__f{k}" for k in powers]
    large = ordinary(rows.withColumns({n: F.pow(z, k) for n, k in zip(names, powers, strict=True)}), [*features, *names], y)
    q, free = len(powers), large.n - len(features) - len(powers) - 1
    f = (small.stats["rss"] - large.stats["rss"]) / q / (large.stats["rss"] / free)
    return df.sparkSession.createDataFrame([(float(f), float(q), float(free), float(special.f_sf(f, q, free)))], "statistic double, df1 double, df2 double, p_value double")


def condition_number(df: DataFrame, features: list[str]) -> float:
    """Root of the ratio of the extreme eigenvalues of X'X, intercept included."""
    rows = complete(df, features)
    g = matrix(rows.agg(*products([F.lit(1.0), *map(F.col, features)])).first(), len(features) + 1)
    e = np.linalg.eigvalsh(g)
    return float(np.sqrt(e[-1] / e[0])) if e[0] > 0 else float("inf")


def icc(df: DataFrame, x: str, group: str) -> DataFrame:
    """Intraclass correlation from one-way ANOVA with unequal group sizes."""
    v = observed(x)
    c = df.where(v.isNotNull()).groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    s = c.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.col("s2")).alias("ssw"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("t"),
    )
    msb = (F.col("q") - F.col("t") * F.col("t") / F.col("all")) / (F.col("k") - 1)
    msw = F.col("ssw") / (F.col("all") - F.col("k"))
    n0 = (F.col("all") - F.col("sq") / F.col("all")) / (F.col("k") - 1)
    return s.select(((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"), msb.alias("ms_between"), msw.alias("ms_within"), n0.alias("n0"))
