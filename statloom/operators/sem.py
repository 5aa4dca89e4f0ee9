"""Structural models of a correlation matrix, which one aggregate over the rows gives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import special
from ..plans.gram import centred
from .regression import complete


def correlations(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """(rows, correlation matrix) over the complete rows; a constant column correlates with nothing."""
    n, _, s = centred(complete(df, columns), columns)
    d = np.sqrt(np.diag(s))
    unit = np.where(d > 0, d, 1.0)
    r = s / np.outer(unit, unit)
    np.fill_diagonal(r, 1.0)
    return n, r


def fit_indices(observed: np.ndarray, implied: np.ndarray, n: int, free: int) -> dict[str, float]:
    """Likelihood-ratio chi-squared of a fitted matrix with ``free`` parameters, and the indices made from it.

    chi_squared, df, p_value, rmsea, cfi and tli (against independence), srmr
    (with the diagonal), aic and bic.  A saturated model has p_value 1 and rmsea 0.
    """
    p = len(observed)
    _, log_implied = np.linalg.slogdet(implied)
    _, log_observed = np.linalg.slogdet(observed)
    gap = max(0.0, float(np.trace(np.linalg.solve(implied, observed)) + log_implied - log_observed - p))
    chi, df = (n - 1) * gap, p * (p + 1) // 2 - free
    _, log_alone = np.linalg.slogdet(np.diag(np.diag(observed)))
    null, null_df = (n - 1) * max(0.0, float(log_alone - log_observed)), p * (p - 1) // 2
    over, null_over = max(0.0, chi - df), max(0.0, null - null_df, chi - df)
    scale = np.sqrt(np.outer(np.diag(observed), np.diag(observed)))
    low = np.tril_indices(p)
    null_ratio = null / null_df if null_df else 0.0
    return {
        "chi_squared": chi,
        "df": float(df),
        "p_value": float(special.chi2_sf(chi, df)) if df > 0 else 1.0,
        "rmsea": float(np.sqrt(over / (df * (n - 1)))) if df > 0 else 0.0,
        "cfi": 1 - over / null_over if null_over > 0 else 1.0,
        "tli": (null_ratio - chi / df) / (null_ratio - 1) if df > 0 and null_ratio != 1 else 1.0,
        "srmr": float(np.sqrt((((observed - implied) / scale)[low] ** 2).mean())),
        "aic": chi + 2 * free,
        "bic": chi + free * float(np.log(n)),
    }


@dataclass
class Paths:
    """Standardised direct and total effects (rows: targets, columns: sources) and each target's R squared."""

    names: list[str]
    direct: np.ndarray
    total: np.ndarray
    r_squared: dict[str, float]
    n: int

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (source, target, direct, indirect, total) of the pairs with an effect."""
        rows = [(self.names[j], self.names[i], float(self.direct[i, j]), float(self.total[i, j] - self.direct[i, j]), float(self.total[i, j])) for i in range(len(self.names)) for j in range(len(self.names)) if i != j and (self.direct[i, j] or abs(self.total[i, j]) > 1e-12)]
        return spark.createDataFrame(rows, "source string, target string, direct double, indirect double, total double")


def path_analysis(df: DataFrame, paths: Sequence[tuple[str, str]], fixed: Mapping[tuple[str, str], float] | None = None) -> Paths:
    """Least squares of each target on its sources, from the correlations; ``fixed`` effects replace the estimated ones.

    Total effects are the sum over all directed ways, the inverse of one less the
    direct ones.  ``paths``: (source, target).
    """
    names = list(dict.fromkeys(v for path in paths for v in path))
    n, r = correlations(df, names)
    at = {v: k for k, v in enumerate(names)}
    direct, explained = np.zeros_like(r), {}
    for target in dict.fromkeys(t for _, t in paths):
        own = [at[s] for s, t in paths if t == target]
        b = np.linalg.lstsq(r[np.ix_(own, own)], r[own, at[target]], rcond=None)[0]
        explained[target] = float(b @ r[own, at[target]])
        direct[at[target], own] = b
    for (s, t), value in (fixed or {}).items():
        direct[at[t], at[s]] = value
    return Paths(names, direct, np.linalg.inv(np.eye(len(names)) - direct) - np.eye(len(names)), explained, n)


@dataclass
class Factors:
    """Loadings (rows: indicators, columns: factors), factor correlations, communalities and indices of fit."""

    indicators: list[str]
    factors: list[str]
    loadings: np.ndarray
    phi: np.ndarray
    communality: np.ndarray
    fit: dict[str, float]
    converged: bool
    n: int

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (factor, indicator, loading, communality, uniqueness)."""
        rows = [(f, v, float(self.loadings[i, k]), float(self.communality[i]), float(1 - self.communality[i])) for k, f in enumerate(self.factors) for i, v in enumerate(self.indicators) if self.loadings[i, k]]
        return spark.createDataFrame(rows, "factor string, indicator string, loading double, communality double, uniqueness double")


def confirmatory_factors(df: DataFrame, model: Mapping[str, Sequence[str]], fixed: Mapping[tuple[str, str], float] | None = None, correlated: bool = False, rounds: int = 500, tol: float = 1e-9) -> Factors:
    """Maximum likelihood of a factor model of the correlations: the indicators of each factor, all other loadings 0.

    Factors have variance 1 and, if ``correlated``, free correlations.  ``fixed``
    loadings are (factor, indicator): value.  Fisher scoring on the implied
    matrix, whose steps are halved until the likelihood rises; uniquenesses stay
    above 1e-6.  A factor's first free loading is positive.
    """
    factors = list(model)
    indicators = list(dict.fromkeys(v for vs in model.values() for v in vs))
    n, r = correlations(df, indicators)
    p, k = len(indicators), len(factors)
    row = {v: i for i, v in enumerate(indicators)}
    fixed = dict(fixed or {})
    cells = [(row[v], j) for j, f in enumerate(factors) for v in model[f] if (f, v) not in fixed]
    base = np.zeros((p, k))
    for (f, v), value in fixed.items():
        base[row[v], factors.index(f)] = value
    pairs = [(a, b) for a in range(k) for b in range(a)] if correlated else []

    def build(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loadings, phi = base.copy(), np.eye(k)
        for x, c in zip(t, cells):
            loadings[c] = x
        for x, (a, b) in zip(t[len(cells) :], pairs):
            phi[a, b] = phi[b, a] = x
        return loadings, phi, t[len(cells) + len(pairs) :]

    def implied(t: np.ndarray) -> np.ndarray:
        loadings, phi, unique = build(t)
        return loadings @ phi @ loadings.T + np.diag(unique)

    def loss(t: np.ndarray) -> float:
        s = implied(t)
        sign, log = np.linalg.slogdet(s)
        return float(np.trace(np.linalg.solve(s, r)) + log) if sign > 0 and np.linalg.eigvalsh(s)[0] > 0 else np.inf

    def slopes(t: np.ndarray) -> list[np.ndarray]:
        loadings, phi, _ = build(t)
        out, over = [], loadings @ phi
        for i, j in cells:
            d = np.zeros((p, p))
            d[i] += over[:, j]
            d[:, i] += over[:, j]
            out.append(d)
        out += [np.outer(loadings[:, a], loadings[:, b]) + np.outer(loadings[:, b], loadings[:, a]) for a, b in pairs]
        return out + [np.diag(np.eye(p)[i]) for i in range(p)]

    start = []
    for i, j in cells:
        others = [row[v] for v in model[factors[j]] if row[v] != i]
        lead = row[model[factors[j]][0]]
        start.append(0.7 * (np.sign(r[i, lead]) or 1.0) * min(1.0, float(np.abs(r[i, others]).mean()) ** 0.5 + 0.2 if others else 1.0))
    t = np.array([*start, *[0.0] * len(pairs), *[0.5] * p])
    low = np.array([*[-np.inf] * (len(cells) + len(pairs)), *[1e-6] * p])
    now, converged = loss(t), False
    for _ in range(rounds):
        inverse = np.linalg.inv(implied(t))
        weighted = [inverse @ d for d in slopes(t)]
        toward = inverse @ (r - implied(t))
        slope = np.array([np.sum(w * toward.T) for w in weighted])
        information = np.array([[np.sum(a * b.T) for b in weighted] for a in weighted])
        step = np.linalg.lstsq(information, slope, rcond=1e-12)[0]
        size = 1.0
        while size > 1e-8:
            new = np.maximum(t + size * step, low)
            value = loss(new)
            if value <= now:
                break
            size /= 2
        else:
            converged = True
            break
        moved, t, now = float(np.abs(new - t).max()), new, value
        if moved < tol:
            converged = True
            break
    loadings, phi, unique = build(t)
    for j, f in enumerate(factors):
        lead = next((i for i, c in cells if c == j), None)
        if lead is not None and loadings[lead, j] < 0 and not any(g == f for g, _ in fixed):
            loadings[:, j] *= -1
            phi[j], phi[:, j] = -phi[j], -phi[:, j]
            phi[j, j] = 1.0
    fit = fit_indices(r, implied(t), n, len(t))
    return Factors(indicators, factors, loadings, phi, np.diag(loadings @ phi @ loadings.T).copy(), fit, converged, n)
