"""Gaussian mixtures in several dimensions, all numbers of components in one scan a round."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.gram import centred
from .regression import complete

#: Rows, those of least hash, from which the starts are chosen.
START_ROWS = 1000


@dataclass
class Mixture:
    """Weights, means and covariances of the components, and how well they fit."""

    features: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float
    n: int
    rounds: int
    converged: bool

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.parameters * float(np.log(self.n))

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.parameters

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (component, weight, mean, covariance): arrays, the covariance by rows."""
        rows = [(j, float(self.weights[j]), self.means[j].tolist(), self.covariances[j].ravel().tolist()) for j in range(len(self.weights))]
        return spark.createDataFrame(rows, "component int, weight double, mean array<double>, covariance array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds component, the likeliest one, and probability, its chance; nulls for rows with a missing value."""
        names = self.features

        def run(batches):
            for batch in batches:
                x = np.column_stack([batch.column(f"__x{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]).astype(float)
                known = np.isfinite(x).all(axis=1)
                logs = _log_parts(np.where(known[:, None], x, 0.0), self.weights, self.means, self.covariances)
                top = logs.argmax(axis=1)
                p = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                own = batch.schema.names[: -len(names)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(top.astype(np.int32), mask=~known), pa.array(p, mask=~known)], [*own, "component", "probability"])

        rows = df.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(names)})
        schema = rows.select(*[F.col(f"`{c}`") for c in df.columns], F.lit(0).alias("component"), F.lit(0.0).alias("probability")).schema
        for f in schema:
            f.nullable = True
        return rows.mapInArrow(run, schema)


def _log_parts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Log weight and density of each row under each component."""
    d = x.shape[1]
    out = np.empty((len(x), len(weights)))
    for j, (w, m, c) in enumerate(zip(weights, means, covariances, strict=True)):
        low = np.linalg.cholesky(c)
        z = np.linalg.solve(low, (x - m).T)
        out[:, j] = np.log(max(w, 1e-300)) - 0.5 * ((z * z).sum(axis=0) + d * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
    return out


def _moments(models: dict[int, tuple], d: int):
    """Each task's sums for all models: log likelihood, and weight, first and second moments of each component."""

    def run(batches):
        sums = {k: (np.zeros(1), np.zeros((k, 1 + d + d * d))) for k in models}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            terms = np.column_stack([np.ones(len(x)), x, (x[:, :, None] * x[:, None]).reshape(len(x), -1)])
            for k, model in models.items():
                logs = _log_parts(x, *model)
                top = logs.max(axis=1, keepdims=True)
                share = np.exp(logs - top)
                total = share.sum(axis=1, keepdims=True)
                sums[k][0][0] += float((top + np.log(total)).sum())
                sums[k][1][...] += (share / total).T @ terms
        ks, at, v = [], [], []
        for k, (ll, m) in sums.items():
            flat = np.append(ll, m.ravel())
            ks += [k] * len(flat)
            at += range(len(flat))
            v += flat.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(at, pa.int32()), pa.array(v, pa.float64())], ["k", "at", "v"])

    return run


def _starts(x: np.ndarray, k: int, cov: np.ndarray, seed: int) -> tuple:
    """Centres far from each other (squared distance as chance), with equal weights and the whole covariance, shrunk."""
    r = np.random.default_rng([seed, k])
    scale = np.sqrt(np.diag(cov))
    z = x / np.where(scale > 0, scale, 1.0)
    chosen = [int(r.integers(len(x)))]
    while len(chosen) < k:
        d = ((z[:, None] - z[chosen]) ** 2).sum(-1).min(axis=1)
        chosen.append(int(r.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(r.integers(len(x))))
    return np.full(k, 1 / k), x[chosen].copy(), np.repeat(cov[None] / k ** (2 / x.shape[1]), k, axis=0)


def fit_mixtures(df: DataFrame, features: list[str], most: int, rounds: int = 200, tol: float = 1e-6, seed: int = 0, floor: float = 1e-6) -> dict[int, Mixture]:
    """Mixtures with 1 to ``most`` components by EM, with full covariances.

    A round reads the rows once for all mixtures that still move; a task returns
    a few sums for each component.  A mixture is done when its mean log
    likelihood rises by less than ``tol``.  ``floor`` times the whole variance is
    added to the diagonals, so a component can't collapse onto one row.  Starts
    come from ``START_ROWS`` rows; rows with a missing value don't count.
    """
    rows = complete(df, features)
    n, mean, s = centred(rows, features)
    cov, d = s / n, len(features)
    spread = np.where(np.diag(cov) > 0, np.diag(cov), 1.0)
    cov = cov + floor * np.diag(spread)
    key = F.xxhash64(*[F.col(c) for c in features])
    sample = rows.select(*features).orderBy(key, *features).limit(START_ROWS).toPandas().to_numpy(float) - mean
    moved = rows.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(features, mean, strict=True)]).persist()
    done: dict[int, Mixture] = {}
    try:
        models = {k: _starts(sample, k, cov, seed) for k in range(1, min(most, len(sample)) + 1)}
        last = dict.fromkeys(models, -np.inf)
        for turn in range(1, rounds + 1):
            found = moved.mapInArrow(_moments(models, d), "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).toPandas()
            for k, part in found.groupby("k"):
                flat = part.sort_values("at")["v"].to_numpy()
                ll, m = flat[0], flat[1:].reshape(k, -1)
                over = ll - last[k] < tol * n
                if over or turn == rounds:
                    w, mu, c = models.pop(k)
                    done[int(k)] = Mixture(features, w, mu + mean, c, float(ll), n, turn, bool(over))
                    continue
                last[k] = ll
                mass = np.maximum(m[:, 0], 1e-300)
                mu = m[:, 1 : 1 + d] / mass[:, None]
                c = m[:, 1 + d :].reshape(k, d, d) / mass[:, None, None] - mu[:, :, None] * mu[:, None]
                models[k] = (m[:, 0] / n, mu, (c + c.transpose(0, 2, 1)) / 2 + floor * np.diag(spread))
            if not models:
                break
    finally:
        moved.unpersist()
    return done


def select_components(df: DataFrame, features: list[str], most: int, **options) -> tuple[Mixture, dict[int, float]]:
    """(the mixture of least bic, bic by number of components)."""
    fits = fit_mixtures(df, features, most, **options)
    return min(fits.values(), key=lambda m: m.bic), {k: m.bic for k, m in sorted(fits.items())}
