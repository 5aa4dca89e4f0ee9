"""Multivariate distributions over array columns: densities as Spark expressions or Arrow batches, draws by keys.

Draws depend on seed and key alone, however Spark deals the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import special


def _lower(matrix) -> np.ndarray:
    a = np.asarray(matrix, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1] or not np.allclose(a, a.T):
        raise ValueError("a symmetric matrix")
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        raise ValueError("a positive definite matrix") from None


def _quadratic(x: Column, mean: np.ndarray, low: np.ndarray) -> Column:
    """(x - mean)' (low low')^-1 (x - mean), by forward substitution in columns."""
    z: list[Column] = []
    for i in range(len(mean)):
        rest = x[i].cast("double") - F.lit(float(mean[i]))
        for j in range(i):
            if low[i, j]:
                rest = rest - F.lit(float(low[i, j])) * z[j]
        z.append(rest / F.lit(float(low[i, i])))
    return sum((v * v for v in z), F.lit(0.0))


def _draws(spark: SparkSession, n: int, seed: int, make) -> DataFrame:
    """Rows (id, x): make(generator) of each id."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def draw(ids: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(make(np.random.Generator(np.random.PCG64([seed, int(i)])))).ravel().tolist() for i in ids])

    return spark.range(n).select("id", draw("id").alias("x"))


@dataclass(frozen=True)
class MultivariateNormal:
    mean: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]

    def log_pdf(self, x: Column) -> Column:
        """Of an array column."""
        low = _lower(self.covariance)
        return -0.5 * (_quadratic(x, np.array(self.mean), low) + len(self.mean) * float(np.log(2 * np.pi))) - float(np.log(np.diag(low)).sum())

    def pdf(self, x: Column) -> Column:
        return F.exp(self.log_pdf(x))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        low, mean = _lower(self.covariance), np.array(self.mean)
        return _draws(spark, n, seed, lambda r: mean + low @ r.standard_normal(len(mean)))


@dataclass(frozen=True)
class MultivariateT:
    df: float
    location: tuple[float, ...]
    scale: tuple[tuple[float, ...], ...]

    def log_pdf(self, x: Column) -> Column:
        low, d = _lower(self.scale), len(self.location)
        const = float(special.gamma_ln((self.df + d) / 2) - special.gamma_ln(self.df / 2) - d / 2 * np.log(self.df * np.pi) - np.log(np.diag(low)).sum())
        return F.lit(const) - (self.df + d) / 2 * F.log1p(_quadratic(x, np.array(self.location), low) / self.df)

    def pdf(self, x: Column) -> Column:
        return F.exp(self.log_pdf(x))

    def covariance(self) -> np.ndarray:
        """Undefined (nan) up to two degrees of freedom."""
        return np.asarray(self.scale) * (self.df / (self.df - 2) if self.df > 2 else np.nan)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        low, at = _lower(self.scale), np.array(self.location)
        return _draws(spark, n, seed, lambda r: at + low @ r.standard_normal(len(at)) / np.sqrt(r.chisquare(self.df) / self.df))


@dataclass(frozen=True)
class Dirichlet:
    alpha: tuple[float, ...]

    def __post_init__(self):
        if len(self.alpha) < 2 or min(self.alpha) <= 0:
            raise ValueError("two positive parameters, at least")

    def log_pdf(self, x: Column) -> Column:
        """-inf where an element isn't positive or they don't add up to 1 within 1e-6."""
        const = float(special.gamma_ln(sum(self.alpha)) - sum(special.gamma_ln(a) for a in self.alpha))
        parts = [x[i].cast("double") for i in range(len(self.alpha))]
        inside = F.abs(sum(parts, F.lit(-1.0))) < 1e-6
        for p in parts:
            inside = inside & (p > 0)
        value = sum(((a - 1) * F.ln(p) for a, p in zip(self.alpha, parts, strict=True)), F.lit(const))
        return F.when(x.isNotNull(), F.when(inside, value).otherwise(float("-inf")))

    def pdf(self, x: Column) -> Column:
        return F.exp(self.log_pdf(x))

    def mean(self) -> np.ndarray:
        return np.array(self.alpha) / sum(self.alpha)

    def covariance(self) -> np.ndarray:
        m = self.mean()
        return (np.diag(m) - np.outer(m, m)) / (sum(self.alpha) + 1)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return _draws(spark, n, seed, lambda r: r.dirichlet(self.alpha))


@dataclass(frozen=True)
class Multinomial:
    n: int
    p: tuple[float, ...]

    def __post_init__(self):
        if self.n < 0 or min(self.p) < 0 or abs(sum(self.p) - 1) > 1e-9:
            raise ValueError("a number of draws, and chances that add up to 1")

    def log_pmf(self, x: Column) -> Column:
        """-inf where counts are negative or don't add up to n."""
        parts = [x[i].cast("double") for i in range(len(self.p))]
        inside = sum(parts, F.lit(0.0)) == float(self.n)
        value = F.lit(float(special.gamma_ln(self.n + 1.0)))
        for q, c in zip(self.p, parts, strict=True):
            inside = inside & (c >= 0) & (c == F.floor(c))
            if q == 0:
                inside = inside & (c == 0)
            else:
                value = value + c * float(np.log(q)) - special.column("gamma_ln", F.greatest(c, F.lit(0.0)) + 1)
        return F.when(x.isNotNull(), F.when(inside, value).otherwise(float("-inf")))

    def pmf(self, x: Column) -> Column:
        return F.exp(self.log_pmf(x))

    def mean(self) -> np.ndarray:
        return self.n * np.array(self.p)

    def covariance(self) -> np.ndarray:
        p = np.array(self.p)
        return self.n * (np.diag(p) - np.outer(p, p))

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        return _draws(spark, n, seed, lambda r: r.multinomial(self.n, self.p).astype(float))


def _log_gamma_of(a: float, d: int) -> float:
    """The log of the multivariate gamma function."""
    return d * (d - 1) / 4 * float(np.log(np.pi)) + float(sum(special.gamma_ln(a - i / 2) for i in range(d)))


def _matrix_log_pdf(x: Column, d: int, each) -> Column:
    """each(matrices) over a column of matrices, written by rows; -inf where one isn't positive definite."""

    @F.pandas_udf(DoubleType())
    def run(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        for i, flat in enumerate(v):
            if flat is None:
                continue
            m = np.asarray(flat, float).reshape(d, d)
            out[i] = each(m) if np.allclose(m, m.T) and np.linalg.eigvalsh(m)[0] > 0 else -np.inf
        return pd.Series(out)

    return F.when(x.isNotNull(), run(x))


@dataclass(frozen=True)
class Wishart:
    """Of symmetric matrices, as arrays by rows."""

    df: float
    scale: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        if self.df <= len(_lower(self.scale)) - 1:
            raise ValueError("more degrees of freedom than dimensions less one")

    def log_pdf(self, x: Column) -> Column:
        v = np.asarray(self.scale, float)
        d, inverse = len(v), np.linalg.inv(v)
        const = -self.df * d / 2 * np.log(2) - self.df / 2 * np.linalg.slogdet(v)[1] - _log_gamma_of(self.df / 2, d)
        return _matrix_log_pdf(x, d, lambda m: const + (self.df - d - 1) / 2 * np.linalg.slogdet(m)[1] - np.trace(inverse @ m) / 2)

    def mean(self) -> np.ndarray:
        return self.df * np.asarray(self.scale)

    def _bartlett(self, r: np.random.Generator) -> np.ndarray:
        low = _lower(self.scale)
        d = len(low)
        a = np.tril(r.standard_normal((d, d)), -1) + np.diag(np.sqrt(r.chisquare(self.df - np.arange(d))))
        b = low @ a
        return b @ b.T

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """By Bartlett's decomposition."""
        return _draws(spark, n, seed, self._bartlett)


@dataclass(frozen=True)
class InverseWishart:
    """Of the inverses of Wishart matrices with the inverse scale."""

    df: float
    scale: tuple[tuple[float, ...], ...]

    def __post_init__(self):
        if self.df <= len(_lower(self.scale)) - 1:
            raise ValueError("more degrees of freedom than dimensions less one")

    def log_pdf(self, x: Column) -> Column:
        v = np.asarray(self.scale, float)
        d = len(v)
        const = self.df / 2 * np.linalg.slogdet(v)[1] - self.df * d / 2 * np.log(2) - _log_gamma_of(self.df / 2, d)
        return _matrix_log_pdf(x, d, lambda m: const - (self.df + d + 1) / 2 * np.linalg.slogdet(m)[1] - np.trace(v @ np.linalg.inv(m)) / 2)

    def mean(self) -> np.ndarray:
        """Undefined (nan) unless there are two degrees of freedom more than dimensions."""
        d = len(self.scale)
        return np.asarray(self.scale) * (1 / (self.df - d - 1) if self.df > d + 1 else np.nan)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        own = Wishart(self.df, tuple(map(tuple, np.linalg.inv(np.asarray(self.scale, float)))))
        return _draws(spark, n, seed, lambda r: np.linalg.inv(own._bartlett(r)))
