"""Probability distributions as Spark columns.

``distribution("weibull", 2.0, 1.5)`` has pdf, cdf, quantile, survival, mean and
variance; its parameters may be numbers or columns, so every row can have its
own.  Closed forms are plain expressions that stay in generated code; the rest
calls one of the Arrow-batched special functions.  A null argument gives null.
Discrete distributions have their probabilities as ``pdf`` and take the least
value whose cdf reaches p as the quantile.  Quantiles of p outside 0..1 are null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import special

_EULER = 0.5772156649015329
_NAN, _INF = float("nan"), float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _s(name: str, *args) -> Column:
    return special.column(name, *args)


def _gamma(x: Column) -> Column:
    return _s("gamma", x)


def _when(inside: Column, value: Column, other: float = 0.0) -> Column:
    return F.when(inside, value).when(~inside, F.lit(other))


@dataclass(frozen=True)
class Family:
    """Functions of (x or p, *parameters), and moments of the parameters."""

    parameters: tuple[str, ...]
    pdf: Callable
    cdf: Callable
    quantile: Callable
    mean: Callable
    variance: Callable
    discrete: bool = False


@dataclass(frozen=True)
class Distribution:
    """A family with its parameters."""

    family: Family
    values: tuple[Column, ...]

    def pdf(self, x) -> Column:
        return self.family.pdf(_c(x), *self.values)

    def log_pdf(self, x) -> Column:
        p = self.pdf(x)
        return F.when(p > 0, F.ln(p)).when(p == 0, F.lit(-_INF))

    def cdf(self, x) -> Column:
        x = _c(x)
        return self.family.cdf(F.floor(x).cast("double") if self.family.discrete else x, *self.values)

    def survival(self, x) -> Column:
        return 1 - self.cdf(x)

    def quantile(self, p) -> Column:
        p = _c(p)
        return F.when((p >= 0) & (p <= 1), self.family.quantile(p, *self.values))

    def mean(self) -> Column:
        return self.family.mean(*self.values)

    def variance(self) -> Column:
        return self.family.variance(*self.values)

    def sd(self) -> Column:
        return F.sqrt(self.variance())

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """Rows (id, x): the quantiles of uniform numbers that depend on seed and id alone, however Spark deals the rows."""
        return spark.range(n).select("id", self.quantile(uniform(F.col("id"), seed)).alias("x"))


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) for each key: a hash of key and seed."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), key), 11).cast("double") + 0.5) / float(1 << 53)


def _z(x, m, s):
    return (x - m) / s


def _gev_t(x, mu, sigma, xi):
    z = _z(x, mu, sigma)
    return F.when(xi == 0, F.exp(-z)).otherwise(F.pow(F.greatest(1 + xi * z, F.lit(0.0)), -1 / F.when(xi == 0, 1.0).otherwise(xi)))


def _gev_pdf(x, mu, sigma, xi):
    t = _gev_t(x, mu, sigma, xi)
    return _when((xi == 0) | (1 + xi * _z(x, mu, sigma) > 0), F.pow(t, xi + 1) * F.exp(-t) / sigma)


def _gev_cdf(x, mu, sigma, xi):
    inside = (xi == 0) | (1 + xi * _z(x, mu, sigma) > 0)
    return F.when(inside, F.exp(-_gev_t(x, mu, sigma, xi))).when(~inside, F.when(xi > 0, 0.0).otherwise(1.0))


def _gev_q(p, mu, sigma, xi):
    y = -F.ln(p)
    return mu + sigma * F.when(xi == 0, -F.ln(y)).otherwise((F.pow(y, -xi) - 1) / F.when(xi == 0, 1.0).otherwise(xi))


def _gev_g(k, xi):
    return _gamma(1 - k * xi)


def _gev_var(mu, sigma, xi):
    spread = (_gev_g(2, xi) - F.pow(_gev_g(1, xi), 2)) / F.pow(F.when(xi == 0, 1.0).otherwise(xi), 2)
    return sigma * sigma * F.when(xi == 0, math.pi**2 / 6).when(xi < 0.5, spread).otherwise(_INF)


def _gpd_tail(x, mu, sigma, xi, power=0.0):
    z = _z(x, mu, sigma)
    one = F.when(xi == 0, 1.0).otherwise(xi)
    return F.when(xi == 0, F.exp(-z)).otherwise(F.pow(F.greatest(1 + xi * z, F.lit(0.0)), -1 / one - power))


def _gpd_in(x, mu, sigma, xi):
    return (x >= mu) & ((xi >= 0) | (x <= mu - sigma / F.when(xi < 0, xi).otherwise(-1.0)))


def _truncated(f: Callable) -> Callable:
    def run(x, mu, sigma, a, b):
        low, high = _s("normal_cdf", _z(a, mu, sigma)), _s("normal_cdf", _z(b, mu, sigma))
        return f(x, mu, sigma, a, b, low, high)

    return run


def _trunc_moments(mu, sigma, a, b):
    za, zb = _z(a, mu, sigma), _z(b, mu, sigma)
    mass = _s("normal_cdf", zb) - _s("normal_cdf", za)
    pa, pb = _s("normal_pdf", za), _s("normal_pdf", zb)
    ratio = (pa - pb) / mass
    edges = (F.when(F.abs(za) < _INF, za * pa).otherwise(0.0) - F.when(F.abs(zb) < _INF, zb * pb).otherwise(0.0)) / mass
    return mu + sigma * ratio, sigma * sigma * (1 + edges - ratio * ratio)


def _lchoose(n, k) -> Column:
    return _s("log_binomial", n, k)


def _whole(x) -> Column:
    return x == F.floor(x)


def _count(inside: Column, log_p: Column) -> Column:
    return _when(inside, F.exp(log_p))


def _xlny(x, y) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.ln(y))


FAMILIES: dict[str, Family] = {
    "beta": Family(
        ("alpha", "beta"),
        lambda x, a, b: _when((x > 0) & (x < 1), F.exp((a - 1) * F.ln(x) + (b - 1) * F.log1p(-x) - _s("beta_ln", a, b))),
        lambda x, a, b: _s("beta_i", x, a, b),
        lambda p, a, b: _s("beta_quantile", p, a, b),
        lambda a, b: a / (a + b),
        lambda a, b: a * b / ((a + b) * (a + b) * (a + b + 1)),
    ),
    "cauchy": Family(
        ("location", "scale"),
        lambda x, m, s: 1 / (math.pi * s * (1 + F.pow(_z(x, m, s), 2))),
        lambda x, m, s: 0.5 + F.atan(_z(x, m, s)) / math.pi,
        lambda p, m, s: m + s * F.tan(math.pi * (p - 0.5)),
        lambda m, s: F.lit(_NAN),
        lambda m, s: F.lit(_NAN),
    ),
    "chi_squared": Family(
        ("df",),
        lambda x, k: _when(x > 0, F.exp((k / 2 - 1) * F.ln(x) - x / 2 - k / 2 * math.log(2) - _s("gamma_ln", k / 2))),
        lambda x, k: _s("gamma_p", k / 2, x / 2),
        lambda p, k: 2 * _s("gamma_quantile", p, k / 2),
        lambda k: k,
        lambda k: 2 * k,
    ),
    "exponential": Family(
        ("rate",),
        lambda x, r: _when(x >= 0, r * F.exp(-r * x)),
        lambda x, r: _when(x >= 0, -F.expm1(-r * x)),
        lambda p, r: -F.log1p(-p) / r,
        lambda r: 1 / r,
        lambda r: 1 / (r * r),
    ),
    "f": Family(
        ("d1", "d2"),
        lambda x, m, n: _when(x > 0, F.exp(m / 2 * F.ln(m * x) + n / 2 * F.ln(n) - (m + n) / 2 * F.ln(m * x + n) - F.ln(x) - _s("beta_ln", m / 2, n / 2))),
        lambda x, m, n: _when(x > 0, _s("beta_i", m * x / (m * x + n), m / 2, n / 2)),
        lambda p, m, n: (lambda b: n * b / (m * (1 - b)))(_s("beta_quantile", p, m / 2, n / 2)),
        lambda m, n: F.when(n > 2, n / (n - 2)).otherwise(_NAN),
        lambda m, n: F.when(n > 4, 2 * n * n * (m + n - 2) / (m * F.pow(n - 2, 2) * (n - 4))).otherwise(_NAN),
    ),
    "frechet": Family(
        ("shape", "scale", "location"),
        lambda x, a, s, m: _when(x > m, a / s * F.pow(_z(x, m, s), -1 - a) * F.exp(-F.pow(_z(x, m, s), -a))),
        lambda x, a, s, m: _when(x > m, F.exp(-F.pow(_z(x, m, s), -a))),
        lambda p, a, s, m: m + s * F.pow(-F.ln(p), -1 / a),
        lambda a, s, m: F.when(a > 1, m + s * _gamma(1 - 1 / a)).otherwise(_INF),
        lambda a, s, m: F.when(a > 2, s * s * (_gamma(1 - 2 / a) - F.pow(_gamma(1 - 1 / a), 2))).otherwise(_INF),
    ),
    "gamma": Family(
        ("shape", "rate"),
        lambda x, a, r: _when(x > 0, F.exp(a * F.ln(r) + (a - 1) * F.ln(x) - r * x - _s("gamma_ln", a))),
        lambda x, a, r: _s("gamma_p", a, r * x),
        lambda p, a, r: _s("gamma_quantile", p, a) / r,
        lambda a, r: a / r,
        lambda a, r: a / (r * r),
    ),
    "gev": Family(
        ("location", "scale", "shape"),
        _gev_pdf,
        _gev_cdf,
        _gev_q,
        lambda mu, s, xi: mu + s * F.when(xi == 0, _EULER).when(xi < 1, (_gev_g(1, xi) - 1) / F.when(xi == 0, 1.0).otherwise(xi)).otherwise(_INF),
        _gev_var,
    ),
    "gpd": Family(
        ("location", "scale", "shape"),
        lambda x, mu, s, xi: _when(_gpd_in(x, mu, s, xi), _gpd_tail(x, mu, s, xi, 1.0) / s),
        lambda x, mu, s, xi: F.when(x < mu, 0.0).otherwise(1 - F.when(_gpd_in(x, mu, s, xi), _gpd_tail(x, mu, s, xi)).otherwise(0.0)),
        lambda p, mu, s, xi: mu + s * F.when(xi == 0, -F.log1p(-p)).otherwise((F.pow(1 - p, -xi) - 1) / F.when(xi == 0, 1.0).otherwise(xi)),
        lambda mu, s, xi: F.when(xi < 1, mu + s / (1 - xi)).otherwise(_INF),
        lambda mu, s, xi: F.when(xi < 0.5, s * s / (F.pow(1 - xi, 2) * (1 - 2 * xi))).otherwise(_INF),
    ),
    "gumbel": Family(
        ("location", "scale"),
        lambda x, m, b: F.exp(-_z(x, m, b) - F.exp(-_z(x, m, b))) / b,
        lambda x, m, b: F.exp(-F.exp(-_z(x, m, b))),
        lambda p, m, b: m - b * F.ln(-F.ln(p)),
        lambda m, b: m + _EULER * b,
        lambda m, b: math.pi**2 / 6 * b * b,
    ),
    "inverse_gamma": Family(
        ("alpha", "beta"),
        lambda x, a, b: _when(x > 0, F.exp(a * F.ln(b) - (a + 1) * F.ln(x) - b / x - _s("gamma_ln", a))),
        lambda x, a, b: _when(x > 0, 1 - _s("gamma_p", a, b / x)),
        lambda p, a, b: b / _s("gamma_quantile", 1 - p, a),
        lambda a, b: F.when(a > 1, b / (a - 1)).otherwise(_INF),
        lambda a, b: F.when(a > 2, b * b / (F.pow(a - 1, 2) * (a - 2))).otherwise(_INF),
    ),
    "laplace": Family(
        ("location", "scale"),
        lambda x, m, b: F.exp(-F.abs(x - m) / b) / (2 * b),
        lambda x, m, b: F.when(x < m, F.exp((x - m) / b) / 2).otherwise(1 - F.exp((m - x) / b) / 2),
        lambda p, m, b: m - b * F.signum(p - 0.5) * F.log1p(-2 * F.abs(p - 0.5)),
        lambda m, b: m,
        lambda m, b: 2 * b * b,
    ),
    "levy": Family(
        ("location", "scale"),
        lambda x, m, c: _when(x > m, F.sqrt(c / (2 * math.pi)) * F.exp(-c / (2 * (x - m))) / F.pow(x - m, 1.5)),
        lambda x, m, c: _when(x > m, _s("erfc", F.sqrt(c / (2 * (x - m))))),
        lambda p, m, c: m + c / F.pow(_s("normal_quantile", 1 - p / 2), 2),
        lambda m, c: F.lit(_INF),
        lambda m, c: F.lit(_INF),
    ),
    "log_logistic": Family(
        ("scale", "shape"),
        lambda x, a, b: _when(x > 0, b / a * F.pow(x / a, b - 1) / F.pow(1 + F.pow(x / a, b), 2)),
        lambda x, a, b: _when(x > 0, 1 / (1 + F.pow(x / a, -b))),
        lambda p, a, b: a * F.pow(p / (1 - p), 1 / b),
        lambda a, b: F.when(b > 1, a * (math.pi / b) / F.sin(math.pi / b)).otherwise(_INF),
        lambda a, b: F.when(b > 2, a * a * (2 * (math.pi / b) / F.sin(2 * math.pi / b) - F.pow((math.pi / b) / F.sin(math.pi / b), 2))).otherwise(_INF),
    ),
    "log_normal": Family(
        ("mu", "sigma"),
        lambda x, m, s: _when(x > 0, F.exp(-F.pow(_z(F.ln(x), m, s), 2) / 2) / (x * s * math.sqrt(2 * math.pi))),
        lambda x, m, s: _when(x > 0, _s("normal_cdf", _z(F.ln(x), m, s))),
        lambda p, m, s: F.exp(m + s * _s("normal_quantile", p)),
        lambda m, s: F.exp(m + s * s / 2),
        lambda m, s: F.expm1(s * s) * F.exp(2 * m + s * s),
    ),
    "normal": Family(
        ("mu", "sigma"),
        lambda x, m, s: F.exp(-F.pow(_z(x, m, s), 2) / 2) / (s * math.sqrt(2 * math.pi)),
        lambda x, m, s: _s("normal_cdf", _z(x, m, s)),
        lambda p, m, s: m + s * _s("normal_quantile", p),
        lambda m, s: m,
        lambda m, s: s * s,
    ),
    "pareto": Family(
        ("shape", "least"),
        lambda x, a, m: _when(x >= m, a * F.pow(m, a) / F.pow(x, a + 1)),
        lambda x, a, m: _when(x >= m, 1 - F.pow(m / x, a)),
        lambda p, a, m: m * F.pow(1 - p, -1 / a),
        lambda a, m: F.when(a > 1, a * m / (a - 1)).otherwise(_INF),
        lambda a, m: F.when(a > 2, a * m * m / (F.pow(a - 1, 2) * (a - 2))).otherwise(_INF),
    ),
    "rayleigh": Family(
        ("sigma",),
        lambda x, s: _when(x >= 0, x / (s * s) * F.exp(-x * x / (2 * s * s))),
        lambda x, s: _when(x >= 0, -F.expm1(-x * x / (2 * s * s))),
        lambda p, s: s * F.sqrt(-2 * F.log1p(-p)),
        lambda s: s * math.sqrt(math.pi / 2),
        lambda s: (4 - math.pi) / 2 * s * s,
    ),
    "student_t": Family(
        ("df",),
        lambda x, n: F.exp(-(n + 1) / 2 * F.log1p(x * x / n) - _s("beta_ln", F.lit(0.5), n / 2)) / F.sqrt(n),
        lambda x, n: _s("t_cdf", x, n),
        lambda p, n: _s("t_quantile", p, n),
        lambda n: F.when(n > 1, 0.0).otherwise(_NAN),
        lambda n: F.when(n > 2, n / (n - 2)).when(n > 1, _INF).otherwise(_NAN),
    ),
    "truncated_normal": Family(
        ("mu", "sigma", "a", "b"),
        _truncated(lambda x, m, s, a, b, low, high: _when((x >= a) & (x <= b), F.exp(-F.pow(_z(x, m, s), 2) / 2) / (s * math.sqrt(2 * math.pi) * (high - low)))),
        _truncated(lambda x, m, s, a, b, low, high: F.when(x <= a, 0.0).when(x >= b, 1.0).otherwise((_s("normal_cdf", _z(x, m, s)) - low) / (high - low))),
        _truncated(lambda p, m, s, a, b, low, high: m + s * _s("normal_quantile", low + p * (high - low))),
        lambda *v: _trunc_moments(*v)[0],
        lambda *v: _trunc_moments(*v)[1],
    ),
    "uniform": Family(
        ("a", "b"),
        lambda x, a, b: _when((x >= a) & (x <= b), 1 / (b - a)),
        lambda x, a, b: F.when(x <= a, 0.0).when(x >= b, 1.0).otherwise((x - a) / (b - a)),
        lambda p, a, b: a + p * (b - a),
        lambda a, b: (a + b) / 2,
        lambda a, b: F.pow(b - a, 2) / 12,
    ),
    "von_mises": Family(
        ("mu", "kappa"),
        lambda x, m, k: _when((x >= -math.pi) & (x <= math.pi), F.exp(k * (F.cos(x - m) - 1)) / (2 * math.pi * _s("bessel_i0e", k))),
        lambda x, m, k: F.when(x <= -math.pi, 0.0).when(x >= math.pi, 1.0).otherwise(_s("von_mises_cdf", x, m, k)),
        lambda p, m, k: _s("von_mises_quantile", p, m, k),
        lambda m, k: m,
        lambda m, k: 1 - _s("bessel_ratio", k),
    ),
    "weibull": Family(
        ("shape", "scale"),
        lambda x, k, s: _when(x >= 0, k / s * F.pow(x / s, k - 1) * F.exp(-F.pow(x / s, k))),
        lambda x, k, s: _when(x >= 0, -F.expm1(-F.pow(x / s, k))),
        lambda p, k, s: s * F.pow(-F.log1p(-p), 1 / k),
        lambda k, s: s * _gamma(1 + 1 / k),
        lambda k, s: s * s * (_gamma(1 + 2 / k) - F.pow(_gamma(1 + 1 / k), 2)),
    ),
    "bernoulli": Family(
        ("p",),
        lambda x, p: F.when(x == 1, p).when(x == 0, 1 - p).when(x.isNotNull(), 0.0),
        lambda x, p: F.when(x < 0, 0.0).when(x < 1, 1 - p).when(x.isNotNull(), 1.0),
        lambda q, p: F.when(q <= 1 - p, 0.0).otherwise(1.0),
        lambda p: p,
        lambda p: p * (1 - p),
        True,
    ),
    "binomial": Family(
        ("n", "p"),
        lambda x, n, p: _count(_whole(x) & (x >= 0) & (x <= n), _lchoose(n, x) + _xlny(x, p) + _xlny(n - x, 1 - p)),
        lambda x, n, p: F.when(x < 0, 0.0).when(x >= n, 1.0).otherwise(_s("beta_i", 1 - p, n - x, x + 1)),
        lambda q, n, p: _s("binomial_quantile", q, n, p),
        lambda n, p: n * p,
        lambda n, p: n * p * (1 - p),
        True,
    ),
    "discrete_uniform": Family(
        ("a", "b"),
        lambda x, a, b: _when(_whole(x) & (x >= a) & (x <= b), 1 / (b - a + 1)),
        lambda x, a, b: F.when(x < a, 0.0).when(x >= b, 1.0).otherwise((x - a + 1) / (b - a + 1)),
        lambda q, a, b: F.greatest(a, a - 1 + F.ceil(q * (b - a + 1) - 1e-12)),
        lambda a, b: (a + b) / 2,
        lambda a, b: (F.pow(b - a + 1, 2) - 1) / 12,
        True,
    ),
    "geometric": Family(
        ("p",),
        lambda x, p: _when(_whole(x) & (x >= 0), p * F.pow(1 - p, x)),
        lambda x, p: _when(x >= 0, 1 - F.pow(1 - p, x + 1)),
        lambda q, p: F.greatest(F.lit(0.0), F.ceil(F.log1p(-q) / F.log1p(-p) - 1e-12).cast("double") - 1),
        lambda p: (1 - p) / p,
        lambda p: (1 - p) / (p * p),
        True,
    ),
    "hypergeometric": Family(
        ("population", "marked", "draws"),
        lambda x, N, K, n: _count(_whole(x) & (x >= F.greatest(F.lit(0.0), n - (N - K))) & (x <= F.least(n, K)), _lchoose(K, x) + _lchoose(N - K, n - x) - _lchoose(N, n)),
        lambda x, N, K, n: _s("hypergeometric_cdf", x, N, K, n),
        lambda q, N, K, n: _s("hypergeometric_quantile", q, N, K, n),
        lambda N, K, n: n * K / N,
        lambda N, K, n: n * (K / N) * (1 - K / N) * (N - n) / (N - 1),
        True,
    ),
    "negative_binomial": Family(
        ("r", "p"),
        lambda x, r, p: _count(_whole(x) & (x >= 0), _lchoose(x + r - 1, x) + r * F.ln(p) + _xlny(x, 1 - p)),
        lambda x, r, p: _when(x >= 0, _s("beta_i", p, r, x + 1)),
        lambda q, r, p: _s("negative_binomial_quantile", q, r, p),
        lambda r, p: r * (1 - p) / p,
        lambda r, p: r * (1 - p) / (p * p),
        True,
    ),
    "poisson": Family(
        ("rate",),
        lambda x, r: _count(_whole(x) & (x >= 0), _xlny(x, r) - r - _s("log_factorial", x)),
        lambda x, r: _when(x >= 0, 1 - _s("gamma_p", x + 1, r)),
        lambda q, r: _s("poisson_quantile", q, r),
        lambda r: r,
        lambda r: r,
        True,
    ),
    "zero_inflated_poisson": Family(
        ("rate", "zeros"),
        lambda x, r, z: F.when(x == 0, z).when(x.isNotNull(), 0.0) + (1 - z) * FAMILIES["poisson"].pdf(x, r),
        lambda x, r, z: _when(x >= 0, z + (1 - z) * FAMILIES["poisson"].cdf(x, r)),
        lambda q, r, z: F.when(q <= z, 0.0).otherwise(_s("poisson_quantile", (q - z) / (1 - z), r)),
        lambda r, z: (1 - z) * r,
        lambda r, z: (1 - z) * r * (1 + z * r),
        True,
    ),
}


def distribution(name: str, *parameters: Column | str | float) -> Distribution:
    """A distribution by the name of its family; parameters in the family's order."""
    family = FAMILIES[name]
    if len(parameters) != len(family.parameters):
        raise ValueError(f"{name} takes {', '.join(family.parameters)}")
    return Distribution(family, tuple(_c(p) for p in parameters))
