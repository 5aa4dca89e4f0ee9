"""Special functions over numpy arrays, and as Spark columns.

The numpy functions broadcast like ufuncs.  ``column`` turns any of them into an
Arrow-batched pandas UDF; nothing here works row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300
#: Values that are worked on at once: their temporaries stay in a core's cache.
_BLOCK = 4096


def _blocked(f: Callable) -> Callable:
    """The ufunc-like f over blocks of its broadcast arguments; each block's iteration ends on its own."""

    @wraps(f)
    def run(*args):
        args = [np.asarray(a, float) for a in args]
        shape = np.broadcast_shapes(*(a.shape for a in args))
        size = int(np.prod(shape))
        if size <= _BLOCK:
            return f(*args)
        flat = [a.ravel() if a.shape == shape else a if not a.ndim else np.broadcast_to(a, shape).ravel() for a in args]
        out = np.empty(size)
        for i in range(0, size, _BLOCK):
            out[i : i + _BLOCK] = f(*(a[i : i + _BLOCK] if a.ndim else a for a in flat))
        return out.reshape(shape)

    return run


@_blocked
def gamma_ln(x):
    """log |gamma(x)|: Stirling's series, above 12 after a product of 12 factors, reflection below 1/2; NaN at poles."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        low = x < 0.5
        y = np.where(low, 1 - x, x)
        small = y < 12
        base = np.where(small, y, 1.0)
        product = base.copy()
        for k in range(1, 12):
            product = product * (base + k)
        y = np.where(small, y + 12, y)
        r = 1 / (y * y)
        series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
        up = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.where(small, np.log(product), 0.0)
        if not low.any():
            return up
        out = np.where(low, np.log(np.pi) - np.log(np.abs(np.sin(np.pi * x))) - up, up)
        return np.where((x <= 0) & (x == np.floor(x)), np.nan, out)


@_blocked
def gamma(x):
    """The gamma function, with its sign for negative arguments."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
        return sign * np.exp(gamma_ln(x))


def log_factorial(n):
    return gamma_ln(np.asarray(n, float) + 1)


def factorial(n):
    return np.rint(np.exp(log_factorial(n))) if np.all(np.asarray(n) < 15) else np.exp(log_factorial(n))


def log_binomial(n, k):
    return log_factorial(n) - log_factorial(k) - log_factorial(np.asarray(n, float) - k)


def binomial(n, k):
    """Binomial coefficients; 0 outside 0 <= k <= n."""
    n, k = np.broadcast_arrays(np.asarray(n, float), np.asarray(k, float))
    inside = (k >= 0) & (k <= n)
    value = np.exp(log_binomial(n, np.where(inside, k, 0)))
    return np.where(inside, np.where(value < 1e15, np.rint(value), value), 0.0)


def beta_ln(a, b):
    return gamma_ln(a) + gamma_ln(b) - gamma_ln(np.asarray(a, float) + b)


def beta(a, b):
    return np.exp(beta_ln(a, b))


def _gamma_series(a, x):
    """gamma_p by its power series, for x below a + 1."""
    term = 1 / a
    total = term.copy()
    n = a.copy()
    for _ in range(600):
        n += 1
        term *= x
        term /= n
        total += term
        if term.max() <= _EPS * total.min() or np.all(term <= total * _EPS):
            break
    return np.exp(a * np.log(np.maximum(x, _TINY)) - x - gamma_ln(a)) * total


def _gamma_fraction(a, x):
    """1 - gamma_p by its continued fraction, for x from a + 1."""
    b = x + 1 - a
    c = np.full_like(b, 1 / _TINY)
    d = 1 / np.where(b == 0, _TINY, b)
    h = d.copy()
    for i in range(1, 600):
        an = i * (a - i)
        b += 2
        d *= an
        d += b
        c = b + an / c
        if d.min() <= 0 or c.min() <= 0:
            d, c = (np.where(np.abs(v) < _TINY, _TINY, v) for v in (d, c))
        d = 1 / d
        step = d * c
        h *= step
        if np.all(np.abs(step - 1) < _EPS):
            break
    return np.exp(a * np.log(x) - x - gamma_ln(a)) * h


@_blocked
def gamma_p(a, x):
    """The regularised lower incomplete gamma function."""
    shape = np.broadcast_shapes(a.shape, x.shape)
    a, x = (np.broadcast_to(v, shape).ravel() for v in (a, x))
    out = np.where(np.isnan(a) | np.isnan(x) | (a <= 0), np.nan, np.where(x <= 0, 0.0, 1.0))
    with np.errstate(all="ignore"):
        some = (x > 0) & np.isfinite(x) & (a > 0)
        low = some & (x < a + 1)
        if low.any():
            out[low] = _gamma_series(a[low], x[low])
        high = some & ~low & ~np.isnan(a)
        if high.any():
            out[high] = 1 - _gamma_fraction(a[high], x[high])
    return out.reshape(shape)


@_blocked
def beta_i(x, a, b):
    """The regularised incomplete beta function."""
    x, a, b = np.broadcast_arrays(x, a, b)
    with np.errstate(all="ignore"):
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(p * np.log(np.maximum(z, _TINY)) + q * np.log1p(-np.minimum(z, 1 - 1e-17)) - beta_ln(p, q)) / p
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        h = d.copy()
        both = p + q
        for m in range(1, 800):
            k = p + 2 * m
            for num in (m * (q - m) * z / ((k - 1) * k), -(p + m) * (both + m) * z / (k * (k + 1))):
                d *= num
                d += 1
                c = num / c
                c += 1
                if not (np.abs(d).min() >= _TINY and np.abs(c).min() >= _TINY):
                    d, c = (np.where(np.abs(v) < _TINY, _TINY, v) for v in (d, c))
                d = 1 / d
                step = d * c
                h *= step
            if np.all(np.abs(step - 1) < _EPS):
                break
        out = np.where(swap, 1 - front * h, front * h)
        out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
        return np.where(np.isnan(x) | np.isnan(a) | np.isnan(b), np.nan, out)


#: Nodes in a unit of erf's table, and its end.
_NODES, _END = 64, 6


def _erf_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each node erf, erfc and the next eight coefficients of erf's Taylor series, which are Hermite polynomials."""
    x = np.arange(_NODES * _END + 1) / _NODES
    h = [np.ones_like(x), 2 * x]
    for n in range(1, 7):
        h.append(2 * x * h[n] - 2 * n * h[n - 1])
    front = 2 / math.sqrt(math.pi) * np.exp(-x * x)
    series = np.array([(-1) ** n * front * h[n] / math.factorial(n + 1) for n in range(8)])
    return np.array([math.erf(v) for v in x]), np.array([math.erfc(v) for v in x]), series


_ERF, _ERFC, _SERIES = _erf_table()


def _beside_node(a, terms: int = 6):
    """Each value's node, and what erf adds from there; far from 0 a small remainder needs more terms."""
    node = np.rint(a * _NODES).astype(np.intp)
    h = a - node / _NODES
    total = _SERIES[terms - 1].take(node)
    for n in range(terms - 2, -1, -1):
        total *= h
        total += _SERIES[n].take(node)
    total *= h
    return node, total


@_blocked
def erf(x):
    """The error function, by Taylor series at the nodes of a table."""
    a = np.minimum(np.abs(x), float(_END))
    node, more = _beside_node(np.where(np.isnan(a), 0.0, a))
    return np.where(np.isnan(x), np.nan, np.copysign(np.minimum(_ERF.take(node) + more, 1.0), x))


@_blocked
def erfc(x):
    """1 - erf, exact in the upper tail too, where its asymptotic series takes over."""
    a = np.minimum(np.abs(x), float(_END))
    a = np.where(np.isnan(a), 0.0, a)
    node, more = _beside_node(a, 8 if a.max(initial=0.0) > 2 else 6)
    out = np.where(x < 0, 1 + np.minimum(_ERF.take(node) + more, 1.0), _ERFC.take(node) - more)
    far = x > _END
    if np.any(far):
        v = np.where(far, x, 10.0)
        r = 1 / (2 * v * v)
        term = total = np.ones_like(v)
        for n in range(1, 30):
            term = -term * (2 * n - 1) * r
            total = total + term
        out = np.where(far, np.exp(-v * v) / (v * math.sqrt(math.pi)) * total, out)
    return np.where(np.isnan(x), np.nan, out)


def digamma(x):
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    for _ in range(12):
        small = x < 12
        out = out - np.where(small, 1 / np.where(small, x, 1.0), 0.0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))


def normal_cdf(x):
    x = np.asarray(x, float)
    tail = 0.5 * (1 - gamma_p(0.5, x * x / 2))  # not by erf: the tails stay exact
    return np.where(x < 0, tail, 1 - tail)


def normal_pdf(x):
    return np.exp(-0.5 * np.square(np.asarray(x, float))) / np.sqrt(2 * np.pi)


def solve_quantile(cdf: Callable, p, low, high, rounds: int = 200):
    """The x of each p by bisection, after the bracket has grown to hold it."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, float(low)), np.full(p.shape, float(high))
    for _ in range(200):
        short = cdf(b) < p
        if not short.any():
            break
        b = np.where(short, b + 2 * (b - a), b)
    for _ in range(200):
        over = cdf(a) > p
        if not over.any() or np.isfinite(low) and low == 0:
            break
        a = np.where(over, a - 2 * (b - a), a)
    for _ in range(rounds):
        mid = 0.5 * (a + b)
        under = cdf(mid) < p
        a, b = np.where(under, mid, a), np.where(under, b, mid)
        if np.all(b - a <= 1e-14 * np.maximum(1, np.abs(a))):
            break
    return 0.5 * (a + b)


def normal_quantile(p):
    p = np.asarray(p, float)
    x = solve_quantile(normal_cdf, np.clip(p, 1e-300, 1 - 1e-16), -8.0, 8.0)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def t_cdf(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_i(df / (df + t * t), df / 2, 0.5)
    return np.where(t < 0, tail, 1 - tail)


def t_two_sided(t, df):
    """The two-sided p-value of a t statistic."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_i(df / (df + t * t), df / 2, 0.5)


def t_quantile(p, df):
    return solve_quantile(lambda x: t_cdf(x, df), p, -50.0, 50.0)


def chi2_sf(x, df):
    return 1 - gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi2_quantile(p, df):
    return solve_quantile(lambda x: gamma_p(np.asarray(df, float) / 2, x / 2), p, 0.0, 100.0)


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_i(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_two_sided(z):
    return 2 * normal_cdf(-np.abs(np.asarray(z, float)))


def gamma_quantile(p, a):
    """The x at which the regularised lower incomplete gamma function reaches p."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float))
    x = solve_quantile(lambda x: gamma_p(a, x), np.clip(p, 0, 1 - 1e-16), 0.0, 100.0)
    return np.where(p <= 0, 0.0, np.where(p >= 1, np.inf, x))


def beta_quantile(p, a, b):
    p = np.asarray(p, float)
    low, high = np.zeros(np.broadcast(p, a, b).shape), np.ones(np.broadcast(p, a, b).shape)
    for _ in range(90):
        mid = 0.5 * (low + high)
        under = beta_i(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(p >= 1, 1.0, 0.5 * (low + high))


def t_pdf(x, df):
    x, df = np.asarray(x, float), np.asarray(df, float)
    return np.exp(-(df + 1) / 2 * np.log1p(x * x / df) - beta_ln(0.5, df / 2)) / np.sqrt(df)


def chi2_cdf(x, df):
    return gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi2_pdf(x, df):
    x, df = np.asarray(x, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        return np.where(x > 0, np.exp((df / 2 - 1) * np.log(x) - x / 2 - df / 2 * np.log(2) - gamma_ln(df / 2)), 0.0)


def f_cdf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return np.where(f > 0, beta_i(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2), 0.0)


def f_pdf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        log = d1 / 2 * np.log(d1 * f) + d2 / 2 * np.log(d2) - (d1 + d2) / 2 * np.log(d1 * f + d2) - np.log(f) - beta_ln(d1 / 2, d2 / 2)
        return np.where(f > 0, np.exp(log), 0.0)


def gamma_cdf(x, shape, rate):
    return gamma_p(shape, np.maximum(0, np.asarray(x, float) * np.asarray(rate, float)))


def beta_cdf(x, a, b):
    return beta_i(x, a, b)


_ANGLES = (np.arange(400) + 0.5) * np.pi / 400


def bessel_i0e(x):
    """exp(-x) I0(x), by the midpoint rule over a period, which is exact but for rounding."""
    x = np.asarray(x, float)
    return np.exp(x[..., None] * (np.cos(_ANGLES) - 1)).mean(axis=-1)


def bessel_ratio(x):
    """I1(x) / I0(x)."""
    x = np.asarray(x, float)
    return (np.exp(x[..., None] * (np.cos(_ANGLES) - 1)) * np.cos(_ANGLES)).mean(axis=-1) / bessel_i0e(x)


def _von_mises_series(mu, kappa) -> Callable:
    """The cdf, not clipped, of arrays of one shape: a Fourier series in the ratios of Bessel functions, which are made once for each different kappa."""
    kinds, at = np.unique(kappa, return_inverse=True)
    at, j = at.reshape(kappa.shape), np.arange(1, 120)
    weight = np.exp(kinds[:, None] * (np.cos(_ANGLES) - 1))
    terms = (weight / weight.sum(axis=-1, keepdims=True)) @ np.cos(j * _ANGLES[:, None]) / (j * np.pi)
    last = np.flatnonzero(~(np.abs(terms) <= 1e-18).all(axis=0))
    terms = [np.ascontiguousarray(t)[at] if len(kinds) > 1 else t[0] for t in terms.T[: last[-1] + 1 if len(last) else 1]]

    def sines(t):  # by Clenshaw's recursion
        twice, one, two = 2 * np.cos(t), np.zeros(np.shape(t)), np.zeros(np.shape(t))
        for c in reversed(terms):
            one, two = c + twice * one - two, one
        return np.sin(t) * one

    start = sines(np.pi + mu)
    return lambda x: (x + np.pi) / (2 * np.pi) + sines(x - mu) + start


def von_mises_cdf(x, mu, kappa):
    """The share of angles from -pi to x."""
    x, mu, kappa = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, mu, kappa)))
    return np.clip(_von_mises_series(mu, kappa)(x), 0, 1) if x.size else x.copy()


def von_mises_quantile(p, mu, kappa):
    p, mu, kappa = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, mu, kappa)))
    low, high = np.full(p.shape, -np.pi), np.full(p.shape, np.pi)
    if not p.size:
        return low
    cdf = _von_mises_series(mu, kappa)
    for _ in range(52):
        mid = 0.5 * (low + high)
        under = np.clip(cdf(mid), 0, 1) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return 0.5 * (low + high)


def _least_count(cdf: Callable, p, most) -> np.ndarray:
    """The least whole number up to most whose cdf reaches p, by bisection."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -1.0), np.broadcast_to(np.asarray(most, float), p.shape).copy()
    while np.any(high - low > 1):
        mid = np.floor(0.5 * (low + high))
        enough = cdf(mid) >= p * (1 - 1e-13)
        move = high - low > 1
        low, high = np.where(move & ~enough, mid, low), np.where(move & enough, mid, high)
    return high


def binomial_quantile(p, n, q):
    n, q = np.asarray(n, float), np.asarray(q, float)
    return _least_count(lambda k: np.where(k >= n, 1.0, beta_i(1 - q, np.maximum(n - k, 1e-9), k + 1)), p, n)


def poisson_quantile(p, rate):
    rate = np.asarray(rate, float)
    most = np.ceil(rate + 40 * np.sqrt(rate + 1) + 100)
    return np.where(np.asarray(p) >= 1, np.inf, _least_count(lambda k: 1 - gamma_p(k + 1, rate), p, most))


def negative_binomial_quantile(p, r, q):
    r, q = np.asarray(r, float), np.asarray(q, float)
    most = np.ceil((r * (1 - q) + 60 * np.sqrt(r * (1 - q) + 1)) / q + 100 / q)
    return np.where(np.asarray(p) >= 1, np.inf, _least_count(lambda k: beta_i(q, r, k + 1), p, most))


def hypergeometric_cdf(x, population, marked, draws):
    """The chance of at most x marked ones among the draws: the probabilities summed."""
    x, N, K, n = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, population, marked, draws)))
    out = np.zeros(x.shape)
    for k in range(int(np.nanmax(np.minimum(n, K), initial=0)) + 1):
        inside = (k <= x) & (k >= n - (N - K)) & (k <= np.minimum(n, K))
        with np.errstate(all="ignore"):
            out = out + np.where(inside, np.exp(log_binomial(K, k) + log_binomial(N - K, n - k) - log_binomial(N, n)), 0.0)
    return np.minimum(out, 1.0)


def hypergeometric_quantile(p, population, marked, draws):
    most = np.minimum(np.asarray(marked, float), np.asarray(draws, float))
    return _least_count(lambda k: hypergeometric_cdf(k, population, marked, draws), p, most)


def kolmogorov_sf(d, n):
    """The asymptotic p-value of a Kolmogorov-Smirnov distance at effective size n."""
    d, n = np.broadcast_arrays(np.asarray(d, float), np.asarray(n, float))
    x = (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n)) * d
    k = np.arange(1, 101)
    total = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * (k * x[..., None]) ** 2), axis=-1)
    return np.clip(np.where(x < 0.2, 1.0, total), 0, 1)


def f_quantile(p, d1, d2):
    """Quantiles of F, by those of the beta distribution that it stands for."""
    d1, d2 = np.asarray(d1, float), np.asarray(d2, float)
    b = beta_quantile(p, d1 / 2, d2 / 2)
    return d2 * b / (d1 * np.maximum(1 - b, 1e-300))


#: Half shifts from which a noncentral tail is that of a normal variable.
_FAR = 20_000.0


def _poisson_mixture(tail: Callable, shift) -> np.ndarray:
    """The mean of tail(k) over a Poisson number k with mean shift / 2, as far as its weights reach."""
    mean = np.minimum(np.asarray(shift, float) / 2, _FAR)
    most = float(np.max(mean, initial=0.0))
    total = np.zeros(mean.shape)
    for k in range(max(0, int(np.min(mean, initial=most) - 9 * np.sqrt(most) - 20)), int(most + 9 * np.sqrt(most) + 40)):
        weight = np.exp(k * np.log(np.maximum(mean, 1e-300)) - mean - gamma_ln(k + 1.0))
        total = total + np.where((mean == 0) & (k == 0), 1.0, weight) * tail(k)
    return np.clip(total, 0, 1)


def noncentral_chi2_sf(x, df, shift):
    """The chance that a chi-squared variable whose mean is moved by ``shift`` exceeds x."""
    x, df, shift = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, df, shift)))
    far = normal_cdf((df + shift - x) / np.sqrt(2 * (df + 2 * shift)))
    return np.where(shift > 2 * _FAR, far, _poisson_mixture(lambda k: chi2_sf(x, df + 2 * k), shift))


def noncentral_f_sf(x, d1, d2, shift):
    """The chance that an F variable whose numerator is moved by ``shift`` exceeds x."""
    x, d1, d2, shift = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, d1, d2, shift)))
    y = d1 * x / (d1 * x + d2)
    far = normal_cdf((d1 + shift - d1 * x) / np.sqrt(2 * (d1 + 2 * shift) + 2 * (d1 * x) ** 2 / d2))
    return np.where(shift > 2 * _FAR, far, _poisson_mixture(lambda k: beta_i(1 - y, d2 / 2, d1 / 2 + k), shift))


_FUNCTIONS: dict[str, Callable] = {f.__name__: f for f in (gamma_ln, gamma, log_factorial, factorial, log_binomial, binomial, beta_ln, beta, gamma_p, beta_i, erf, erfc, digamma, normal_cdf, normal_pdf, normal_quantile, t_cdf, t_two_sided, t_quantile, chi2_sf, chi2_quantile, f_sf, normal_two_sided, kolmogorov_sf, gamma_quantile, beta_quantile, t_pdf, chi2_cdf, chi2_pdf, f_cdf, f_pdf, gamma_cdf, beta_cdf, bessel_i0e, bessel_ratio, von_mises_cdf, von_mises_quantile, binomial_quantile, poisson_quantile, negative_binomial_quantile, hypergeometric_cdf, hypergeometric_quantile, f_quantile, noncentral_chi2_sf, noncentral_f_sf)}


def column(name: str, *args: Column | str | float) -> Column:
    """A special function of columns or numbers; null where an argument is null."""
    f = _FUNCTIONS[name]

    def batch(*series: pd.Series) -> pd.Series:
        values = [s.to_numpy(float, na_value=np.nan) for s in series]
        if name.endswith("_quantile") and len(values[0]):  # solved once for equal arguments
            rows, at = np.unique(np.column_stack(values), axis=0, return_inverse=True)
            return pd.Series(np.asarray(f(*np.ascontiguousarray(rows.T)))[at.ravel()], dtype=float)
        return pd.Series(f(*values), dtype=float)

    udf = F.pandas_udf(_arity(batch, len(args)), DoubleType())
    cols = [F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(float(a)) for a in args]
    value = udf(*[c.cast("double") for c in cols])
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    return F.when(~missing, value)


def _arity(f: Callable, n: int) -> Callable:
    """pandas UDFs want a fixed number of arguments."""
    if n == 1:
        return lambda a: f(a)
    if n == 2:
        return lambda a, b: f(a, b)
    if n == 3:
        return lambda a, b, c: f(a, b, c)
    return lambda a, b, c, d: f(a, b, c, d)
