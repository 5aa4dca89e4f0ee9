"""Curves as rows (curve, t, y): smoothing by a basis, means, inner products and principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.gram import centred, products
from .descriptive import observed


@dataclass(frozen=True)
class Basis:
    """Functions on an interval: ``polynomial`` of a degree, ``fourier`` or ``bspline`` of a size, as ``functions.vectors`` has them."""

    kind: str
    size: int
    low: float = 0.0
    high: float = 1.0

    def __post_init__(self):
        if self.kind not in ("polynomial", "fourier", "bspline") or self.size < 1 or not self.low < self.high:
            raise ValueError("a known basis with a positive size on an interval")

    def column(self, t: str | Column) -> Column:
        """The functions' values as an array."""
        if self.kind == "polynomial":
            return vectors.polynomial_basis(t, self.size - 1, self.low, self.high)
        return (vectors.fourier_basis if self.kind == "fourier" else vectors.bspline_basis)(t, self.size, self.low, self.high)

    def value(self, coefficients: str, t: str | Column) -> Column:
        """The curve with an array column of coefficients, at t."""
        both = F.zip_with(F.col(coefficients), self.column(t), lambda c, f: c * f)
        return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)

    def metric(self, spark: SparkSession, points: int = 100) -> np.ndarray:
        """The integrals of products of the functions, by the trapezoidal rule over ``points`` steps."""
        step = (self.high - self.low) / points
        rows = spark.range(points + 1).select(self.column(F.lit(self.low) + F.col("id") * step).alias("f"), "id").orderBy("id").collect()  # one row a step
        f = np.array([r["f"] for r in rows])
        w = np.full(points + 1, step)
        w[[0, -1]] /= 2
        return f.T @ (w[:, None] * f)


def smooth_curves(df: DataFrame, curve: list[str], t: str, y: str, basis: Basis, penalty: float = 0.0) -> DataFrame:
    """Rows (curve, n, coefficients): least squares of each curve on the basis, with ``penalty`` times the squared coefficients.

    One aggregate of products for all curves, which are solved in Arrow batches;
    a curve with too few different times gets its shortest solution.
    """
    rows = df.select(*curve, F.col(t).cast("double").alias("__t"), observed(y).alias("__y")).dropna(subset=["__t", "__y"])
    rows = rows.withColumn("__f", basis.column("__t"))
    size = basis.size
    cols = [*[F.col("__f")[k] for k in range(size)], F.col("__y")]
    sums = rows.groupBy(*curve).agg(F.count(F.lit(1)).alias("n"), *products(cols))
    names = [f"g{i}_{j}" for i in range(size + 1) for j in range(i, size + 1)]
    packed = sums.select(*curve, "n", F.array(*names).alias("g"))
    upper = np.triu_indices(size + 1)

    def solve(batches):
        for batch in batches:
            m = len(batch)
            flat = batch.column("g").flatten().to_numpy(zero_copy_only=False).reshape(m, -1)
            g = np.zeros((m, size + 1, size + 1))
            g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = flat
            a = g[:, :size, :size] + penalty * np.eye(size)
            b = g[:, :size, size]
            good = np.linalg.cond(a) < 1e12 if m else np.zeros(0, bool)
            c = np.empty((m, size))
            c[good] = np.linalg.solve(a[good], b[good][..., None])[..., 0] if good.any() else 0.0
            for k in np.flatnonzero(~good):
                c[k] = np.linalg.pinv(a[k], rcond=1e-12, hermitian=True) @ b[k]
            out = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * size), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in curve), batch.column("n"), out], [*curve, "n", "coefficients"])

    kinds = dict(sums.dtypes)
    return packed.mapInArrow(solve, ", ".join([*(f"`{c}` {kinds[c]}" for c in curve), "n long", "coefficients array<double>"]))


def inner_product(a: str | Column, b: str | Column, metric: np.ndarray) -> Column:
    """The inner product of two curves from their coefficients, under ``Basis.metric``."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    n = len(metric)
    return sum((float(metric[i, j]) * x[i] * y[j] for i in range(n) for j in range(n) if metric[i, j]), F.lit(0.0))


def norm(a: str | Column, metric: np.ndarray) -> Column:
    return F.sqrt(F.greatest(inner_product(a, a, metric), F.lit(0.0)))


def mean_curve(df: DataFrame, curve: list[str], t: str, y: str, grid: list[float]) -> DataFrame:
    """Rows (t, n, mean): the mean of all curves at each place of a grid, each curve drawn out by straight lines.

    A curve keeps its first and last value beyond its ends.  Of rows of a curve
    with one time, the mean counts.
    """
    rows = df.select(*curve, F.col(t).cast("double").alias("__t"), observed(y).alias("__y")).dropna(subset=["__t", "__y"])
    rows = rows.groupBy(*curve, "__t").agg(F.avg("__y").alias("__y"))
    w = Window.partitionBy(*curve).orderBy("__t")
    rows = rows.withColumns({"__u": F.lead("__t").over(w), "__v": F.lead("__y").over(w), "__b": F.lag("__t").over(w)})
    places = F.array(*[F.lit(float(g)) for g in grid])
    mine = F.filter(places, lambda g: ((g >= F.col("__t")) | F.col("__b").isNull()) & ((g < F.col("__u")) | F.col("__u").isNull()))
    at = rows.withColumn("t", F.explode(mine))
    inside = (F.col("t") > F.col("__t")) & F.col("__u").isNotNull()
    value = F.when(inside, F.col("__y") + (F.col("__v") - F.col("__y")) * (F.col("t") - F.col("__t")) / (F.col("__u") - F.col("__t"))).otherwise(F.col("__y"))
    return at.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


@dataclass
class CurveComponents:
    """Eigenvalues, components (rows: coefficients of the eigenfunctions) and the mean's coefficients."""

    values: np.ndarray
    components: np.ndarray
    mean: np.ndarray
    explained: np.ndarray
    metric: np.ndarray

    def transform(self, curves: DataFrame, coefficients: str = "coefficients") -> DataFrame:
        """Adds scores: an array, the inner products of a curve less the mean with each component."""
        weight = self.components @ self.metric
        scores = [sum((float(w) * (F.col(coefficients)[j] - float(m)) for j, (w, m) in enumerate(zip(row, self.mean, strict=True)) if w), F.lit(0.0)) for row in weight]
        return curves.withColumn("scores", F.array(*scores))


def curve_components(curves: DataFrame, size: int, k: int | None = None, metric: np.ndarray | None = None, coefficients: str = "coefficients") -> CurveComponents:
    """Principal components of curves from their coefficients (``smooth_curves``), which one matrix of products gives.

    Without ``metric`` the coefficients are taken as they are; with
    ``Basis.metric`` lengths and angles are those of the functions.  Each
    component has its largest coefficient positive.
    """
    names = [f"c{j}" for j in range(size)]
    wide = curves.select(*[F.col(coefficients)[j].alias(c) for j, c in enumerate(names)])
    n, mean, s = centred(wide, names)
    if n < 2:
        raise ValueError("two curves, at least")
    w = np.eye(size) if metric is None else np.asarray(metric, float)
    low = np.linalg.cholesky(w + 1e-14 * np.trace(w) * np.eye(size))
    values, vectors_ = np.linalg.eigh(low.T @ (s / (n - 1)) @ low)
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0)
    components = np.linalg.solve(low.T, vectors_[:, order]).T
    components *= np.sign(components[np.arange(size), np.abs(components).argmax(axis=1)])[:, None]
    k = min(k or size, size, n)
    total = values.sum() or 1.0
    return CurveComponents(values[:k], components[:k], mean, values[:k] / total, w)
