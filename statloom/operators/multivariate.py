"""Multivariate analysis on feature columns or array columns.

Components and distances need one matrix of products; clusterings scan a
persisted projection once a round, with centres as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.gram import centred
from ..plans.order import staged
from . import bands
from .descriptive import beside, observed
from .regression import complete


def unpack(df: DataFrame, array: str, size: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """Array elements as feature columns."""
    names = [f"{prefix}{k}" for k in range(size)]
    return df.withColumns({n: F.col(array)[k].cast("double") for k, n in enumerate(names)}), names


@dataclass
class Components:
    """Means, scales, loadings (rows: components) and the share of variance of each."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray
    variance: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        z = [(F.col(c) - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return df.withColumns({f"{prefix}{k + 1}": sum((float(w) * v for w, v in zip(row, z, strict=True)), F.lit(0.0)) for k, row in enumerate(self.loadings)})


def principal_components(df: DataFrame, features: list[str], k: int | None = None, scale: bool = False) -> Components:
    """Eigenvectors of the covariance (or correlation) matrix; each has its largest loading positive."""
    n, mean, s = centred(complete(df, features), features)
    if n < 2:
        raise ValueError("there must be two complete rows")
    cov = s / (n - 1)
    unit = np.sqrt(np.diag(cov)) if scale else np.ones(len(features))
    unit = np.where(unit > 0, unit, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(unit, unit))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    k = k or len(features)
    return Components(features, mean, unit, vectors[:k], values[:k] / values.sum(), values[:k])


def mahalanobis(df: DataFrame, features: list[str], name: str = "mahalanobis") -> DataFrame:
    """Adds each row's distance from the mean under the sample covariance."""
    n, mean, s = centred(complete(df, features), features)
    inv = np.linalg.inv(s / (n - 1))
    d = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
    q = sum((float(inv[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    return df.withColumn(name, F.sqrt(q))


def _vector(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _nearest(x: str, centres: np.ndarray) -> Column:
    """The number and squared distance of the nearest centre of an array column."""
    options = [F.struct(F.pow(V.euclidean(x, _vector(c)), 2).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
    return F.array_min(F.array(*options))


def k_means(df: DataFrame, x: str, k: int, rounds: int = 100, tol: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, float, int]:
    """Centres, inertia and rounds of Lloyd's algorithm on an array column; k-means++ style seeding by distance-weighted keys.

    Every round is one scan with a partial aggregate of k * size numbers.
    """
    rows = df.select(F.transform(x, lambda v: v.cast("double")).alias("x"), F.monotonically_increasing_id().alias("i")).where("x is not null").persist()
    try:
        noise = F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) + 1e-12
        first = rows.agg(F.min_by("x", F.struct(noise, "x")).alias("x")).first()["x"]
        if first is None:
            raise ValueError("no rows")
        centres = [first]
        for c in range(1, k):  # the least exponential key with the distance as rate draws in proportion to it
            d = _nearest("x", np.array(centres))["d"]
            u = F.pmod(F.xxhash64("x", F.lit(seed + c)), F.lit(1 << 30)) / float(1 << 30) + 1e-12
            found = rows.where(d > 0).agg(F.min_by("x", F.struct(-F.ln(u) / d, "x")).alias("x")).first()["x"]
            if found is None:
                break
            centres.append(found)
        centres = np.array(centres)
        size, done, inertia = centres.shape[1], 0, 0.0
        while done < rounds:
            near = rows.select("x", _nearest("x", centres).alias("n"))
            sums = near.groupBy("n.k").agg(F.count(F.lit(1)).alias("c"), F.sum("n.d").alias("d"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(size)]).collect()  # k rows
            new = centres.copy()
            for r in sums:
                new[r["k"]] = [r[f"s{j}"] / r["c"] for j in range(size)]
            inertia, done = sum(r["d"] for r in sums), done + 1
            moved, centres = np.abs(new - centres).max(), new
            if moved < tol:
                break
    finally:
        rows.unpersist()
    return centres, inertia, done


def assign(df: DataFrame, x: str, centres: np.ndarray, name: str = "cluster") -> DataFrame:
    return df.withColumn(name, _nearest(x, centres)["k"])


def _centroids(df: DataFrame, x: str, label: str) -> DataFrame:
    """Mean vector c and size n of each cluster."""
    long = df.select(F.col(label).alias("k"), F.posexplode(x).alias("j", "v")).groupBy("k", "j").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return long.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("c"), F.max("n").alias("n"))  # as many rows as dimensions


def davies_bouldin(df: DataFrame, x: str, label: str) -> DataFrame:
    """The mean over clusters of the worst ratio of scatter to distance of centroids."""
    cent = _centroids(df, x, label)
    rows = df.select(F.col(label).alias("k"), F.col(x).alias("x")).join(F.broadcast(cent), "k")  # one row for each cluster
    scatter = rows.groupBy("k").agg(F.avg(V.euclidean("x", "c")).alias("s"), F.first("c").alias("c"))
    one, two = scatter.select(F.col("k").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca")), scatter.select(F.col("k").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    pairs = one.join(two, F.col("a") != F.col("b"))
    worst = pairs.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / V.euclidean("ca", "cb")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def centroid_silhouette(df: DataFrame, x: str, label: str) -> DataFrame:
    """Mean silhouette by squared Euclidean distances, without pairs of rows.

    The mean squared distance of a row to a cluster is its squared distance to the centroid plus the cluster's mean
    squared radius, so each row needs only k centroids.
    """
    cent = _centroids(df, x, label)
    rows = df.select(F.col(label).alias("k"), F.col(x).alias("x"))
    radius = rows.join(F.broadcast(cent), "k").groupBy("k").agg(F.avg(F.pow(V.euclidean("x", "c"), 2)).alias("w"))
    stats = cent.join(radius, "k").agg(F.collect_list(F.struct("k", "c", "n", "w")).alias("all"))  # one row for each cluster
    rows = beside(rows, stats, [])

    def away(s: Column) -> Column:
        return F.pow(V.euclidean(F.col("x"), s["c"]), 2) + s["w"]

    own = F.filter("all", lambda s: s["k"] == F.col("k"))[0]
    a = F.when(own["n"] > 1, away(own) * own["n"] / (own["n"] - 1)).otherwise(0.0)
    b = F.array_min(F.transform(F.filter("all", lambda s: s["k"] != F.col("k")), away))
    rows = rows.select("k", a.alias("a"), b.alias("b"), own["n"].alias("n"))
    s = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return rows.agg(F.avg(s).alias("silhouette"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from the counts of their table."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))

    def pairs(n: Column) -> Column:
        return F.sum(n.cast("double") * (n - 1) / 2)

    both = c.agg(pairs(F.col("n")).alias("t"), F.sum("n").alias("n"))
    one = c.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("u"))
    two = c.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("v"))
    s = beside(beside(both, one, []), two, [])
    n = F.col("n").cast("double")
    expected = F.col("u") * F.col("v") / (n * (n - 1) / 2)
    most = (F.col("u") + F.col("v")) / 2
    return s.select(F.when(most == expected, 1.0).otherwise((F.col("t") - expected) / (most - expected)).alias("adjusted_rand"))


def gaussian_mixture(df: DataFrame, x: str, k: int, rounds: int = 200, tol: float = 1e-6) -> DataFrame:
    """One-dimensional mixture by EM, started at quantiles: weight, mean and variance of each component, log_likelihood.

    A round is one aggregate of 3 k numbers.
    """
    rows = df.select(observed(x).alias("x")).where("x is not null").persist()
    try:
        s = rows.agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v"), F.percentile("x", [(i + 0.5) / k for i in range(k)]).alias("q")).first()
        if not s["n"]:
            raise ValueError("no rows")
        w, m, v = np.full(k, 1 / k), np.array(s["q"]), np.full(k, max(s["v"], 1e-10))
        last = -np.inf
        for _ in range(rounds):
            logs = [F.lit(float(np.log(max(w[j], 1e-300)) - 0.5 * np.log(2 * np.pi * v[j]))) - F.pow(F.col("x") - float(m[j]), 2) / float(2 * v[j]) for j in range(k)]
            lr = rows.select("x", *[p.alias(f"l{j}") for j, p in enumerate(logs)])
            top = F.greatest(*[F.col(f"l{j}") for j in range(k)]) if k > 1 else F.col("l0")
            lr = lr.withColumn("top", top).withColumn("all", F.col("top") + F.ln(sum((F.exp(F.col(f"l{j}") - F.col("top")) for j in range(k)), F.lit(0.0))))
            r = [F.exp(F.col(f"l{j}") - F.col("all")) for j in range(k)]
            aggs = [F.sum("all").alias("ll")]
            for j in range(k):
                d = F.col("x") - float(m[j])
                aggs += [F.sum(r[j]).alias(f"r{j}"), F.sum(r[j] * d).alias(f"d{j}"), F.sum(r[j] * d * d).alias(f"q{j}")]
            a = lr.agg(*aggs).first()
            for j in range(k):
                rj = max(a[f"r{j}"], 1e-300)
                step = a[f"d{j}"] / rj
                w[j], m[j], v[j] = rj / s["n"], m[j] + step, max(a[f"q{j}"] / rj - step * step, 1e-10)
            if abs(a["ll"] - last) < tol * abs(a["ll"]):
                break
            last = a["ll"]
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(j, float(w[j]), float(m[j]), float(v[j]), float(a["ll"])) for j in range(k)], "component int, weight double, mean double, variance double, log_likelihood double")


def factor_analysis(df: DataFrame, features: list[str], k: int, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, communalities) by principal axes of the correlation matrix, which is one aggregate."""
    n, _, s = centred(complete(df, features), features)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    h = 1 - 1 / np.diag(np.linalg.inv(r))
    for _ in range(rounds):
        reduced = r.copy()
        np.fill_diagonal(reduced, h)
        values, vectors = np.linalg.eigh(reduced)
        top = np.argsort(values)[::-1][:k]
        loadings = vectors[:, top] * np.sqrt(np.maximum(values[top], 0))
        new = (loadings**2).sum(axis=1)
        moved, h = np.abs(new - h).max(), new
        if moved < tol:
            break
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return loadings * np.where(sign == 0, 1, sign), h


def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of all rows of u and v, from differences: no digits are lost far from the origin."""
    d = np.zeros((len(u), len(v)))
    for k in range(u.shape[1]):
        d += (u[:, k, None] - v[:, k]) ** 2
    return np.sqrt(d)


def _block_pairs(df: DataFrame, id_col: str, x: str, keep: list[str], rows: int) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; a task compares two blocks of about ``rows``."""
    p = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), *keep)
    n = max(1, -(-p.count() // rows))
    p = p.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)))
    left = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("b").alias("p"), F.col("c").alias("q"), F.lit(True).alias("own"), "id", "x", *keep)
    right = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(F.col("c").alias("p"), F.col("b").alias("q"), F.lit(False).alias("own"), "id", "x", *keep)
    return left.unionByName(right)


def silhouettes(df: DataFrame, id_col: str, x: str, label: str, rows: int = 2000) -> DataFrame:
    """The exact silhouette of each row (id, label, silhouette) of an array column; 0 in clusters of one.

    All rows are compared with all, as the measure is defined, in blocks: a task
    holds two of them and returns one sum for each row and cluster.  Rows of a
    cluster at one place are one row there, with their number.
    """
    import pandas as pd

    kind = dict(df.dtypes)

    def sums(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["own"]], g[~g["own"]]
        u, v = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        d = _distances(u, v)
        d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()] = 0
        names, code = np.unique(b["label"].to_numpy(), return_inverse=True)
        many = b["__m"].to_numpy()
        total = d @ (np.eye(len(names))[code] * many[:, None])
        count = np.bincount(code, many, minlength=len(names)).astype(np.int64)
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(names)), "label": np.repeat(a["label"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "s": total.ravel(), "n": np.tile(count, len(a))})

    points = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(label).alias("label")).where("label is not null")
    places = staged(points.groupBy("x", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("__m")), "places")
    pairs = _block_pairs(places, "id", "x", ["label", "__m"], rows)
    parts = pairs.groupBy("p", "q").applyInPandas(sums, f"id {kind[id_col]}, label {kind[label]}, other {kind[label]}, s double, n long")
    means = parts.groupBy("id", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = F.col("label") == F.col("other")
    both = means.groupBy("id", "label").agg(F.max(F.when(own & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    value = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    at = places.select("id", "x").join(both.select("id", "label", F.coalesce(value, F.lit(0.0)).alias("silhouette")), "id")
    return points.join(at.drop("id"), ["x", "label"]).select(F.col("id").alias(id_col), F.col("label").alias(label), "silhouette")


def distance_matrix(df: DataFrame, id_col: str, x: str, rows: int = 2000) -> DataFrame:
    """Rows (i, j, d) of all pairs i < j of an array column, block by block: the result itself has n * (n - 1) / 2 rows."""
    import pandas as pd

    kind = dict(df.dtypes)[id_col]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["own"]], g[~g["own"]]
        u, v = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        d = _distances(u, v)
        i, j = np.nonzero(a["id"].to_numpy()[:, None] < b["id"].to_numpy())
        return pd.DataFrame({"i": a["id"].to_numpy()[i], "j": b["id"].to_numpy()[j], "d": d[i, j]})

    return _block_pairs(df, id_col, x, [], rows).groupBy("p", "q").applyInPandas(run, f"i {kind}, j {kind}, d double")


def dbscan(points: DataFrame, id_col: str, x: str, y: str, eps: float, least: int = 5) -> DataFrame:
    """Rows (id, cluster, core) of points in the plane; a cluster is named by its least core id, noise has null.

    Neighbours are counted in blocks of grid cells, clusters are the connected
    components of core points, and a border point joins the least cluster near it.
    """
    return bands.density_clusters(points.select(F.col(id_col).alias("id")), bands.plane(points, id_col, x, y), eps, 2, least).withColumnRenamed("id", id_col)


def dbscan_vectors(points: DataFrame, id_col: str, x: str, eps: float, least: int = 5, axes: int = 3) -> DataFrame:
    """``dbscan`` of an array column of any dimension: near points meet in grid cells of the first ``axes`` elements."""
    return bands.density_clusters(points.select(F.col(id_col).alias("id")), bands.vectors(points, id_col, x), eps, axes, least).withColumnRenamed("id", id_col)


def vector_band(points: DataFrame, id_col: str, x: str, threshold: float, axes: int = 3) -> DataFrame:
    """Pairs (i, j, d), in both directions, of array columns at most ``threshold`` apart.

    Points that are near are near in each element, so cells of the first ``axes``
    elements, and their neighbours, hold all pairs.  Rows with a missing array are left out.
    """
    return bands.near_pairs(bands.vectors(points, id_col, x), threshold, axes)


def compositional_centre(df: DataFrame, x: str, size: int) -> DataFrame:
    """The closed geometric mean of an array column of compositions."""
    one = df.agg(F.array(*[F.exp(F.avg(F.ln(F.col(x)[k].cast("double")))) for k in range(size)]).alias("g"))
    return one.select(V.closure("g").alias("centre"))


def variation_matrix(df: DataFrame, x: str, size: int) -> DataFrame:
    """Rows (i, j, variance) of the log ratios of each pair of parts, from one aggregate."""
    logs = [F.ln(F.col(x)[k].cast("double")) for k in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size)]
    row = df.agg(*[F.var_samp(logs[i] - logs[j]).alias(f"v{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"v{i}_{j}").alias("variance")) for i, j in pairs for a, b in ((i, j), (j, i))]
    return row.select(F.inline(F.array(*cells)))
