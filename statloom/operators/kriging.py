"""Nearest observations by grids of growing cells, and kriging from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import staged, unstage
from .descriptive import observed

#: Observations of a cell, over ``k``, that make the first cells smaller.
CROWD = 64
_SHAPES = {
    "spherical": lambda u: np.where(u < 1, 1.5 * u - 0.5 * u**3, 1.0),
    "exponential": lambda u: 1 - np.exp(-3 * u),
    "gaussian": lambda u: 1 - np.exp(-3 * u * u),
}


@dataclass(frozen=True)
class Variogram:
    """Half the mean squared difference of values at a distance: 0 at 0, from ``nugget`` just above up to ``sill``.

    ``graph.fit_variogram`` gives nugget, sill and range of a ``model``.
    """

    nugget: float
    sill: float
    range: float
    model: str = "spherical"

    def __post_init__(self):
        if self.model not in _SHAPES or self.range <= 0 or self.sill <= 0 or not 0 <= self.nugget <= self.sill:
            raise ValueError("a known model, a positive range, and a nugget from 0 to the sill")

    def covariance(self, h: np.ndarray) -> np.ndarray:
        gamma = self.nugget + (self.sill - self.nugget) * _SHAPES[self.model](h / self.range)
        return np.where(h > 0, self.sill - gamma, self.sill)


def _cells(side: float) -> dict:
    return {"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}


def nearest(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Rows (id, rank, j, x, y, v, d, qx, qy): the ``k`` points (id, x, y, v) nearest to each query (id, x, y), ties by id.

    Queries search the nine cells around their own and are done once ``k`` points
    lie within a cell's side; for the others the side doubles.  The first side is
    the largest power of two of the extent at which no cell is crowded.  Of points
    at one place only the first ``k`` ids can be among the nearest, so a hot place
    is ``k`` rows.  With fewer than ``k`` points, all of them.
    """
    if k < 1:
        raise ValueError("k must be positive")
    q = queries.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    p = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("v")).dropna()
    place = Window.partitionBy("x", "y").orderBy("id")
    p = staged(p.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).drop("r"), "points")
    both = q.select("x", "y").unionByName(p.select("x", "y"))
    e = both.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).first()
    n = p.count()
    if not n:
        return q.limit(0).select("id", F.lit(1).alias("rank"), F.col("id").alias("j"), "x", "y", F.lit(0.0).alias("v"), F.lit(0.0).alias("d"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    extent = max(e["hix"] - e["lox"], e["hiy"] - e["loy"], 1e-300)
    side = extent
    for _ in range(40):
        most = p.withColumns(_cells(side)).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if most <= CROWD * k:
            break
        side /= 2
    open_, found, old = q, [], []
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    while True:
        last = side >= 2 * extent  # every point is in reach
        around = open_.withColumns(_cells(side)).withColumn("s", F.explode(near)).select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), (F.col("cx") + F.col("s.a")).alias("cx"), (F.col("cy") + F.col("s.b")).alias("cy"))
        d = F.sqrt(F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2))
        hits = around.join(p.withColumns(_cells(side)), ["cx", "cy"]).withColumn("d", d)
        if not last:
            hits = hits.where(F.col("d") <= side)
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("rank") <= k)
        done = staged(ranked.select(F.col("q").alias("id"), "rank", F.col("id").alias("j"), "x", "y", "v", "d", "qx", "qy"), "nearest")
        if last:
            found.append(done)
            break
        full = done.where(F.col("rank") == k).select("id")
        found.append(done.join(full, "id", "left_semi"))
        open_ = staged(open_.join(full, "id", "left_anti"), "searching")
        unstage(*old)
        old = [open_]
        if open_.isEmpty():
            break
        side *= 2
    out = found[0]
    for t in found[1:]:
        out = out.unionByName(t)
    return out


def ordinary_kriging(queries: DataFrame, points: DataFrame, model: Variogram, k: int = 16, query_id: str = "id", x: str = "x", y: str = "y", v: str = "v") -> DataFrame:
    """Rows (id, prediction, variance) for each query from its ``k`` nearest points.

    Queries have columns query_id, x, y, and points id, x, y, v.  Each query's
    bordered system is solved in Arrow batches; with ``k`` as large as the number
    of points it is the system of all of them.  A singular system (points at one
    place without a nugget) gets its least solution.  Queries without coordinates
    are left out; query ids must differ.
    """
    q = queries.select(F.col(query_id).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    p = points.select("id", F.col(x).alias("x"), F.col(y).alias("y"), observed(v).alias("v"))
    near = nearest(q, p, k)
    rows = near.groupBy("id").agg(F.first("qx").alias("qx"), F.first("qy").alias("qy"), F.sort_array(F.collect_list(F.struct("rank", "x", "y", "v"))).alias("near"))
    kind = dict(q.dtypes)["id"]

    def solve(batches):
        for batch in batches:
            size = np.array([len(a) for a in batch.column("near")], np.int64)
            flat = batch.column("near").flatten()
            xy = np.column_stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()])
            value = flat.field("v").to_numpy()
            here = np.column_stack([batch.column("qx").to_numpy(), batch.column("qy").to_numpy()])
            start = np.append(0, np.cumsum(size))[:-1]
            mean, var = np.empty(len(size)), np.empty(len(size))
            for m in np.unique(size):
                which = np.flatnonzero(size == m)
                for part in np.array_split(which, max(1, len(which) * (m + 1) ** 2 // 4_000_000)):
                    at = start[part, None] + np.arange(m)
                    place, z = xy[at], value[at]
                    a = np.ones((len(part), m + 1, m + 1))
                    a[:, :m, :m] = model.covariance(np.sqrt(((place[:, :, None] - place[:, None]) ** 2).sum(-1)))
                    a[:, m, m] = 0
                    b = np.ones((len(part), m + 1))
                    b[:, :m] = model.covariance(np.sqrt(((place - here[part, None]) ** 2).sum(-1)))
                    try:
                        w = np.linalg.solve(a, b[..., None])[..., 0]
                    except np.linalg.LinAlgError:
                        w = (np.linalg.pinv(a) @ b[..., None])[..., 0]
                    mean[part] = (w[:, :m] * z).sum(1)
                    var[part] = np.maximum(0, model.sill - (w * b).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(mean), pa.array(var)], ["id", "prediction", "variance"])

    return rows.mapInArrow(solve, f"id {kind}, prediction double, variance double").withColumnRenamed("id", query_id)
