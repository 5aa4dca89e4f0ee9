"""Gram matrices: the one aggregate behind every least-squares model.

One pass sums all products of the columns, map-side combined; the driver gets
p * (p + 1) / 2 numbers, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def products(columns: list[Column], weight: Column | None = None) -> list[Column]:
    """Sums of products of each pair of columns (upper triangle by rows)."""
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w * columns[i] * columns[j]).alias(f"g{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]


def matrix(row, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


#: Columns up to which the products are expressions of one aggregate; wider matrices are multiplied in blocks.
WIDE = 24


def _block_sums(df: DataFrame, cols: list[Column]) -> np.ndarray:
    """X'X summed by each task over its batches; p * p numbers a task are added up by position."""
    p = len(cols)

    def run(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(total.ravel())], ["at", "v"])

    narrow = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    sums = narrow.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(p * p)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out.reshape(p, p)


def gram(df: DataFrame, columns: list[str | Column], weight: Column | None = None, whole: bool = False) -> np.ndarray:
    """X'WX of the columns over the rows in which none is null; ``whole``: there are no others."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    full = df
    for c in () if whole else cols:
        full = full.where(c.isNotNull())
    if len(cols) > WIDE and weight is None:
        return _block_sums(full, cols)
    return matrix(full.agg(*products(cols, weight)).first(), len(cols))


def centred(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sums of products about the means) over rows without nulls; two stable passes."""
    full = df.dropna(subset=columns)
    first = full.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = first["n"]
    if not n:
        raise ValueError("no complete rows")
    mean = np.array([first[f"m{i}"] for i in range(len(columns))])
    return n, mean, gram(full, [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, mean, strict=True)], whole=True)
