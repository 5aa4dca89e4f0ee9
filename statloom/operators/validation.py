"""Validation of linear models by an algebra of folds.

The rows are read once: an aggregate sums the products of all columns for each
cell of rows that no training set cuts.  Every training set is a sum or
difference of cells, and so is every test set; the squared error of a model on a
test set follows from its products as well.  Columns are centred first, so that
little is lost by subtracting.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.gram import matrix, products
from ..plans.order import with_row_index
from .regression import complete

#: Cells of a block in running sums.
BLOCK = 4096


def _centred_columns(df: DataFrame, features: list[str], y: str) -> list[Column]:
    """1, the features and y, each less its mean."""
    cols = [F.col(c).cast("double") for c in (*features, y)]
    means = df.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(cols)]).first()
    return [F.lit(1.0), *[c - F.lit(means[k] or 0.0) for k, c in enumerate(cols)]]


def _fit(g: np.ndarray, use: list[int], penalty: float) -> np.ndarray:
    """Coefficients from products (of the columns and y last); all but the constant are shrunk by the penalty."""
    a = g[np.ix_(use, use)] + penalty * np.diag([0.0, *[1.0] * (len(use) - 1)])
    try:
        b = np.linalg.solve(a, g[use, -1])
    except np.linalg.LinAlgError:
        b = np.linalg.pinv(a) @ g[use, -1]
    full = np.zeros(len(g) - 1)
    full[use] = b
    return full


def _mse(g: np.ndarray, b: np.ndarray) -> float:
    return float(max(0.0, g[-1, -1] - 2 * b @ g[:-1, -1] + b @ g[:-1, :-1] @ b) / g[0, 0])


def hashed_fold(id_col: str, k: int, seed: int = 0) -> Column:
    """A fold from 0 to k - 1 by a hash of the id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(k)).cast("int")


def nested_validation(
    df: DataFrame, features: list[str], y: str, outer: Column, inner: Column, penalties: Sequence[float] = (0.0,), subsets: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """Rows (fold, n, features, penalty, inner_mse, mse): each outer fold's score of the model that inner folds choose without it.

    ``outer`` and ``inner`` number the folds of a row, for example by
    ``hashed_fold`` with two seeds.  Models are ridge regressions on each of
    ``subsets`` (all features, if not given) with each of ``penalties``; the one
    with the least mean error over the inner folds wins, ties by order.  Folds
    without rows are left out; one inner fold's error counts as much as another's.
    """
    rows = complete(df.withColumns({"__o": outer, "__i": inner}), [*features, y], "__o", "__i")
    cols = _centred_columns(rows, features, y)
    cells = {(r["__o"], r["__i"]): matrix(r, len(cols)) for r in rows.groupBy("__o", "__i").agg(*products(cols)).collect()}  # one row for each pair of folds
    total = sum(cells.values())
    models = [([0, *(1 + features.index(f) for f in s)], s, float(a)) for s in (subsets or [features]) for a in penalties]
    out = []
    for o in sorted({o for o, _ in cells}):
        own = sum(g for (p, _), g in cells.items() if p == o)
        best = None
        for use, names, penalty in models:
            errors = []
            for i in sorted({i for p, i in cells if p != o}):
                test = sum(g for (p, j), g in cells.items() if p != o and j == i)
                errors.append(_mse(test, _fit(total - own - test, use, penalty)))
            score = float(np.mean(errors)) if errors else float("nan")
            if best is None or score < best[0]:
                best = (score, use, names, penalty)
        score, use, names, penalty = best
        out.append((int(o), int(round(own[0, 0])), list(names), penalty, score, _mse(own, _fit(total - own, use, penalty))))
    return df.sparkSession.createDataFrame(out, "fold int, n long, features array<string>, penalty double, inner_mse double, mse double")


def random_tests(id_col: str, splits: int, fraction: float, seed: int = 0) -> list[Column]:
    """Conditions by hash, one a split, that a row is in its test set; each row's chance is ``fraction``."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must be between 0 and 1")
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col)), F.lit(1 << 30)) < int(fraction * (1 << 30)) for s in range(splits)]


def split_validation(df: DataFrame, features: list[str], y: str, tests: list[Column], penalty: float = 0.0) -> DataFrame:
    """Rows (split, n_train, n_test, mse): Monte Carlo validation, a linear model for each test set, fitted to all other rows.

    A row is read once for all splits: each task multiplies the table of tests
    with the table of products and returns one matrix of sums.  Splits with an
    empty test or training set are left out.
    """
    rows = complete(df.withColumns({f"__t{s}": t for s, t in enumerate(tests)}), [*features, y], *[f"__t{s}" for s in range(len(tests))])
    cols = _centred_columns(rows, features, y)
    p, many = len(cols), len(tests)
    upper = np.triu_indices(p)

    def run(batches):
        sums = np.zeros((many + 1, len(upper[0])))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:p]])
            member = np.column_stack([np.ones(len(x)), *(c.fill_null(False).to_numpy(zero_copy_only=False) for c in batch.columns[p:])])
            sums += member.astype(float).T @ (x[:, upper[0]] * x[:, upper[1]])
        at = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(sums.ravel())], ["s", "k", "v"])

    parts = rows.select(*[c.alias(f"c{k}") for k, c in enumerate(cols)], *[f"__t{s}" for s in range(many)]).mapInArrow(run, "s long, k long, v double")
    sums = np.zeros((many + 1, len(upper[0])))
    for r in parts.groupBy("s", "k").agg(F.sum("v").alias("v")).collect():  # splits times products
        sums[r["s"], r["k"]] = r["v"]
    grams = np.zeros((many + 1, p, p))
    grams[:, upper[0], upper[1]] = grams[:, upper[1], upper[0]] = sums
    out = []
    for s, test in enumerate(grams[1:]):
        train = grams[0] - test
        if test[0, 0] > 0.5 and train[0, 0] > 0.5:
            out.append((s, int(round(train[0, 0])), int(round(test[0, 0])), _mse(test, _fit(train, list(range(p - 1)), penalty))))
    return df.sparkSession.createDataFrame(out, "split int, n_train long, n_test long, mse double")


def rolling_validation(df: DataFrame, features: list[str], y: str, order: list[str], least: int, step: int = 1, horizon: int = 1, most: int | None = None, penalty: float = 0.0) -> DataFrame:
    """Rows (window, train_start, train_end, test_end, mse): a linear model fitted to the rows before a point and tested on the next.

    Windows train on rows train_start to train_end - 1 in the given order (from
    the first, or the last ``most`` of them) and are tested on the ``horizon``
    rows that follow; train_end begins at ``least`` and moves on by ``step``.
    Products are summed in cells between window edges, cumulated in blocks, and
    every window is a difference of two running sums; the windows are solved in
    Arrow batches.  Rows with a missing value don't count.  Too few rows: no
    windows.
    """
    if least < 1 or step < 1 or horizon < 1 or (most is not None and most < 1):
        raise ValueError("least, step, horizon and most must be positive")
    rows = complete(df, [*features, y], *order)
    cols = _centred_columns(rows, features, y)
    rows = with_row_index(rows, *order, name="__pos")
    n = rows.count()
    unit = int(np.gcd.reduce([least, step, horizon, *([most] if most else [])]))
    p = len(cols)
    names = [f"g{i}_{j}" for i in range(p) for j in range(i, p)]
    cells = rows.groupBy(F.floor(F.col("__pos") / unit).alias("cell")).agg(*products(cols)).withColumn("block", F.floor(F.col("cell") / BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    base = cells.groupBy("block").agg(*[F.sum(c).alias(c) for c in names]).select(F.col("block").alias("b"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"b_{c}") for c in names])
    within = Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select("cell", "block", *[F.sum(c).over(within).alias(c) for c in names]).join(base, F.col("block") == F.col("b"))
    sums = sums.select((F.col("cell") + 1).alias("edge"), F.array(*[F.col(c) + F.col(f"b_{c}") for c in names]).alias("sums"))
    count = max(0, (n - least - horizon) // step + 1) if n >= least + horizon else 0
    end = F.lit(least) + F.col("id") * step
    windows = df.sparkSession.range(count).select(F.col("id").alias("window"), (F.greatest(end - most, F.lit(0)) if most else F.lit(0)).cast("long").alias("train_start"), end.alias("train_end"), (end + horizon).alias("test_end"))
    for c in ("train_start", "train_end", "test_end"):
        windows = windows.join(sums.select((F.col("edge") * unit).alias(c), F.col("sums").alias(f"at_{c}")), c, "left")
    upper = np.triu_indices(p)

    def run(batches):
        for batch in batches:
            at = {}
            for c in ("train_start", "train_end", "test_end"):
                flat = [v or [0.0] * len(upper[0]) for v in batch.column(f"at_{c}").to_pylist()]
                g = np.zeros((len(flat), p, p))
                g[:, upper[0], upper[1]] = g[:, upper[1], upper[0]] = np.array(flat).reshape(-1, len(upper[0]))
                at[c] = g
            mse = [_mse(t, _fit(g, list(range(p - 1)), penalty)) for g, t in zip(at["train_end"] - at["train_start"], at["test_end"] - at["train_end"], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("window", "train_start", "train_end", "test_end")), pa.array(mse, pa.float64())], ["window", "train_start", "train_end", "test_end", "mse"])

    return windows.select("window", "train_start", "train_end", "test_end", "at_train_start", "at_train_end", "at_test_end").mapInArrow(run, "window long, train_start long, train_end long, test_end long, mse double")
