"""Table algebra with position, null-safe joins and grouping that keeps counts.

A frame here is a plain DataFrame; where positions matter, it carries a column
``row_idx`` (see ``plans.order.with_row_index``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import with_row_index

INDEX = "row_idx"


def indexed(df: DataFrame, *order: Column | str) -> DataFrame:
    """The frame with positions from 0, in the given order."""
    return with_row_index(df, *order, name=INDEX)


def sort(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Sorted by one column, nulls last either way, ties in the order of positions if there are any."""
    c = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return df.orderBy(c, *([INDEX] if INDEX in df.columns else []))


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.where(F.col(INDEX) < n)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    return slice_rows(df, -n) if n else df.limit(0)


def slice_rows(df: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Rows from ``start`` up to ``end``; negative positions count from the end."""
    if start < 0 or (end or 0) < 0:
        n = (df.agg(F.max(INDEX)).first()[0] or -1) + 1
        start = max(0, n + start) if start < 0 else start
        end = max(0, n + end) if end is not None and end < 0 else end
    rows = df.where(F.col(INDEX) >= start)
    return rows if end is None else rows.where(F.col(INDEX) < end)


def require(df: DataFrame, *columns: str) -> None:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"no column {lost[0]!r}; there are {df.columns}")


def select(df: DataFrame, *columns: str) -> DataFrame:
    require(df, *columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    return df.withColumnRenamed(old, new)


def drop(df: DataFrame, column: str) -> DataFrame:
    """Without the column; one that isn't there is no error."""
    return df.drop(column)


def mutate(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def add_column(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Adds a column of another indexed frame (row_idx, value) by position."""
    other = values.select(F.col(INDEX).alias("__i"), F.col("value").alias("__value"))
    return df.join(other, F.col(INDEX) == F.col("__i"), "left").withColumn(name, F.col("__value")).drop("__i", "__value")


_AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": lambda c: F.count(F.lit(1)),
}


def group_by(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """Groups by keys (nulls form a group); ``aggs``: name -> (column, sum | mean | count | min | max).

    count counts all rows; the sum of no numbers is 0.
    """
    require(df, *keys, *[c for c, _ in aggs.values()])
    bad = [f for _, f in aggs.values() if f not in _AGGREGATES]
    if bad:
        raise ValueError(f"unknown aggregate {bad[0]!r}")
    return df.groupBy(*keys).agg(*[_AGGREGATES[f](F.col(c).cast("double") if f != "count" else F.col(c)).alias(name) for name, (c, f) in aggs.items()])


def join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; other columns of the right that clash get the suffix ``_right``."""
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"unknown join {how!r}")
    require(left, *on)
    require(right, *on)
    keys = {k: f"__r_{k}" for k in on}
    named = {c: f"{c}_right" for c in right.columns if c in left.columns and c not in on}
    r = right.toDF(*[keys.get(c, named.get(c, c)) for c in right.columns])
    cond = None
    for k in on:
        one = left[k].eqNullSafe(r[keys[k]])
        cond = one if cond is None else cond & one
    both = left.withColumn("__l", F.lit(True)).join(r, cond, how)
    key = [F.when(F.col("__l"), F.col(k)).otherwise(F.col(keys[k])).alias(k) for k in on]
    rest = [F.col(c) for c in left.columns if c not in on] + [F.col(named.get(c, c)) for c in right.columns if c not in on]
    return both.select(*key, *rest)


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """A frame of records; the first one has the columns, missing values are null."""
    if not records:
        raise ValueError("records must not be empty")
    names = list(records[0])
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in records], names)


def from_columns(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns must have the same length")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), list(columns))


def shape(df: DataFrame) -> dict:
    return {"n_rows": df.count(), "n_cols": len(df.columns), "columns": df.columns}
