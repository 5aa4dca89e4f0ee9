"""Rows numbered in a sorted order, over the whole table or within groups of any size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import written

_BITS = 33  # of monotonically_increasing_id that number a partition's rows
#: Cells (a partition's rows of one group) that may be broadcast; more of them are joined by shuffle.
BROADCAST_CELLS = 100_000


def _sorted(df: DataFrame, order: list[Column], name: str, rows: int | None = None) -> DataFrame:
    """The table in ranges of the order, written; equal rows are dealt out by a random last key, so no key is one task."""
    keys = [*order, F.col("__tie").asc()]
    out = df.withColumn("__tie", F.rand(11)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    out = written(out.withColumn("__m", F.monotonically_increasing_id()), name, rows)
    return out.withColumns({"__part": F.shiftright("__m", _BITS), "__at": F.col("__m").bitwiseAND(F.lit((1 << _BITS) - 1))})


def indexed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: each row's place, from 0, in the order.  The driver gets a count for each partition."""
    rows = _sorted(df, order, name)
    base, at = [], 0
    for r in sorted(rows.groupBy("__part").count().collect(), key=itemgetter("__part")):
        base.append((r["__part"], at))
        at += r["count"]
    starts = df.sparkSession.createDataFrame(base, "__part long, __base long")
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__m", "__part", "__at", "__base")


def indexed_within(df: DataFrame, group: str, order: list[Column], about: DataFrame | None = None, count: str = "size", rows: int | None = None) -> DataFrame:
    """Adds ``pos``, each row's place from 0 within its group, and ``count``, the group's rows.

    Ranges of the order cut large groups into many partitions.  ``about`` has at
    most one row for each group, whose other columns are added too; they come by
    (partition, group), so that a group's size skews no join.  ``rows``, the
    number of narrow rows where it is known, keeps what is written from many files.
    """
    placed = _sorted(df, [F.col(group).asc(), *order], "within", rows)
    cells = written(placed.groupBy("__part", F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")), "cells", rows)
    whole = Window.partitionBy("__g")  # a row for each partition that holds the group
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    found = cells.select(F.col("__part").alias("__p"), "__g", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(whole).alias(count))
    if about is not None:
        found = found.join(about.withColumnRenamed(group, "__a"), F.col("__g").eqNullSafe(F.col("__a"))).drop("__a")
    if cells.count() <= BROADCAST_CELLS:
        found = F.broadcast(found)
    placed = placed.join(found, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return placed.withColumn("pos", F.col("__base") + F.col("__at") - F.col("__first")).drop("__m", "__part", "__p", "__g", "__at", "__first", "__base")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, as tuples in the order of the columns."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def groups_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first ``width`` columns; a run is read as it is asked for."""
    return groupby(rows_of(batches), key=itemgetter(*range(width)) if width > 1 else lambda r: r[:1])


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
