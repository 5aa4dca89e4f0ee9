"""Global row order and ranks without a single-task window.

A window without PARTITION BY moves all rows to one task.  Here rows are sorted
by range, numbered within their partition, and shifted by the sizes of the
partitions before, which are as many numbers as there are partitions.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BITS = 33  # of monotonically_increasing_id that number a partition's rows


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """The table, written to the shared folder that spark.checkpoint.dir names and read back."""
    spark = df.sparkSession
    path = f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, such as those of a loop's last round."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _shared(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))  # one process, as in tests
    return context.getCheckpointDir().get()


def values_at(df: DataFrame, value: str, ranks: list[int], bins: int = 4096) -> list[float]:
    """The exact values at ranks (from 0) of a column of doubles without nulls, found by counting.

    A pass counts the rows in equal bins of the range that holds the rank and
    goes on in that bin, until it has few different values; nothing is sorted,
    and the driver gets at most about ``bins`` counts a pass.  Infinite values
    are counted beside the bins.
    """
    v = F.col(value)
    infinite = F.lit(float("inf"))
    ends = df.agg(F.min(F.when(F.abs(v) < infinite, v)).alias("lo"), F.max(F.when(F.abs(v) < infinite, v)).alias("hi"), F.sum((v == -infinite).cast("long")).alias("under"), F.sum((F.abs(v) < infinite).cast("long")).alias("n")).first()
    finite, under = df.where(F.abs(v) < infinite), ends["under"] or 0
    out = []
    for rank in ranks:
        if not under <= rank < under + (ends["n"] or 0):
            out.append(float("-inf" if rank < under else "inf"))
            continue
        lo, hi, rows, rank = ends["lo"], ends["hi"], finite, rank - under
        while lo < hi:
            width = hi / bins - lo / bins
            close = not lo + width > lo  # then there are not many more doubles than bins
            if close or hi - lo <= abs(lo) * 1e-9 or rows is not finite:
                values = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
                few = (values if close else values.limit(bins + 1)).collect()
                if close or len(few) <= bins:
                    for x, n in sorted((r[value], r["n"]) for r in few):
                        if rank < n:
                            lo = hi = x
                            break
                        rank -= n
                    break
            number = F.greatest(F.least(F.floor((v - F.lit(lo)) / F.lit(width)) if hi - lo < float("inf") else F.floor(v / F.lit(width) - F.lit(lo / width)), F.lit(bins - 1)), F.lit(0))
            counts = rows.groupBy(number.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
            for r in sorted(counts, key=lambda r: r["b"]):
                if rank < r["n"]:
                    lo, hi = r["lo"], r["hi"]
                    break
                rank -= r["n"]
            rows = rows.where((v >= F.lit(lo)) & (v <= F.lit(hi)))
        out.append(lo)
    return out


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_idx") -> DataFrame:
    """Adds the position of each row, from 0, in a global order."""
    ordered = df.orderBy(*order) if order else df
    rows = staged(ordered.withColumn("__m", F.monotonically_increasing_id()), "ordered")
    sizes = rows.groupBy(F.shiftright("__m", _BITS).alias("part")).count().collect()  # one row per partition
    base, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        base[r["part"]], at = at, at + r["count"]
    if not base:
        return rows.withColumn(name, F.lit(0).cast("long")).drop("__m")
    starts = df.sparkSession.createDataFrame(list(base.items()), "__part long, __base long")
    rows = rows.withColumn("__part", F.shiftright("__m", _BITS)).join(F.broadcast(starts), "__part")
    return rows.withColumn(name, F.col("__base") + F.col("__m").bitwiseAND(F.lit((1 << _BITS) - 1))).drop("__m", "__part", "__base")


def with_average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds each row's rank from 1 by value; ties share their mean rank.

    Counts of different values are cumulated, so a hot value is one row of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    indexed = with_row_index(counts, value, name="__i")
    total = running_total(indexed, "__i", "__n", "__to")
    ranks = total.select(F.col(value).alias("__v"), (F.col("__to") - (F.col("__n") - 1) / 2).alias(name), F.col("__n").alias(f"{name}_ties"))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def running(df: DataFrame, index: str, value: str, name: str, how: str = "sum", backward: bool = False, block: int = 100_000) -> DataFrame:
    """Adds the running sum, min or max of a value in the order of a dense index.

    Blocks of the index are folded by the tasks that own them; what the blocks
    before one add is a window over one row per block.
    """
    from pyspark.sql import Window

    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    order = (lambda c: F.col(c).desc()) if backward else F.col
    rows = df.withColumn("__b", F.floor(F.col(index) / block))
    sums = rows.groupBy("__b").agg(fold(value).alias("__s"))
    before = Window.orderBy(order("__b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    base = sums.select("__b", fold("__s").over(before).alias("__base"))
    within = Window.partitionBy("__b").orderBy(order(index)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", fold(value).over(within)).join(F.broadcast(base), "__b")
    if how == "sum":
        both = F.coalesce("__base", F.lit(0)) + F.col("__own")
    else:
        both = (F.least if how == "min" else F.greatest)("__base", "__own")
    return rows.withColumn(name, both).drop("__b", "__own", "__base")


def running_total(df: DataFrame, index: str, value: str, name: str, block: int = 100_000) -> DataFrame:
    """Adds the running sum of a value in the order of a dense index."""
    return running(df, index, value, name, "sum", block=block)
