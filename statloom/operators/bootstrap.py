"""Bootstraps of ordered rows and of regressions, without building a resample.

A statistic is anything made of means of columns.  A block of neighbouring rows
adds the difference of two running sums to its replicate, so a replicate costs
as many rows as it has blocks, however long the blocks are.  Draws are hashes of
seed, replicate and block: any executor draws the same again.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import staged, with_row_index
from .descriptive import beside, observed
from .resampling import _uniform, resampled_means

#: Rows of a block in running sums.
BLOCK = 4096


def _prefix_sums(df: DataFrame, columns: Mapping[str, Column], order: list[str]) -> tuple[DataFrame, int]:
    """(rows (edge, sums): the sums of all rows before an edge, from 0 to n; n).  Rows with a missing value don't count."""
    names = list(columns)
    rows = df.select(*order, *[c.cast("double").alias(f"__c{k}") for k, c in enumerate(columns.values())]).dropna(subset=[f"__c{k}" for k in range(len(names))])
    rows = with_row_index(rows, *order, name="__pos").withColumn("__b", F.floor(F.col("__pos") / BLOCK))
    rows = staged(rows, "bootstrap")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    within = Window.partitionBy("__b").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    base = rows.groupBy("__b").agg(*[F.sum(f"__c{k}").alias(f"__s{k}") for k in range(len(names))]).select("__b", *[F.coalesce(F.sum(f"__s{k}").over(before), F.lit(0.0)).alias(f"__t{k}") for k in range(len(names))])
    own = rows.select("__b", "__pos", *[F.sum(f"__c{k}").over(within).alias(f"__c{k}") for k in range(len(names))])
    sums = own.join(base, "__b").select((F.col("__pos") + 1).alias("edge"), F.array(*[F.col(f"__c{k}") + F.col(f"__t{k}") for k in range(len(names))]).alias("sums"))
    zero = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("edge"), F.array(*[F.lit(0.0)] * len(names)).alias("sums"))
    return staged(zero.unionByName(sums), "sums"), rows.count()


def fixed_blocks(spark, n: int, size: int, replicates: int, seed: int = 0, circular: bool = False) -> DataFrame:
    """Rows (rep, start, length) of blocks of ``size`` rows, the last cut so that a replicate has n rows."""
    many, starts = -(-n // size), n if circular else n - size + 1
    at = F.floor(_uniform(F.lit(seed), F.col("rep"), F.col("j")) * starts).cast("long")
    rows = spark.range(replicates * many).select(F.floor(F.col("id") / many).cast("int").alias("rep"), (F.col("id") % many).alias("j"))
    return rows.select("rep", at.alias("start"), F.least(F.lit(size), F.lit(n) - F.col("j") * size).cast("long").alias("length"))


def random_blocks(spark, n: int, mean_size: float, replicates: int, seed: int = 0) -> DataFrame:
    """Rows (rep, start, length) of blocks of geometric length with the given mean, the last cut so that a replicate has n rows."""
    p = 1 / max(1.0, float(mean_size))
    many = int(n * p + 10 * np.sqrt(n * p) + 30)  # more are needed with a chance under 1e-12; the last block then ends the replicate
    rows = spark.range(replicates * many).select(F.floor(F.col("id") / many).cast("int").alias("rep"), (F.col("id") % many).alias("j"))
    u = _uniform(F.lit(seed), F.col("rep"), F.col("j"), F.lit(1))
    length = F.lit(1.0) if p >= 1 else F.floor(F.ln(u) / float(np.log1p(-p))) + 1
    rows = rows.select("rep", "j", F.floor(_uniform(F.lit(seed), F.col("rep"), F.col("j")) * n).cast("long").alias("start"), F.when(F.col("j") == many - 1, float(n)).otherwise(length).cast("long").alias("length"))
    done = F.coalesce(F.sum("length").over(Window.partitionBy("rep").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as a replicate has blocks
    return rows.withColumn("done", done).where(F.col("done") < n).select("rep", "start", F.least("length", F.lit(n) - F.col("done")).alias("length"))


def block_means(df: DataFrame, columns: Mapping[str, Column], order: list[str], size: float | None = None, replicates: int = 1000, kind: str = "moving", seed: int = 0) -> DataFrame:
    """Rows (rep, one mean for each column): replicates of blocks of rows in an order.

    ``kind``: ``moving`` blocks of ``size`` rows inside the data, ``circular``
    ones that go on at the first row, or ``stationary`` ones of random length
    with that mean.  The size is the root of the number of rows if not given.
    """
    if kind not in ("moving", "circular", "stationary"):
        raise ValueError(f"no kind {kind!r}")
    sums, n = _prefix_sums(df, columns, order)
    spark, names = df.sparkSession, list(columns)
    if not n:
        return spark.createDataFrame([], ", ".join(["rep int", *(f"`{c}` double" for c in names)]))
    size = size or max(1, int(n**0.5))
    if not 1 <= size <= n:
        raise ValueError(f"blocks have 1 to {n} rows")
    blocks = random_blocks(spark, n, size, replicates, seed) if kind == "stationary" else fixed_blocks(spark, n, int(size), replicates, seed, kind == "circular")
    end = F.col("start") + F.col("length")
    pieces = F.array(F.struct(F.col("start").alias("a"), F.least(end, F.lit(n)).alias("b")), F.struct(F.lit(0).cast("long").alias("a"), F.greatest(end - n, F.lit(0)).cast("long").alias("b")))
    # each end of a piece is one running sum, so equal ends of a replicate are one row
    ends = blocks.select("rep", F.inline(pieces)).where("b > a").select("rep", F.inline(F.array(F.struct(F.col("b").alias("edge"), F.lit(1).alias("w")), F.struct(F.col("a").alias("edge"), F.lit(-1).alias("w")))))
    ends = ends.groupBy("rep", "edge").agg(F.sum("w").alias("w")).where("w <> 0")
    found = ends.join(sums, "edge").groupBy("rep").agg(*[(F.sum(F.col("w") * F.col("sums")[k]) / n).alias(c) for k, c in enumerate(names)])
    return found


def wild_functionals(df: DataFrame, fitted: str, residual: str, functionals: Mapping[str, Column], key: str, replicates: int = 1000, kind: str = "rademacher", seed: int = 0) -> DataFrame:
    """Rows (rep, one number for each functional) of fitted + residual times a random sign or Mammen's weight.

    A functional is the column of its coefficients: its number is the sum of
    coefficient times value; 1 / n gives the mean, (x - mean x) / sxx a slope.
    Each task multiplies its rows with their weights and returns one sum for each
    replicate.
    """
    if kind not in ("rademacher", "mammen"):
        raise ValueError(f"no kind {kind!r}")
    names = list(functionals)
    golden = (5**0.5 + 1) / 2
    f, e = observed(fitted), observed(residual)
    rows = df.select(F.xxhash64(F.lit(seed).cast("long"), key).alias("k"), *[(c.cast("double") * e).alias(f"e{i}") for i, c in enumerate(functionals.values())], *[(c.cast("double") * f).alias(f"f{i}") for i, c in enumerate(functionals.values())]).dropna()
    base = rows.agg(*[F.coalesce(F.sum(f"f{i}"), F.lit(0.0)).alias(f"f{i}") for i in range(len(names))]).first()

    def run(batches):
        total = np.zeros((len(names), replicates))
        reps = np.arange(replicates, dtype=np.uint64) + np.uint64(1)
        for batch in batches:
            k = batch.column("k").to_numpy().view(np.uint64)
            x = np.column_stack([batch.column(f"e{i}").to_numpy() for i in range(len(names))])
            for a in range(0, len(k), 4096):
                with np.errstate(over="ignore"):
                    h = k[a : a + 4096, None] * np.uint64(0x9E3779B97F4A7C15) + reps * np.uint64(0xD6E8FEB86659FD93)
                    for _ in range(2):
                        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) / (1 << 53)
                w = np.where(u < 0.5, -1.0, 1.0) if kind == "rademacher" else np.where(u < golden / 5**0.5, 1 - golden, golden)
                total += x[a : a + 4096].T @ w
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[1].astype(np.int32)), pa.array(at[0].astype(np.int32)), pa.array(total.ravel())], ["rep", "i", "v"])

    parts = rows.select("k", *[f"e{i}" for i in range(len(names))]).mapInArrow(run, "rep int, i int, v double")
    return parts.groupBy("rep").agg(*[(F.sum(F.when(F.col("i") == i, F.col("v"))) + float(base[f"f{i}"])).alias(c) for i, c in enumerate(names)])


def replicate_summary(replicates: DataFrame, x: str, estimate: float, confidence: float = 0.95) -> DataFrame:
    """One row: estimate, bias, se and percentile interval of a column of replicates."""
    tail = (1 - confidence) / 2
    return replicates.agg(F.lit(float(estimate)).alias("estimate"), (F.avg(x) - float(estimate)).alias("bias"), F.stddev_samp(x).alias("se"), F.percentile(x, tail).alias("low"), F.percentile(x, 1 - tail).alias("high"))


def corrected_interval(df: DataFrame, x: str, key: str, replicates: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """One row: the mean, its bootstrap se, and the bias-corrected and accelerated interval.

    The correction is the share of replicates under the estimate; the acceleration
    comes from the third moment, which leaving out each row in turn amounts to.
    """
    v = observed(x)
    n, m = F.count(v), F.avg(v)
    s = df.agg(n.alias("n"), m.alias("m")).first()
    if not s["n"] or s["n"] < 2:
        raise ValueError("two values, at least")
    d = v - F.lit(s["m"])
    moments = df.agg(F.sum(d * d * d).alias("c"), F.sum(d * d).alias("q"), F.lit(s["m"]).alias("estimate"))
    speed = F.when(F.col("q") > 0, F.col("c") / (6 * F.pow(F.col("q"), 1.5))).otherwise(0.0)
    reps = staged(resampled_means(df, x, key, "poisson", replicates, seed).where("mean IS NOT NULL"), "replicates")
    shift = reps.agg(F.avg((F.col("mean") < s["m"]).cast("double")).alias("below"), F.stddev_samp("mean").alias("se"), F.count(F.lit(1)).alias("reps"))
    one = beside(moments.select("estimate", speed.alias("a")), shift, [])
    z0 = special.column("normal_quantile", F.least(F.greatest(F.col("below"), 0.5 / F.col("reps")), 1 - 0.5 / F.col("reps")))
    one = one.withColumn("z0", z0)
    for name, p in (("p_low", (1 - confidence) / 2), ("p_high", (1 + confidence) / 2)):
        z = F.col("z0") + float(special.normal_quantile(p))
        one = one.withColumn(name, special.column("normal_cdf", F.col("z0") + z / (1 - F.col("a") * z)))
    r = one.first()
    ends = reps.agg(F.percentile("mean", float(r["p_low"])).alias("low"), F.percentile("mean", float(r["p_high"])).alias("high"))
    return beside(one.select("estimate", "se"), ends, [])
