"""Descriptive, robust, survey-weighted and missing-data statistics.

Every function takes grouping columns ``by``; without them the result has one
row.  Nulls and NaN count as missing.  Quantiles are exact: order statistics
come from ``percentile``, whose buffers hold different values with their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def observed(x: str | Column) -> Column:
    """The value as a double, null if missing."""
    c = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(c), c)


def _stat(df: DataFrame, by: list[str], *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols)


def skewness(x: Column) -> Column:
    """Adjusted sample skewness; null under three values, 0 without spread."""
    n = F.count(x).cast("double")
    return F.when(n < 3, None).when(F.var_pop(x) == 0, 0.0).otherwise(F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Adjusted excess kurtosis; null under four values, 0 without spread."""
    n = F.count(x).cast("double")
    return F.when(n < 4, None).when(F.var_pop(x) == 0, 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def describe(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """n, mean, median, variance, sd, min, max, skewness, kurtosis."""
    v = observed(x)
    return _stat(
        df, list(by), F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"), F.max(v).alias("max"), skewness(v).alias("skewness"), kurtosis(v).alias("kurtosis"),
    )


def percentiles(df: DataFrame, x: str, levels: list[float], by: list[str] = ()) -> DataFrame:
    """Linear-interpolation percentiles (levels from 0 to 100), a column p<level> for each."""
    if any(not 0 <= p <= 100 for p in levels):
        raise ValueError("levels must be between 0 and 100")
    v = observed(x)
    both = _stat(df, list(by), F.percentile(v, [p / 100 for p in levels]).alias("p"))
    return both.select(*by, *[F.col("p")[i].alias(f"p{p:g}") for i, p in enumerate(levels)])


def mad(df: DataFrame, x: str, by: list[str] = (), constant: float = 1.4826) -> DataFrame:
    """Median, and the median absolute deviation from it times a constant."""
    rows = df.select(*by, observed(x).alias("v")).where("v is not null")
    return _deviations(rows, list(by)).groupBy(*by).agg(F.first("m").alias("median"), (constant * F.median(F.abs(F.col("v") - F.col("m")))).alias("mad"))


def _deviations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds the group's median m: one row per group, joined back."""
    return beside(rows, _stat(rows, by, F.median("v").alias("m")), by)


def beside(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Joins group statistics to rows; null keys match, and a single row goes to all."""
    if not by:
        return rows.crossJoin(F.broadcast(stats))  # one row
    names = [f"__{b}" for b in by]
    stats = stats.toDF(*[f"__{c}" if c in by else c for c in stats.columns])
    on = None
    for b, n in zip(by, names, strict=True):
        c = rows[b].eqNullSafe(stats[n])
        on = c if on is None else on & c
    return rows.join(stats, on).drop(*names)


def _order_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Different values of each group with counts and the rank before them (from 0)."""
    counts = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    if by:
        before = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    from ..plans.order import running_total, with_row_index

    rows = running_total(with_row_index(counts, "v", name="i"), "i", "c", "upto")
    return rows.select("v", "c", (F.col("upto") - F.col("c")).alias("before"))


def _tails(df: DataFrame, x: str, by: list[str], proportion: float) -> DataFrame:
    if not 0 <= proportion < 0.5:
        raise ValueError("proportion must be in [0, 0.5)")
    rows = df.select(*by, observed(x).alias("v")).where("v is not null")
    stats = _order_statistics(rows, by)
    n = _stat(rows, by, F.count(F.lit(1)).alias("n")).withColumn("k", F.floor(F.col("n") * proportion))
    return beside(stats, n, by)


def _cut_values(df: DataFrame, x: str, proportion: float) -> tuple[DataFrame, dict]:
    """Rows (v), and of all of them: n, k, the outermost values kept, the sum between and the counts up to and from those."""
    from ..plans.order import values_at

    if not 0 <= proportion < 0.5:
        raise ValueError("proportion must be in [0, 0.5)")
    rows = df.select(observed(x).alias("v")).where("v is not null")
    n = rows.count()
    k = int(n * proportion)
    lo, hi = values_at(rows, "v", [k, n - 1 - k]) if n else (None, None)
    v = F.col("v")
    s = rows.agg(F.sum(F.when((v > F.lit(lo)) & (v < F.lit(hi)), v)).alias("s"), F.count_if(v <= F.lit(lo)).alias("low"), F.count_if(v >= F.lit(hi)).alias("high")).first()
    return rows, {"n": n, "k": k, "lo": lo, "hi": hi, "s": s["s"] or 0.0, "low": s["low"], "high": s["high"]}


def _one_value(df: DataFrame, name: str, value: float | None) -> DataFrame:
    return df.sparkSession.createDataFrame([(None if value is None else float(value),)], f"{name} double")


def trimmed_mean(df: DataFrame, x: str, by: list[str] = (), proportion: float = 0.1) -> DataFrame:
    """The mean without floor(n * proportion) values of each tail."""
    by = list(by)
    if not by:
        _, c = _cut_values(df, x, proportion)
        if not c["n"] or c["lo"] == c["hi"]:
            return _one_value(df, "trimmed_mean", c["lo"])
        return _one_value(df, "trimmed_mean", (c["s"] + c["lo"] * (c["low"] - c["k"]) + c["hi"] * (c["high"] - c["k"])) / (c["n"] - 2 * c["k"]))
    t = _tails(df, x, by, proportion)
    kept = F.greatest(F.lit(0), F.least(F.col("before") + F.col("c"), F.col("n") - F.col("k")) - F.greatest("before", "k"))
    return t.groupBy(*by).agg((F.sum(F.col("v") * kept) / F.sum(kept)).alias("trimmed_mean"))


def winsorized_mean(df: DataFrame, x: str, by: list[str] = (), proportion: float = 0.1) -> DataFrame:
    """The mean with floor(n * proportion) values of each tail moved to the nearest value kept."""
    by = list(by)
    if not by:
        _, c = _cut_values(df, x, proportion)
        if not c["n"] or c["lo"] == c["hi"]:
            return _one_value(df, "winsorized_mean", c["lo"])
        return _one_value(df, "winsorized_mean", (c["s"] + c["lo"] * c["low"] + c["hi"] * c["high"]) / c["n"])
    t = _tails(df, x, by, proportion)
    inside = (F.col("before") + F.col("c") > F.col("k")) & (F.col("before") < F.col("n") - F.col("k"))
    ends = t.where(inside).groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = beside(t, ends, by)
    return t.groupBy(*by).agg((F.sum(F.least(F.greatest("v", "lo"), "hi") * F.col("c")) / F.first("n")).alias("winsorized_mean"))


def hinges(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Tukey's hinges: medians of the lower and upper half, the median left out for odd n; and their distance iqr."""
    by = list(by)
    rows = df.select(*by, observed(x).alias("v")).where("v is not null")
    stats = beside(_order_statistics(rows, by), _stat(rows, by, F.count(F.lit(1)).alias("n")), by)
    half = F.floor(F.col("n") / 2)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("c")), F.col("v")))

    lo = (at(F.floor((half - 1) / 2)) + at(F.floor(half / 2))) / 2
    up = F.col("n") - half
    hi = (at(up + F.floor((half - 1) / 2)) + at(up + F.floor(half / 2))) / 2
    return stats.groupBy(*by).agg(lo.alias("lower"), hi.alias("upper"), (hi - lo).alias("iqr"))


def outliers(df: DataFrame, x: str, by: list[str] = (), k: float = 1.5) -> DataFrame:
    """The rows whose value lies beyond k hinge distances from the hinges."""
    by = list(by)
    h = hinges(df, x, by).select(*by, (F.col("lower") - k * F.col("iqr")).alias("fence_low"), (F.col("upper") + k * F.col("iqr")).alias("fence_high"))
    return beside(df, h, by).where((observed(x) < F.col("fence_low")) | (observed(x) > F.col("fence_high")))


def huber_mean(df: DataFrame, x: str, k: float = 1.345, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """Huber's M-estimate of location: one weighted mean a round."""
    rows = df.select(observed(x).alias("v")).where("v is not null").persist()
    start = mad(rows, "v").first()
    if start is None or start["median"] is None:
        rows.unpersist()
        return df.sparkSession.createDataFrame([(None, 0)], "huber_mean double, rounds int")
    mu, scale, done = start["median"], start["mad"], 0
    while scale and done < rounds:
        z = F.abs(F.col("v") - mu) / scale
        w = F.when(z <= k, 1.0).otherwise(k / z)
        new = rows.agg(F.sum(w * F.col("v")) / F.sum(w)).first()[0]
        done += 1
        mu, step = new, abs(new - mu)
        if step < tol * scale:
            break
    rows.unpersist()
    return df.sparkSession.createDataFrame([(float(mu), done)], "huber_mean double, rounds int")


def biweight_midvariance(df: DataFrame, x: str, by: list[str] = (), c: float = 9.0) -> DataFrame:
    """Tukey's biweight midvariance; 0 where the median deviation is 0."""
    by = list(by)
    rows = df.select(*by, observed(x).alias("v")).where("v is not null")
    rows = beside(rows, mad(rows, "v", by, 1.0), by)
    d = F.col("v") - F.col("median")
    u2 = F.pow(d / (c * F.col("mad")), 2)
    near = (F.col("mad") > 0) & (u2 < 1)
    top = F.sum(F.when(near, d * d * F.pow(1 - u2, 4)))
    low = F.sum(F.when(near, (1 - u2) * (1 - 5 * u2)))
    return rows.groupBy(*by).agg(F.coalesce(F.count(F.lit(1)) * top / (low * low), F.lit(0.0)).alias("biweight_midvariance"))


def weighted_stats(df: DataFrame, x: str, w: str, by: list[str] = ()) -> DataFrame:
    """Weighted mean, variance with reliability weights, sd and Kish's effective size."""
    by = list(by)
    rows = df.select(*by, observed(x).alias("v"), observed(w).alias("w")).where("v is not null and w is not null")
    rows = beside(rows, _stat(rows, by, (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")), by)
    w1, w2 = F.sum("w"), F.sum(F.col("w") * F.col("w"))
    var = F.sum(F.col("w") * F.pow(F.col("v") - F.col("m"), 2)) / (w1 - w2 / w1)
    return rows.groupBy(*by).agg(F.first("m").alias("mean"), var.alias("variance"), F.sqrt(var).alias("sd"), (w1 * w1 / w2).alias("effective_n"))


def weighted_quantile(df: DataFrame, x: str, w: str, p: float, by: list[str] = ()) -> DataFrame:
    """The first value whose cumulated weight reaches p of all."""
    by = list(by)
    rows = df.select(*by, observed(x).alias("v"), observed(w).alias("w")).where("v is not null and w > 0").groupBy(*by, "v").agg(F.sum("w").alias("c"))
    if by:
        upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("upto", F.sum("c").over(upto))
    else:
        from ..plans.order import running_total, with_row_index

        rows = running_total(with_row_index(rows, "v", name="i"), "i", "c", "upto")
    rows = beside(rows, _stat(rows, by, F.sum("c").alias("all")), by)
    return rows.where(F.col("upto") >= p * F.col("all")).groupBy(*by).agg(F.min("v").alias("quantile"))


def horvitz_thompson(df: DataFrame, y: str, prob: str, population: float, by: list[str] = ()) -> DataFrame:
    """Total and mean of a population from inclusion probabilities, with the total's standard error."""
    v, p = observed(y), observed(prob)
    total = F.sum(v / p)
    var = F.sum((1 - p) / (p * p) * v * v)
    return _stat(df, list(by), total.alias("total"), (total / population).alias("mean"), F.sqrt(var).alias("se_total"), (F.sqrt(var) / population).alias("se_mean"))


def design_effect(df: DataFrame, w: str, by: list[str] = ()) -> DataFrame:
    """Kish's design effect of weights and the effective size."""
    c = observed(w)
    n, s1, s2 = F.count(c), F.sum(c), F.sum(c * c)
    return _stat(df, list(by), (n * s2 / (s1 * s1)).alias("deff"), (s1 * s1 / s2).alias("effective_n"))


def ratio_estimate(df: DataFrame, y: str, x: str, w: str, x_total: float, by: list[str] = ()) -> DataFrame:
    """Weighted ratio of totals, the total it gives for y, and the ratio's linearised variance."""
    by = list(by)
    rows = df.select(*by, observed(y).alias("y"), observed(x).alias("x"), observed(w).alias("w")).dropna(subset=["y", "x", "w"])
    stats = _stat(rows, by, (F.sum(F.col("w") * F.col("y")) / F.sum(F.col("w") * F.col("x"))).alias("r"), F.sum(F.col("w") * F.col("x")).alias("wx"))
    rows = beside(rows, stats, by)
    n = F.count(F.lit(1))
    var = n / (n - 1) * F.sum(F.pow(F.col("w") * (F.col("y") - F.col("r") * F.col("x")), 2)) / F.pow(F.first("wx"), 2)
    return rows.groupBy(*by).agg(F.first("r").alias("ratio"), (F.first("r") * x_total).alias("total"), var.alias("variance"))


def post_stratify(df: DataFrame, w: str, stratum: str, population: DataFrame) -> DataFrame:
    """Adds post_weight: weights scaled so that each stratum sums to its population (columns stratum, population)."""
    sums = df.groupBy(stratum).agg(F.sum(w).alias("__s")).withColumnRenamed(stratum, "__h")
    sums = sums.join(population.select(F.col("stratum").alias("__k"), F.col("population").alias("__p")), F.col("__h") == F.col("__k"), "left")
    known = F.when(F.col("__p").isNull(), F.raise_error(F.concat(F.lit("no population of stratum "), F.col("__h").cast("string")))).otherwise(F.col("__p").cast("double"))
    rows = df.join(sums.select("__h", (known / F.col("__s")).alias("__f")), F.col(stratum) == F.col("__h"))
    return rows.withColumn("post_weight", F.col(w) * F.col("__f")).drop("__h", "__f")


def missing_summary(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """For each column: rows, missing, the proportion missing."""
    by = list(by)
    aggs = [F.count(F.lit(1)).alias("rows"), *[F.count_if(observed(c).isNull()).alias(f"__{i}") for i, c in enumerate(columns)]]
    wide = df.groupBy(*by).agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("missing")) for i, c in enumerate(columns)])
    long = wide.select(*by, "rows", F.inline(parts))
    return long.withColumn("proportion", F.col("missing") / F.col("rows"))


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listwise (with two columns: pairwise) deletion."""
    for c in columns:
        df = df.where(observed(c).isNotNull())
    return df


def quantile_points(df: DataFrame, x: str, quantile) -> DataFrame:
    """Rows (i, theoretical, sample) of a quantile-quantile plot: sorted values against ``quantile`` of a Column of chances.

    The chance of the i-th of n values is (i + 0.6825) / (n + 0.365), from i = 0.
    ``quantile`` may be that of a ``distributions.distribution``.
    """
    from ..plans.order import with_row_index

    rows = with_row_index(df.select(observed(x).alias("sample")).where("sample IS NOT NULL"), "sample", name="i")
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("__n"))
    return beside(rows, n, []).select("i", quantile((F.col("i") + 0.6825) / (F.col("__n") + 0.365)).alias("theoretical"), "sample")


def pairs_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (x_name, y_name, x, y) for each ordered pair of columns, as a matrix of scatter plots takes them; missing values stay null."""
    cells = [F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), observed(a).alias("x"), observed(b).alias("y")) for a in columns for b in columns if a != b]
    return df.select(F.inline(F.array(*cells)))


def fill_with(df: DataFrame, x: str, how: str = "mean", by: list[str] = ()) -> DataFrame:
    """Fills missing values with the mean, median or mode (the least of the most frequent) of their group."""
    by = list(by)
    v = observed(x)
    if how == "mode":
        counts = df.where(v.isNotNull()).groupBy(*by, v.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
        stat = counts.groupBy(*by).agg(F.max_by("__v", F.struct("__c", F.negate("__v"))).alias("__fill"))
    elif how in ("mean", "median"):
        stat = df.groupBy(*by).agg((F.avg(v) if how == "mean" else F.median(v)).alias("__fill"))
    else:
        raise ValueError(f"unknown fill {how!r}")
    return beside(df, stat, by).withColumn(x, F.coalesce(v, "__fill")).drop("__fill")


def forward_fill(df: DataFrame, x: str, t: str, series: list[str]) -> DataFrame:
    """Carries the last observation of a series forward; a leading gap gets its first one."""
    back = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*series).orderBy(t).rowsBetween(0, Window.unboundedFollowing)
    v = observed(x)
    return df.withColumn(x, F.coalesce(F.last(v, True).over(back), F.first(v, True).over(ahead)))


def interpolate(df: DataFrame, x: str, t: str, series: list[str]) -> DataFrame:
    """Fills gaps of a series linearly by row, and its ends with the nearest observation."""
    w = Window.partitionBy(*series).orderBy(t)
    rows = df.withColumns({"__i": F.row_number().over(w), "__v": observed(x)})
    back, ahead = (Window.partitionBy(*series).orderBy(t).rowsBetween(*b) for b in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)))
    at = F.when(F.col("__v").isNotNull(), F.struct("__i", "__v"))
    rows = rows.withColumns({"__a": F.last(at, True).over(back), "__b": F.first(at, True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    between = a["__v"] + (b["__v"] - a["__v"]) * (F.col("__i") - a["__i"]) / (b["__i"] - a["__i"])
    return rows.withColumn(x, F.coalesce("__v", between, b["__v"], a["__v"])).drop("__i", "__v", "__a", "__b")


def histogram(df: DataFrame, x: str, bins: int | None = None) -> DataFrame:
    """Bins of equal width (by default ceil(log2 n + 1)): bin, low, high, n, density; empty ones too."""
    v = observed(x)
    s = df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    k = bins or (max(1, (s["n"] - 1).bit_length() + 1) if s["n"] else 1)
    width = ((s["hi"] - s["lo"]) / k or 1.0) if s["n"] else 1.0
    lo = s["lo"] if s["n"] else 0.0
    counts = df.where(v.isNotNull()).groupBy(F.least(F.floor((v - lo) / width), F.lit(k - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    grid = df.sparkSession.range(k).withColumnRenamed("id", "bin")
    out = grid.join(F.broadcast(counts), "bin", "left")  # k rows
    n = F.coalesce("c", F.lit(0))
    return out.select("bin", (lo + F.col("bin") * width).alias("low"), (lo + (F.col("bin") + 1) * width).alias("high"), n.alias("n"), (n / (max(s["n"], 1) * width)).alias("density"))


def box_plot(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Quartiles, 1.5 iqr whiskers and the number of outliers on either side."""
    by = list(by)
    rows = df.select(*by, observed(x).alias("v")).where("v is not null")
    q = percentiles(rows, "v", [25, 50, 75], by).withColumn("iqr", F.col("p75") - F.col("p25"))
    rows = beside(rows, q, by)
    lo, hi, v = F.col("p25") - 1.5 * F.col("iqr"), F.col("p75") + 1.5 * F.col("iqr"), F.col("v")
    return rows.groupBy(*by).agg(
        F.first("p25").alias("q1"), F.first("p50").alias("median"), F.first("p75").alias("q3"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"), F.count_if(v < lo).alias("n_low"), F.count_if(v > hi).alias("n_high"),
    )


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """Per different value: its count and the cumulative proportion after the last of its rows."""
    rows = df.select(observed(x).alias("v")).where("v is not null")
    stats = _order_statistics(rows, [])
    n = rows.count()
    return stats.select("v", F.col("c").alias("n"), ((F.col("before") + F.col("c")) / F.lit(max(n, 1))).alias("p"))


def density(df: DataFrame, x: str, points: int = 100, bandwidth: float | None = None) -> DataFrame:
    """A Gaussian kernel density on a grid over the range: values are binned by count first, so rows meet the grid once."""
    v = observed(x)
    s = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"), F.percentile(v, [0.25, 0.75]).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if not s["n"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    spread = min(a for a in (s["sd"] or 0.0, (s["q"][1] - s["q"][0]) / 1.34) if a > 0) if (s["sd"] or 0) > 0 and s["q"][1] > s["q"][0] else (s["sd"] or 1.0)
    h = bandwidth or 0.9 * spread * s["n"] ** -0.2
    step = (s["hi"] - s["lo"]) / max(points - 1, 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(float(s["lo"])) + i * step))
    counts = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    terms = counts.withColumn("x", grid).groupBy("x").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / h, 2))).alias("t"))
    return terms.select("x", (F.col("t") / (s["n"] * h * 2.5066282746310002)).alias("density"))
