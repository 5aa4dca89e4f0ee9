"""Hypothesis tests: one or two aggregates each, then a p-value on the few rows that are left.

Results have the columns statistic, df (where there is one) and p_value; a test
that its data can't support gives nulls.  ``by`` runs a test for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import running_total, with_average_rank, with_row_index
from .descriptive import beside, observed


def _p(name: str, *args: Column) -> Column:
    return special.column(name, *args)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def one_sample_t(df: DataFrame, x: str, mu0: float = 0.0, by: list[str] = ()) -> DataFrame:
    """n, mean, statistic, df, p_value of the mean against ``mu0``."""
    v = observed(x)
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("__var"))
    s = s.withColumns({"statistic": _ratio(F.col("mean") - mu0, F.sqrt(F.col("__var") / F.col("n"))), "df": (F.col("n") - 1).cast("double")})
    return s.withColumn("p_value", _p("t_two_sided", F.col("statistic"), F.col("df"))).drop("__var")


def paired_t(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """One-sample t test of x - y."""
    rows = df.select(*by, (observed(x) - observed(y)).alias("__d"))
    return one_sample_t(rows, "__d", 0.0, list(by))


def two_sides(df: DataFrame, x: str, group: str, a, b, by: list[str] = ()) -> DataFrame:
    """n, mean and variance of two levels of a group column, in one aggregate."""
    v = observed(x)
    aggs = []
    for i, level in ((1, a), (2, b)):
        c = F.when(F.col(group) == F.lit(level), v)
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.var_samp(c).alias(f"var{i}")]
    return df.groupBy(*by).agg(*aggs)


def two_sample_t(df: DataFrame, x: str, group: str, a, b, by: list[str] = (), pooled: bool = False) -> DataFrame:
    """Welch's t test, or with ``pooled`` Student's, of level a against level b."""
    s = two_sides(df, x, group, a, b, by)
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    if pooled:
        free = (n1 + n2 - 2).cast("double")
        se = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / free * (1 / n1 + 1 / n2))
    else:
        e1, e2 = v1 / n1, v2 / n2
        se = F.sqrt(e1 + e2)
        free = _ratio((e1 + e2) * (e1 + e2), e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
    s = s.withColumns({"statistic": _ratio(F.col("mean1") - F.col("mean2"), se), "df": free})
    return s.select(*by, "n1", "n2", "mean1", "mean2", "statistic", "df", _p("t_two_sided", F.col("statistic"), F.col("df")).alias("p_value"))


def one_way_anova(df: DataFrame, x: str, group: str, by: list[str] = ()) -> DataFrame:
    """Sums of squares between and within groups, their degrees of freedom, F and its p-value."""
    by = list(by)
    v = observed(x)
    cells = df.where(v.isNotNull()).groupBy(*by, group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    grand = cells.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    cells = beside(cells, grand, by)
    s = cells.groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ss_between"),
        F.sum(F.col("n") * F.col("s2")).alias("ss_within"),
        (F.count(F.lit(1)) - 1).cast("double").alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).cast("double").alias("df_within"),
    )
    f = _ratio(F.col("ss_between") / F.col("df_between"), F.col("ss_within") / F.col("df_within"))
    s = s.withColumn("statistic", f)
    return s.withColumn("p_value", _p("f_sf", F.col("statistic"), F.col("df_between"), F.col("df_within")))


def two_way_anova(df: DataFrame, x: str, a: str, b: str) -> DataFrame:
    """One row for each of the sources a, b, interaction and within: ss, df, statistic, p_value."""
    v = observed(x)
    cells = df.where(v.isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    one = cells.groupBy("a").agg(mean.alias("ma"))
    two = cells.groupBy("b").agg(mean.alias("mb"))
    all_ = cells.agg(mean.alias("gm"))
    full = beside(beside(beside(cells, one, ["a"]), two, ["b"]), all_, [])
    n = F.col("n")

    def ss(c: str) -> Column:
        return F.sum(n * F.pow(F.col(c) - F.col("gm"), 2))

    s = full.agg(
        ss("ma").alias("ssa"), ss("mb").alias("ssb"), ss("m").alias("ssc"), F.sum(n * F.col("s2")).alias("ssw"),
        F.countDistinct("a").alias("ka"), F.countDistinct("b").alias("kb"), F.count(F.lit(1)).alias("kc"), F.sum("n").alias("n"),
    )
    ka, kb = F.col("ka"), F.col("kb")
    rows = F.array(*[
        F.struct(F.lit(name).alias("source"), ss_.cast("double").alias("ss"), free.cast("double").alias("df"))
        for name, ss_, free in (
            ("a", F.col("ssa"), ka - 1),
            ("b", F.col("ssb"), kb - 1),
            ("interaction", F.greatest(F.lit(0.0), F.col("ssc") - F.col("ssa") - F.col("ssb")), (ka - 1) * (kb - 1)),
            ("within", F.col("ssw"), F.col("n") - ka * kb),
        )
    ])
    whole = F.when(F.col("kc") == ka * kb, rows)  # an empty cell leaves no analysis
    out = s.select(F.inline(whole), F.struct(F.col("ssw").alias("ss"), (F.col("n") - ka * kb).alias("df")).alias("w"))
    f = F.when(F.col("source") != "within", _ratio(F.col("ss") / F.col("df"), F.col("w.ss") / F.col("w.df")))
    out = out.select("source", "ss", "df", f.alias("statistic"), F.col("w.df").cast("double").alias("dw"))
    return out.withColumn("p_value", _p("f_sf", F.col("statistic"), F.col("df"), F.col("dw"))).drop("dw")


def levene(df: DataFrame, x: str, group: str, centre: str = "median") -> DataFrame:
    """ANOVA of absolute deviations from each group's median (or mean)."""
    if centre not in ("median", "mean"):
        raise ValueError(f"unknown centre {centre!r}")
    rows = df.select(F.col(group).alias("g"), observed(x).alias("v")).where("v is not null")
    mid = rows.groupBy("g").agg((F.median("v") if centre == "median" else F.avg("v")).alias("c"))
    away = beside(rows, mid, ["g"]).select("g", F.abs(F.col("v") - F.col("c")).alias("d"))
    out = one_way_anova(away, "d", "g")
    return out.select(F.coalesce("statistic", F.lit(0.0)).alias("statistic"), "df_between", "df_within", "p_value")


def ks_one_sample(df: DataFrame, x: str, cdf) -> DataFrame:
    """Kolmogorov-Smirnov distance to a distribution; ``cdf`` maps a Column to a Column."""
    from .descriptive import _order_statistics

    rows = df.select(observed(x).alias("v")).where("v is not null")
    stats = beside(_order_statistics(rows, []), rows.agg(F.count(F.lit(1)).alias("n")), [])
    stats = stats.withColumn("f", cdf(F.col("v")))
    d = F.max(F.greatest((F.col("before") + F.col("c")) / F.col("n") - F.col("f"), F.col("f") - F.col("before") / F.col("n")))
    out = stats.agg(d.alias("statistic"), F.max("n").cast("double").alias("n"))
    return out.withColumn("p_value", _p("kolmogorov_sf", F.col("statistic"), F.col("n")))


def ks_two_sample(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Largest distance of two empirical distribution functions, from counts of different values."""
    v = observed(x)
    rows = df.where(v.isNotNull() & F.col(group).isin(a, b))
    counts = rows.groupBy(v.alias("v")).agg(F.count_if(F.col(group) == F.lit(a)).alias("c1"), F.count_if(F.col(group) == F.lit(b)).alias("c2"))
    steps = running_total(running_total(with_row_index(counts, "v", name="i"), "i", "c1", "f1"), "i", "c2", "f2")
    steps = beside(steps, counts.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")), [])
    d = F.max(F.abs(F.col("f1") / F.col("n1") - F.col("f2") / F.col("n2")))
    out = steps.agg(d.alias("statistic"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    return out.withColumn("p_value", _p("kolmogorov_sf", F.col("statistic"), F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))))


def _ranked(df: DataFrame, x: str, *keep: Column) -> DataFrame:
    return with_average_rank(df.select(observed(x).alias("v"), *keep).where("v is not null"), "v")


def mann_whitney(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """The smaller U, and z with tie and continuity correction."""
    rows = _ranked(df.where(F.col(group).isin(a, b)), x, (F.col(group) == F.lit(a)).alias("first"))
    s = rows.agg(
        F.count_if("first").cast("double").alias("n1"), F.count_if(~F.col("first")).cast("double").alias("n2"), F.sum(F.when(F.col("first"), F.col("rank"))).alias("r1"),
        F.sum(F.pow(F.col("rank_ties").cast("double"), 2) - 1).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = _ratio(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5), sd)
    s = s.select(u.alias("statistic"), z.alias("z"))
    return s.withColumn("p_value", _p("normal_two_sided", F.col("z")))


def wilcoxon_signed_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """The smaller sum of signed ranks of the differences that aren't zero, z and p-value (1 if all are zero)."""
    d = df.select((observed(x) - observed(y)).alias("d")).where("d != 0")
    rows = with_average_rank(d.select(F.abs("d").alias("v"), (F.col("d") > 0).alias("up")), "v")
    s = rows.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum(F.when(F.col("up"), F.col("rank"))), F.lit(0.0)).alias("w1"),
        F.coalesce(F.sum(F.pow(F.col("rank_ties").cast("double"), 2) - 1), F.lit(0.0)).alias("ties"),
    )
    n = F.col("n")
    w = F.least(F.col("w1"), n * (n + 1) / 2 - F.col("w1"))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = _ratio(F.greatest(F.lit(0.0), F.abs(w - n * (n + 1) / 4) - 0.5), sd)
    s = s.select("n", w.alias("statistic"), z.alias("z"))
    return s.withColumn("p_value", F.when(n == 0, 1.0).otherwise(_p("normal_two_sided", F.col("z"))))


def kruskal_wallis(df: DataFrame, x: str, group: str) -> DataFrame:
    """H with tie correction."""
    rows = _ranked(df, x, F.col(group).alias("g"))
    sums = rows.groupBy("g").agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.col("rank_ties").cast("double"), 2) - 1).alias("t"))
    s = sums.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("n").cast("double").alias("n"), F.sum("t").alias("t"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    n = F.col("n")
    h = _ratio(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("t") / (n * n * n - n))
    s = s.select(h.alias("statistic"), "df")
    return s.withColumn("p_value", _p("chi2_sf", F.col("statistic"), F.col("df")))


def _standardised(df: DataFrame, x: str) -> DataFrame:
    """Rows v with the position i from 0 in their order, n, mean m and sd s."""
    rows = df.select(observed(x).alias("v")).where("v is not null")
    s = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    return beside(with_row_index(rows, "v", name="i"), s, [])


def shapiro_wilk(df: DataFrame, x: str) -> DataFrame:
    """W from Blom scores, and the p-value of its normal transform (n >= 5)."""
    rows = _standardised(df, x)
    score = _p("normal_quantile", (F.col("i") + 0.625) / (F.col("n") + 0.25))
    rows = rows.withColumns({"a": score, "d": F.col("v") - F.col("m")})
    s = rows.agg(F.max("n").alias("n"), (F.pow(F.sum(F.col("a") * F.col("d")), 2) / (F.sum(F.col("a") * F.col("a")) * F.sum(F.col("d") * F.col("d")))).alias("statistic"))
    ln, lln = F.ln("n"), F.ln(F.ln("n"))
    z = (F.ln(1 - F.col("statistic")) - (-1.2725 + 1.0521 * (lln - ln))) / (1.0308 - 0.26758 * (lln + 2 / ln))
    return s.withColumn("p_value", F.when(F.col("n") >= 5, 1 - _p("normal_cdf", z)))


def anderson_darling(df: DataFrame, x: str) -> DataFrame:
    """Distance to a normal law with estimated mean and sd; adjusted for n, with its piecewise p-value."""
    rows = _standardised(df, x)
    f = F.least(F.greatest(_p("normal_cdf", (F.col("v") - F.col("m")) / F.col("s")), F.lit(1e-15)), F.lit(1 - 1e-15))
    rows = rows.withColumn("f", f)
    i, n = F.col("i"), F.col("n")
    s = rows.agg(F.max("n").alias("n"), F.sum((2 * i + 1) * F.ln("f") + (2 * (n - 1 - i) + 1) * F.ln(1 - F.col("f"))).alias("t"))
    s = s.select("n", (-F.col("n") - F.col("t") / F.col("n")).alias("statistic"))
    a = F.col("statistic") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    s = s.withColumn("adjusted", a)
    z = F.col("adjusted")
    p = (
        F.when(z > 13, 0.0)
        .when(z >= 0.6, F.exp(1.2937 - 5.709 * z + 0.0186 * z * z))
        .when(z >= 0.34, F.exp(0.9177 - 4.279 * z - 1.38 * z * z))
        .when(z >= 0.2, 1 - F.exp(-8.318 + 42.796 * z - 59.938 * z * z))
        .otherwise(1 - F.exp(-13.436 + 101.14 * z - 223.73 * z * z))
    )
    return s.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
