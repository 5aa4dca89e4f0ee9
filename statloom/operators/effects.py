"""Intervals, effect sizes, power and comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .descriptive import beside, observed
from .hypothesis import two_sides


def _p(name: str, *args) -> Column:
    return special.column(name, *args)


def _z(confidence: float) -> float:
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    return float(special.normal_quantile(0.5 + confidence / 2))


def mean_interval(df: DataFrame, x: str, confidence: float = 0.95, by: list[str] = ()) -> DataFrame:
    """n, mean, low and high of the t interval."""
    v = observed(x)
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"))
    half = _p("t_quantile", F.lit(0.5 + confidence / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    s = s.withColumn("__h", half)
    return s.select(*by, "n", "mean", (F.col("mean") - F.col("__h")).alias("low"), (F.col("mean") + F.col("__h")).alias("high"))


def paired_mean_interval(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    return mean_interval(df.select((observed(x) - observed(y)).alias("d")), "d", confidence)


def mean_difference_interval(df: DataFrame, x: str, group: str, a, b, confidence: float = 0.95) -> DataFrame:
    """Welch's interval of mean(a) - mean(b)."""
    s = two_sides(df, x, group, a, b)
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    free = F.pow(e1 + e2, 2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    s = s.withColumns({"difference": F.col("mean1") - F.col("mean2"), "df": free})
    s = s.withColumn("__h", _p("t_quantile", F.lit(0.5 + confidence / 2), F.col("df")) * F.sqrt(e1 + e2))
    return s.select("difference", "df", (F.col("difference") - F.col("__h")).alias("low"), (F.col("difference") + F.col("__h")).alias("high"))


def proportion_interval(df: DataFrame, success: Column, confidence: float = 0.95, by: list[str] = ()) -> DataFrame:
    """Wilson's score interval of the proportion of rows with a true condition."""
    z = _z(confidence)
    s = df.where(success.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(success).alias("successes"))
    n, p = F.col("n"), F.col("successes") / F.col("n")
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return s.select(*by, "n", "successes", p.alias("proportion"), (centre - half).alias("low"), (centre + half).alias("high"))


def proportion_difference_interval(df: DataFrame, success: Column, group: str, a, b, confidence: float = 0.95) -> DataFrame:
    """Wald's interval of the difference of two groups' proportions."""
    z = _z(confidence)
    one, two = (F.avg(F.when(F.col(group) == F.lit(g), success.cast("double"))) for g in (a, b))
    n1, n2 = (F.count(F.when(F.col(group) == F.lit(g), success)) for g in (a, b))
    s = df.agg(one.alias("p1"), two.alias("p2"), n1.alias("n1"), n2.alias("n2"))
    d = F.col("p1") - F.col("p2")
    half = z * F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p2") * (1 - F.col("p2")) / F.col("n2"))
    return s.select("p1", "p2", d.alias("difference"), (d - half).alias("low"), (d + half).alias("high"))


def _label(size: Column, small: float, medium: float, large: float) -> Column:
    return F.when(F.abs(size) < small, "negligible").when(F.abs(size) < medium, "small").when(F.abs(size) < large, "medium").otherwise("large")


def standardized_difference(df: DataFrame, x: str, group: str, a, b) -> DataFrame:
    """Cohen's d with its label, Hedges' g and Glass's delta (b is the control)."""
    s = two_sides(df, x, group, a, b)
    n1, n2 = F.col("n1"), F.col("n2")
    free = n1 + n2 - 2
    d = F.col("mean1") - F.col("mean2")
    cohen = d / F.sqrt(((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / free)
    return s.select(cohen.alias("cohens_d"), (cohen * (1 - 3 / (4 * free - 1))).alias("hedges_g"), (d / F.sqrt("var2")).alias("glass_delta"), _label(cohen, 0.2, 0.5, 0.8).alias("label"))


def paired_cohens_d(df: DataFrame, x: str, y: str) -> DataFrame:
    d = observed(x) - observed(y)
    return df.agg((F.avg(d) / F.stddev_samp(d)).alias("cohens_d"))


def variance_explained(anova: DataFrame) -> DataFrame:
    """Eta squared, omega squared (0 at least) and Cohen's f from a row of ``one_way_anova``."""
    b, w = F.col("ss_between"), F.col("ss_within")
    msw = w / F.col("df_within")
    eta = b / (b + w)
    f = F.sqrt(eta / (1 - eta))
    omega = F.greatest(F.lit(0.0), (b - F.col("df_between") * msw) / (b + w + msw))
    return anova.select(eta.alias("eta_squared"), eta.alias("partial_eta_squared"), omega.alias("omega_squared"), f.alias("cohens_f"), _label(f, 0.1, 0.25, 0.4).alias("label"))


def point_biserial(t: Column, df: Column) -> Column:
    """The correlation that a t statistic stands for."""
    return F.signum(t) * F.sqrt(t * t / (t * t + df))


def normal_power(shift: Column, alpha: float = 0.05, tails: int = 2) -> Column:
    """The power of a z test whose statistic has the mean ``shift``."""
    if tails not in (1, 2):
        raise ValueError("tails must be 1 or 2")
    cut = float(special.normal_quantile(1 - alpha / tails))
    up = _p("normal_cdf", F.abs(shift) - cut)
    return up if tails == 1 else up + _p("normal_cdf", -F.abs(shift) - cut)


def two_sample_power(effect: Column, n: Column, alpha: float = 0.05, tails: int = 2) -> Column:
    """Power of a two-sample test with n rows in each group (normal approximation)."""
    return normal_power(effect * F.sqrt(n / 2), alpha, tails)


def one_sample_power(effect: Column, n: Column, alpha: float = 0.05, tails: int = 2) -> Column:
    """Power of a one-sample or paired test (normal approximation)."""
    return normal_power(effect * F.sqrt(n), alpha, tails)


def proportion_power(p1: Column, p2: Column, n: Column, alpha: float = 0.05, tails: int = 2) -> Column:
    """Power of a test of two proportions with n rows each."""
    cut = float(special.normal_quantile(1 - alpha / tails))
    mid = (p1 + p2) / 2
    se0, se1 = F.sqrt(2 * mid * (1 - mid) / n), F.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / n)
    return _p("normal_cdf", (F.abs(p1 - p2) - cut * se0) / se1)


def correlation_power(r: Column, n: Column, alpha: float = 0.05, tails: int = 2) -> Column:
    """Power of a test of zero correlation by Fisher's z."""
    return normal_power(F.atanh(r) * F.sqrt(n - 3), alpha, tails)


def anova_power(f: Column, groups: Column | float, n: Column, alpha: float = 0.05) -> Column:
    """Power of a one-way analysis of variance with n rows in each group, for Cohen's f."""
    k = groups if isinstance(groups, Column) else F.lit(float(groups))
    d1, d2 = k - 1, k * (n - 1)
    return _p("noncentral_f_sf", _p("f_quantile", F.lit(1 - alpha), d1, d2), d1, d2, k * n * f * f)


def chi_squared_power(w: Column, df: Column | float, n: Column, alpha: float = 0.05) -> Column:
    """Power of a chi-squared test with n rows in all, for Cohen's w."""
    free = df if isinstance(df, Column) else F.lit(float(df))
    return _p("noncentral_chi2_sf", _p("chi2_quantile", F.lit(1 - alpha), free), free, n * w * w)


def observed_power(df: DataFrame, x: str, group: str, alpha: float = 0.05) -> DataFrame:
    """One row: groups, n (harmonic mean of their sizes), Cohen's f of the group means and the power of their comparison."""
    v = observed(x)
    s = df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v")).where("n > 0")
    n, m = F.col("n"), F.col("m")
    t = s.agg(F.count(F.lit(1)).alias("groups"), (F.count(F.lit(1)) / F.sum(1 / n)).alias("n"), F.sum(n).alias("all"), F.sum(n * F.col("v")).alias("within"), (F.sum(n * m * m) - F.pow(F.sum(n * m), 2) / F.sum(n)).alias("between"))
    t = t.select("groups", "n", F.sqrt(F.col("between") / F.col("within")).alias("f"))
    return t.withColumn("power", anova_power(F.col("f"), F.col("groups").cast("double"), F.col("n"), alpha))


def least_n(table: DataFrame, power_of, power: float = 0.8, low: int = 2, doublings: int = 20) -> DataFrame:
    """Adds n: for each row of a table, the least whole number (``low`` at least) whose power, ``power_of`` of a Column, reaches ``power``.

    Doublings of ``low`` are tried first, all in one pass; each further pass tries
    64 numbers of a row's own interval.  Null where ``doublings`` don't reach it.
    """
    rows = table.withColumn("__id", F.monotonically_increasing_id())
    names = [F.col(c) for c in rows.columns]
    reached = power_of(F.col("__m").cast("double")) >= power

    def tried(rows: DataFrame, numbers: Column) -> DataFrame:
        """The least number tried that reaches the power, and the largest below it."""
        out = rows.withColumn("__m", F.explode(numbers)).withColumn("__ok", F.coalesce(reached, F.lit(False))).groupBy(*names)
        out = out.agg(F.min(F.when(F.col("__ok"), F.col("__m"))).alias("__hi"), F.sort_array(F.collect_list("__m")).alias("__all"))
        return out.withColumn("__lo", F.coalesce(F.array_max(F.filter("__all", lambda m: m < F.col("__hi"))), F.lit(low - 1).cast("long"))).drop("__all")

    rows = tried(rows, F.array(*[F.lit(low << k).cast("long") for k in range(doublings + 1)]))
    width = low << doublings
    while width > 1:
        step = F.greatest(F.ceil((F.col("__hi") - F.col("__lo")) / 64), F.lit(1)).cast("long")
        numbers = F.when(F.col("__hi").isNotNull(), F.array_union(F.sequence(F.least(F.col("__lo") + step, F.col("__hi")), F.col("__hi"), step), F.array("__hi"))).otherwise(F.array(F.lit(low).cast("long")))
        base = rows.select(*names, "__hi", "__lo").withColumnsRenamed({"__hi": "__h", "__lo": "__l"})
        found = tried(rows, numbers).withColumnsRenamed({"__id": "__i"}).select("__i", "__hi", "__lo")
        rows = base.join(found, base["__id"] == found["__i"]).select(*names, F.when(F.col("__h").isNotNull(), F.col("__hi")).alias("__hi"), F.greatest("__l", "__lo").alias("__lo"))
        width = -(-width // 64)
    return rows.select(*[F.col(c) for c in table.columns], F.col("__hi").alias("n"))


def sample_size(spark, power_of, power: float = 0.8, most: int = 1_000_000) -> DataFrame:
    """The least n (column n) whose power, ``power_of`` of a Column, reaches ``power``; null beyond ``most``.

    All sizes are tried at once: the grid is spread over tasks and reduced to a minimum.
    """
    grid = spark.range(2, most + 1).select(F.col("id").alias("n"), power_of(F.col("id").cast("double")).alias("power"))
    return grid.where(F.col("power") >= power).agg(F.min("n").alias("n"), F.min_by("power", "n").alias("power"))


def information_criteria(models: DataFrame, log_lik: str, k: str, n: str) -> DataFrame:
    """Adds aic, aicc (infinite where undefined) and bic."""
    ll, p, m = F.col(log_lik), F.col(k), F.col(n)
    aic = 2 * p - 2 * ll
    rest = m - p - 1
    return models.withColumns({"aic": aic, "aicc": F.when(rest > 0, aic + 2 * p * (p + 1) / rest).otherwise(float("inf")), "bic": F.ln(m) * p - 2 * ll})


def compare_models(models: DataFrame, log_lik: str, k: str, n: str) -> DataFrame:
    """Models with delta and Akaike weight, best first."""
    out = information_criteria(models, log_lik, k, n)
    out = beside(out, out.agg(F.min("aic").alias("__best")), [])
    out = out.withColumn("delta", F.col("aic") - F.col("__best")).drop("__best")
    out = beside(out, out.agg(F.sum(F.exp(-F.col("delta") / 2)).alias("__all")), [])
    return out.withColumn("weight", F.exp(-F.col("delta") / 2) / F.col("__all")).drop("__all").orderBy("aic")


def likelihood_ratio(restricted: Column, full: Column, df: Column) -> tuple[Column, Column]:
    """(statistic, p_value) of nested models."""
    s = F.greatest(F.lit(0.0), 2 * (full - restricted))
    return s, _p("chi2_sf", s, df)


def vuong(df: DataFrame, ll1: str, ll2: str) -> DataFrame:
    """z of the pointwise differences of two models' log likelihoods."""
    d = observed(ll1) - observed(ll2)
    s = df.agg((F.sqrt(F.count(d)) * F.avg(d) / F.stddev_samp(d)).alias("statistic"))
    return s.withColumn("p_value", _p("normal_two_sided", F.col("statistic")))
