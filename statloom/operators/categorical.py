"""Contingency tables and tests on counts, entropies and divergences.

A table is counted once with partial aggregation; what follows works on its
cells.  Rows with a null category take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .descriptive import beside


def _p(name: str, *args: Column) -> Column:
    return special.column(name, *args)


def cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cells with rows (a, b, n), their margins na and nb, and the total."""
    c = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    c = beside(c, c.groupBy("a").agg(F.sum("n").alias("na")), ["a"])
    c = beside(c, c.groupBy("b").agg(F.sum("n").alias("nb")), ["b"])
    return beside(c, c.agg(F.sum("n").alias("total")), [])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """All cells, empty ones too: n, expected, standardized and adjusted residuals."""
    c = cells(df, a, b)
    rows, cols = c.select("a", "na").distinct(), c.select("b", "nb").distinct()
    grid = beside(rows.crossJoin(cols), c.agg(F.max("total").alias("total")), [])  # one row for each cell of the result
    found = c.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "n")
    grid = grid.join(found, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left")
    n, e = F.coalesce("n", F.lit(0)), F.col("na") * F.col("nb") / F.col("total")
    rest = (1 - F.col("na") / F.col("total")) * (1 - F.col("nb") / F.col("total"))
    return grid.select(
        "a", "b", n.alias("n"), e.alias("expected"), ((n - e) / F.sqrt(e)).alias("standardized"), F.when(rest > 0, (n - e) / F.sqrt(e * rest)).otherwise(0.0).alias("adjusted"),
    )


def _independence(df: DataFrame, a: str, b: str, term: Column, finish) -> DataFrame:
    c = cells(df, a, b)
    s = c.agg(F.sum(term).alias("t"), F.max("total").alias("n"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).cast("double").alias("df"), (F.least(F.countDistinct("a"), F.countDistinct("b")) - 1).alias("k"))
    s = s.withColumn("statistic", finish(F.col("t"), F.col("n")))
    return s.withColumn("p_value", _p("chi2_sf", F.col("statistic"), F.col("df")))


def chi_squared_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic, df, p_value and Cramer's v; empty cells count through the margins."""
    term = F.col("n") * F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))
    s = _independence(df, a, b, term, lambda t, n: t - n)
    return s.select("n", "statistic", "df", "p_value", F.sqrt(F.col("statistic") / (F.col("n") * F.col("k"))).alias("cramers_v"))


def g_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """The likelihood-ratio statistic of independence."""
    term = F.col("n") * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))
    return _independence(df, a, b, term, lambda t, n: 2 * t).select("n", "statistic", "df", "p_value")


def chi_squared_fit(counts: DataFrame, observed: str, expected: str) -> DataFrame:
    """Goodness of fit of a table of observed and expected counts."""
    o, e = F.col(observed).cast("double"), F.col(expected).cast("double")
    e = F.when(e > 0, e).otherwise(F.raise_error(F.lit("expected counts must be positive")).cast("double"))
    s = counts.agg(F.sum(F.pow(o - e, 2) / e).alias("statistic"), (F.count(F.lit(1)) - 1).cast("double").alias("df"))
    return s.withColumn("p_value", _p("chi2_sf", F.col("statistic"), F.col("df")))


def two_by_two(df: DataFrame, row: Column, col: Column, by: list[str] = ()) -> DataFrame:
    """Counts a, b, c, d of two conditions: both; row only; col only; neither."""
    known = row.isNotNull() & col.isNotNull()
    return df.where(known).groupBy(*by).agg(
        F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"), F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d")
    )


def mcnemar(table: DataFrame) -> DataFrame:
    """McNemar's test with continuity correction of a 2 x 2 table."""
    b, c = F.col("b"), F.col("c")
    s = table.withColumn("statistic", F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, 2) / (b + c)))
    return s.withColumn("p_value", F.when(b + c == 0, 1.0).otherwise(_p("chi2_sf", F.col("statistic"), F.lit(1.0)))).select("statistic", "p_value")


def odds_ratio(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Odds ratio with its log interval; half a count is added to all cells if one is empty."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    none = F.least("a", "b", "c", "d") == 0
    a, b, c, d = (F.col(x) + F.when(none, 0.5).otherwise(0.0) for x in "abcd")
    s = table.select(*table.columns, (a * d / (b * c)).alias("odds_ratio"), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d).alias("se_log"))
    return s.withColumns({"low": F.exp(F.ln("odds_ratio") - z * F.col("se_log")), "high": F.exp(F.ln("odds_ratio") + z * F.col("se_log"))})


def relative_risk(table: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Ratio of the risks of the two rows of a table, with its log interval."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    s = table.select(*table.columns, ((a / (a + b)) / (c / (c + d))).alias("relative_risk"), F.sqrt(b / (a * (a + b)) + d / (c * (c + d))).alias("se_log"))
    return s.withColumns({"low": F.exp(F.ln("relative_risk") - z * F.col("se_log")), "high": F.exp(F.ln("relative_risk") + z * F.col("se_log"))})


def phi_coefficient(table: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    size = F.sqrt((a + b) * (c + d) * (a + c) * (b + d))
    return table.withColumn("phi", F.when(size == 0, 0.0).otherwise((a * d - b * c) / size))


def fisher_exact(table: DataFrame) -> DataFrame:
    """Two-sided exact test of one 2 x 2 table: the tables with its margins are spread over tasks and summed."""
    r = table.first()
    a, b, c, d = (int(r[x]) for x in "abcd")
    lo, hi = max(0, a - d), min(a + b, a + c)
    rows = table.sparkSession.range(lo, hi + 1).withColumn("x", F.col("id").cast("double"))

    def log_p(x: Column) -> Column:
        return _p("log_binomial", F.lit(float(a + b)), x) + _p("log_binomial", F.lit(float(c + d)), F.lit(float(a + c)) - x)

    whole = float(special.log_binomial(a + b + c + d, a + c))
    here = float(special.log_binomial(a + b, a) + special.log_binomial(c + d, c)) - whole
    p = F.exp(log_p(F.col("x")) - whole)
    odds = float("inf") if b * c == 0 else a * d / (b * c)
    s = rows.select(p.alias("p")).where(F.col("p") <= float(special.np.exp(here)) + 1e-12)
    return s.agg(F.lit(odds).alias("statistic"), F.least(F.lit(1.0), F.sum("p")).alias("p_value"))


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Cochran-Mantel-Haenszel over 2 x 2 tables, one for each stratum; common odds ratio."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    r1, r2, c1, c2 = a + b, c + d, a + c, b + d
    used = tables.where("a + b + c + d > 1")
    s = used.agg(F.sum(a - r1 * c1 / n).alias("d"), F.sum(r1 * r2 * c1 * c2 / (n * n * (n - 1))).alias("v"), (F.sum(a * d / n) / F.sum(b * c / n)).alias("common_odds_ratio"))
    s = s.select((F.col("d") * F.col("d") / F.col("v")).alias("statistic"), "common_odds_ratio")
    return s.withColumn("p_value", _p("chi2_sf", F.col("statistic"), F.lit(1.0)))


def _entropy(n: Column, total: Column, base: float) -> Column:
    return F.sum(-n / total * F.log(base, n / total))


def entropies(df: DataFrame, a: str, b: str, base: float = 2.0) -> DataFrame:
    """Entropies of a, b and both, the conditional one of b given a, mutual information and its normal form."""
    c = df.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    sets = c.groupingSets([["a", "b"], ["a"], ["b"]], "a", "b").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    sets = beside(sets, c.agg(F.sum("n").alias("total")), [])
    h = {name: _entropy(F.when(F.col("g") == g, F.col("n")), F.col("total"), base) for name, g in (("h_ab", 0), ("h_a", 1), ("h_b", 2))}
    s = sets.agg(*[e.alias(k) for k, e in h.items()])
    mi = F.greatest(F.lit(0.0), F.col("h_a") + F.col("h_b") - F.col("h_ab"))
    both = F.col("h_a") + F.col("h_b")
    return s.select("h_a", "h_b", "h_ab", (F.col("h_ab") - F.col("h_a")).alias("h_b_given_a"), mi.alias("mutual_information"), F.when(both == 0, 0.0).otherwise(2 * mi / both).alias("normalized_mi"))


def entropy(df: DataFrame, x: str, base: float = 2.0, by: list[str] = ()) -> DataFrame:
    """The entropy of a column's values in each group."""
    by = list(by)
    c = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    c = beside(c, c.groupBy(*by).agg(F.sum("__n").alias("__t")), by)
    return c.groupBy(*by).agg(_entropy(F.col("__n"), F.col("__t"), base).alias("entropy"))


def divergences(p: DataFrame, q: DataFrame, base: float = 2.0) -> DataFrame:
    """KL and JS divergence and cross entropy of two distributions (key, p); infinite KL raises."""
    both = p.select(F.col("key").alias("k"), F.col("p").alias("p")).join(q.select(F.col("key").alias("k"), F.col("p").alias("q")), "k", "full")
    x, y = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    bad = (x > 0) & (y == 0)
    y_ = F.when(bad, F.raise_error(F.lit("q is 0 where p is positive")).cast("double")).otherwise(y)
    m = (x + y) / 2

    def kl(u: Column, v: Column) -> Column:
        return F.coalesce(F.sum(F.when(u > 0, u * F.log(base, u / v))), F.lit(0.0))

    return both.agg(kl(x, y_).alias("kl"), ((kl(x, m) + kl(y, m)) / 2).alias("js"), F.sum(F.when(x > 0, -x * F.log(base, y_))).alias("cross_entropy"))
