"""Tests, tables of counts, effect sizes, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import categorical as C
from ..operators import descriptive as D
from ..operators import effects as E
from ..operators import hypothesis as H
from ..operators import multiple
from ..registry import register, table


@register("t_one_sample", "SELECT l_returnflag, count(*) AS n, avg(l_discount) AS mean, (avg(l_discount) - 0.05) / sqrt(var_samp(l_discount) / count(*)) AS statistic, count(*) - 1.0 AS df FROM lineitem GROUP BY l_returnflag", rounded=("mean", "statistic", "df"))
def _t1(spark, sf):
    return H.one_sample_t(table(spark, sf, "lineitem"), "l_discount", 0.05, ["l_returnflag"]).drop("p_value")


_TWO = """WITH s AS (SELECT count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2, avg(l_extendedprice) FILTER (l_returnflag = 'A') AS mean1,
avg(l_extendedprice) FILTER (l_returnflag = 'R') AS mean2, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2 FROM lineitem)"""


@register("t_welch", f"{_TWO} SELECT n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(v1 / n1 + v2 / n2) AS statistic, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df FROM s", rounded=("mean1", "mean2", "statistic", "df"), digits=4)
def _welch(spark, sf):
    return H.two_sample_t(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R").drop("p_value")


@register("t_pooled", f"{_TWO} SELECT n1, n2, mean1, mean2, (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS statistic, n1 + n2 - 2.0 AS df FROM s", rounded=("mean1", "mean2", "statistic", "df"), digits=4)
def _pooled(spark, sf):
    return H.two_sample_t(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R", pooled=True).drop("p_value")


@register("t_paired", "SELECT count(*) AS n, avg(l_discount - l_tax) AS mean, avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)) AS statistic, count(*) - 1.0 AS df FROM lineitem", rounded=("mean", "statistic", "df"), digits=5)
def _paired(spark, sf):
    return H.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax").drop("p_value")


_ANOVA = """WITH g AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m, var_pop({x}) AS s FROM {t} GROUP BY 1), a AS (SELECT sum(n * m) / sum(n) AS gm FROM g),
r AS (SELECT sum(n * (m - gm) ** 2) AS ss_between, sum(n * s) AS ss_within, count(*) - 1.0 AS df_between, sum(n) - count(*) * 1.0 AS df_within FROM g, a)"""


@register("anova_one_way", _ANOVA.format(g="o_orderpriority", x="o_totalprice", t="orders") + " SELECT *, ss_between / df_between / (ss_within / df_within) AS statistic FROM r", rounded=("ss_between", "ss_within", "df_between", "df_within", "statistic"), digits=1)
def _anova(spark, sf):
    return H.one_way_anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").drop("p_value")


@register(
    "anova_two_way",
    """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS s FROM lineitem GROUP BY 1, 2),
    f AS (SELECT *, sum(n * m) OVER (PARTITION BY a) / sum(n) OVER (PARTITION BY a) AS ma, sum(n * m) OVER (PARTITION BY b) / sum(n) OVER (PARTITION BY b) AS mb, sum(n * m) OVER () / sum(n) OVER () AS gm FROM c),
    t AS (SELECT sum(n * (ma - gm) ** 2) AS a, sum(n * (mb - gm) ** 2) AS b, sum(n * (m - gm) ** 2) AS c, sum(n * s) AS w, count(DISTINCT f.a) AS ka, count(DISTINCT f.b) AS kb, sum(n) AS n FROM f),
    u AS (SELECT 'a' AS source, a AS ss, 1.0 * ka - 1 AS df FROM t UNION ALL SELECT 'b', b, 1.0 * kb - 1 FROM t UNION ALL SELECT 'interaction', greatest(0, c - a - b), 1.0 * (ka - 1) * (kb - 1) FROM t UNION ALL SELECT 'within', w, 1.0 * n - ka * kb FROM t)
    SELECT source, CAST(ss AS DOUBLE) AS ss, CAST(df AS DOUBLE) AS df, CASE WHEN source <> 'within' THEN ss / df / (SELECT w / (n - ka * kb) FROM t) END AS statistic FROM u""",
    rounded=("ss", "df", "statistic"), digits=3,
)
def _anova2(spark, sf):
    return H.two_way_anova(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus").drop("p_value")


@register("levene", "WITH o AS (SELECT o_orderpriority, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d FROM orders), " + _ANOVA.format(g="o_orderpriority", x="d", t="o").removeprefix("WITH ") + " SELECT ss_between / df_between / (ss_within / df_within) AS statistic, df_between, df_within FROM r", rounded=("statistic", "df_between", "df_within"), digits=4)
def _levene(spark, sf):
    return H.levene(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority").drop("p_value")


@register(
    "ks_two_sample",
    """WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1),
    f AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () AS f, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c)
    SELECT max(abs(f - g)) AS statistic, CAST(any_value(n1) AS BIGINT) AS n1, CAST(any_value(n2) AS BIGINT) AS n2 FROM f""",
    rounded=("statistic",),
)
def _ks2(spark, sf):
    return H.ks_two_sample(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "A", "N").drop("p_value")


@register(
    "ks_uniform",
    """WITH c AS (SELECT c_acctbal AS v, count(*) AS c FROM customer GROUP BY 1), f AS (SELECT (v + 1000) / 11000 AS f, c, sum(c) OVER (ORDER BY v) AS t, sum(c) OVER () AS n FROM c)
    SELECT max(greatest(t / n - f, f - (t - c) / n)) AS statistic, CAST(any_value(n) AS DOUBLE) AS n FROM f""",
    rounded=("statistic",),
)
def _ks1(spark, sf):
    return H.ks_one_sample(table(spark, sf, "customer"), "c_acctbal", lambda v: (v + 1000) / 11000).drop("p_value")


_RANKS = "r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS k, count(*) OVER (PARTITION BY v) AS t FROM d)"


@register(
    "mann_whitney",
    f"""WITH d AS (SELECT l_quantity AS v, l_returnflag = 'A' AS a FROM lineitem WHERE l_returnflag IN ('A', 'R')), {_RANKS},
    s AS (SELECT count(*) FILTER (a) * 1.0 AS n1, count(*) FILTER (NOT a) * 1.0 AS n2, sum(k) FILTER (a) AS r1, sum(t * t - 1.0) AS ties FROM r),
    u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, n1 + n2 AS n FROM s)
    SELECT CAST(u AS DOUBLE) AS statistic, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u""",
    rounded=("statistic", "z"), digits=4,
)
def _mwu(spark, sf):
    return H.mann_whitney(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "A", "R").drop("p_value")


@register(
    "wilcoxon_signed_rank",
    f"""WITH e AS (SELECT round(l_discount * 100) - round(l_tax * 100) AS x FROM lineitem), d AS (SELECT abs(x) AS v, x > 0 AS up FROM e WHERE x <> 0), {_RANKS},
    s AS (SELECT count(*) * 1.0 AS n, sum(k) FILTER (up) AS w1, sum(t * t - 1.0) AS ties FROM r)
    SELECT CAST(n AS DOUBLE) AS n, CAST(least(w1, n * (n + 1) / 2 - w1) AS DOUBLE) AS statistic,
    greatest(0, abs(least(w1, n * (n + 1) / 2 - w1) - n * (n + 1) / 4) - 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s""",
    rounded=("statistic", "z"), digits=4,
)
def _wilcoxon(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.round(F.col("l_discount") * 100).alias("x"), F.round(F.col("l_tax") * 100).alias("y"))
    return H.wilcoxon_signed_rank(rows, "x", "y").drop("p_value")


@register(
    "kruskal_wallis",
    f"""WITH d AS (SELECT l_quantity AS v, l_returnflag AS g FROM lineitem), {_RANKS}, s AS (SELECT g, sum(k) AS r, count(*) AS n, sum(t * t - 1.0) AS t FROM r GROUP BY g),
    q AS (SELECT sum(r * r / n) AS q, sum(n) * 1.0 AS n, sum(t) AS t, count(*) - 1.0 AS df FROM s)
    SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS statistic, CAST(df AS DOUBLE) AS df FROM q""",
    rounded=("statistic",), digits=4,
)
def _kruskal(spark, sf):
    return H.kruskal_wallis(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag").drop("p_value")


@register("shapiro_wilk")
def _shapiro(spark, sf):
    return H.shapiro_wilk(table(spark, sf, "events"), "value")


@register("anderson_darling")
def _anderson(spark, sf):
    return H.anderson_darling(table(spark, sf, "events"), "value")


_CELLS = "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)"


@register("chi_squared_independence", f"{_CELLS}, s AS (SELECT sum((n - na * nb / t) ** 2 / (na * nb / t)) AS x, any_value(t) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM m) SELECT CAST(n AS BIGINT) AS n, x AS statistic, (r - 1) * (k - 1) * 1.0 AS df, sqrt(x / (n * (least(r, k) - 1))) AS cramers_v FROM s", rounded=("statistic", "df", "cramers_v"), digits=5)
def _chi2(spark, sf):
    return C.chi_squared_independence(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").drop("p_value")


@register("g_test", f"{_CELLS} SELECT CAST(any_value(t) AS BIGINT) AS n, 2 * sum(n * ln(n * t / (na * nb))) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) * 1.0 AS df FROM m", rounded=("statistic", "df"), digits=5)
def _g(spark, sf):
    return C.g_test(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").drop("p_value")


@register("contingency", f"{_CELLS} SELECT a, b, n, na * nb / t AS expected, (n - na * nb / t) / sqrt(na * nb / t) AS standardized, (n - na * nb / t) / sqrt(na * nb / t * (1 - na / t) * (1 - nb / t)) AS adjusted FROM m", rounded=("expected", "standardized", "adjusted"))
def _contingency(spark, sf):
    return C.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register("chi_squared_fit", "WITH c AS (SELECT count(*) AS o, avg(count(*)) OVER () AS e FROM orders GROUP BY o_orderpriority) SELECT sum((o - e) ** 2 / e) AS statistic, count(*) - 1.0 AS df FROM c", rounded=("statistic", "df"))
def _fit(spark, sf):
    c = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("o"))
    return C.chi_squared_fit(D.beside(c, c.agg(F.avg("o").alias("e")), []), "o", "e").drop("p_value")


_QT = "WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels)"


def _labels(spark, sf):
    return C.two_by_two(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@register("mcnemar", f"{_QT} SELECT (abs(b - c) - 1) ** 2 / (b + c) AS statistic FROM t", rounded=("statistic",))
def _mcnemar(spark, sf):
    return C.mcnemar(_labels(spark, sf)).drop("p_value")


@register("odds_ratio", f"{_QT} SELECT *, a * d / (b * c) AS odds_ratio, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se_log, exp(ln(a * d / (b * c)) - 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)) AS low, exp(ln(a * d / (b * c)) + 1.959963984540054 * sqrt(1 / a + 1 / b + 1 / c + 1 / d)) AS high FROM t", rounded=("odds_ratio", "se_log", "low", "high"))
def _odds(spark, sf):
    return C.odds_ratio(_labels(spark, sf))


@register("relative_risk", f"{_QT}, r AS (SELECT *, (a / (a + b)) / (c / (c + d)) AS relative_risk, sqrt(b / (a * (a + b)) + d / (c * (c + d))) AS se_log FROM t) SELECT *, exp(ln(relative_risk) - 1.959963984540054 * se_log) AS low, exp(ln(relative_risk) + 1.959963984540054 * se_log) AS high FROM r", rounded=("relative_risk", "se_log", "low", "high"))
def _risk(spark, sf):
    return C.relative_risk(_labels(spark, sf))


@register("phi_coefficient", f"{_QT} SELECT *, (1.0 * a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)) AS phi FROM t", rounded=("phi",))
def _phi(spark, sf):
    return C.phi_coefficient(_labels(spark, sf))


@register("fisher_exact")
def _fisher(spark, sf):
    return C.fisher_exact(_labels(spark, sf))


_STRATA = "WITH t AS (SELECT o_orderpriority, count(*) FILTER (f AND h) * 1.0 AS a, count(*) FILTER (f AND NOT h) * 1.0 AS b, count(*) FILTER (NOT f AND h) * 1.0 AS c, count(*) FILTER (NOT f AND NOT h) * 1.0 AS d FROM (SELECT *, o_orderstatus = 'F' AS f, o_totalprice > 200000 AS h FROM orders) GROUP BY 1), n AS (SELECT *, a + b + c + d AS n FROM t)"


@register("mantel_haenszel", f"{_STRATA} SELECT sum(a - (a + b) * (a + c) / n) ** 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS statistic, sum(a * d / n) / sum(b * c / n) AS common_odds_ratio FROM n", rounded=("statistic", "common_odds_ratio"))
def _mh(spark, sf):
    t = C.two_by_two(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000, ["o_orderpriority"])
    return C.mantel_haenszel(t).drop("p_value")


_P = "SELECT p_partkey, (p_partkey * 7 % 1000 + 0.5) / 1000.0 AS p FROM part"


def _p_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 7 % 1000 + 0.5) / 1000.0).alias("p"))


_STEPS = {
    "bonferroni": "p * m",
    "sidak": "1 - (1 - p) ** m",
    "holm": "max(p * (m - i)) OVER (ORDER BY i)",
    "hochberg": "min(p * (m - i)) OVER (ORDER BY i DESC)",
    "benjamini_hochberg": "min(p * m / (i + 1)) OVER (ORDER BY i DESC)",
    "benjamini_yekutieli": "min(p * m * (SELECT sum(1.0 / k) FROM range(1, (SELECT count(*) + 1 FROM part)) AS h(k)) / (i + 1)) OVER (ORDER BY i DESC)",
}
for _name, _step in _STEPS.items():

    @register(f"adjust_{_name}", f"WITH r AS (SELECT p_partkey, CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS m FROM ({_P})), s AS (SELECT p_partkey, p, least(1.0, {_step}) AS adjusted FROM r) SELECT *, adjusted <= 0.5 AS rejected FROM s", rounded=("p", "adjusted"))
    def _adjust(spark, sf, method=_name):
        return multiple.adjust(_p_values(spark, sf), "p", method, 0.5)


@register("proportion_interval", "WITH s AS (SELECT l_linestatus, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS successes FROM lineitem GROUP BY 1), p AS (SELECT *, successes / n AS proportion, 1.959963984540054 AS z FROM s) SELECT l_linestatus, n, successes, proportion, (proportion + z * z / (2 * n) - z * sqrt(proportion * (1 - proportion) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS low, (proportion + z * z / (2 * n) + z * sqrt(proportion * (1 - proportion) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS high FROM p", rounded=("proportion", "low", "high"))
def _wilson(spark, sf):
    return E.proportion_interval(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", by=["l_linestatus"])


@register("mean_interval")
def _mean_interval(spark, sf):
    return E.mean_interval(table(spark, sf, "orders"), "o_totalprice", by=["o_orderpriority"])


@register("standardized_difference", f"{_TWO}, d AS (SELECT (mean1 - mean2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d, (mean1 - mean2) / sqrt(v2) AS g, n1 + n2 - 2 AS f FROM s) SELECT d AS cohens_d, d * (1 - 3 / (4 * f - 1)) AS hedges_g, g AS glass_delta, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d", rounded=("cohens_d", "hedges_g", "glass_delta"))
def _cohen(spark, sf):
    return E.standardized_difference(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "A", "R")


@register("variance_explained", _ANOVA.format(g="l_quantity", x="l_extendedprice", t="lineitem") + ", e AS (SELECT *, ss_between / (ss_between + ss_within) AS e, ss_within / df_within AS w FROM r) SELECT e AS eta_squared, e AS partial_eta_squared, greatest(0, (ss_between - df_between * w) / (ss_between + ss_within + w)) AS omega_squared, sqrt(e / (1 - e)) AS cohens_f, CASE WHEN sqrt(e / (1 - e)) < 0.1 THEN 'negligible' WHEN sqrt(e / (1 - e)) < 0.25 THEN 'small' WHEN sqrt(e / (1 - e)) < 0.4 THEN 'medium' ELSE 'large' END AS label FROM e", rounded=("eta_squared", "partial_eta_squared", "omega_squared", "cohens_f"))
def _eta(spark, sf):
    return E.variance_explained(H.one_way_anova(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"))


@register("compare_models", "WITH m AS (SELECT c_mktsegment AS name, -sum(abs(c_acctbal)) / 1e5 AS ll, length(c_mktsegment) AS k, count(*) AS n FROM customer GROUP BY 1), a AS (SELECT *, 2 * k - 2 * ll AS aic, 2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1) AS aicc, ln(n) * k - 2 * ll AS bic FROM m), d AS (SELECT *, aic - min(aic) OVER () AS delta FROM a) SELECT *, exp(-delta / 2) / sum(exp(-delta / 2)) OVER () AS weight FROM d", rounded=("ll", "aic", "aicc", "bic", "delta", "weight"))
def _models(spark, sf):
    m = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg((-F.sum(F.abs("c_acctbal")) / 1e5).alias("ll"), F.first(F.length("c_mktsegment")).cast("long").alias("k"), F.count(F.lit(1)).alias("n"))
    return E.compare_models(m, "ll", "k", "n")


@register("power_grid")
def _power(spark, sf):
    grid = spark.range(1, 51).select((F.col("id") / 50).alias("effect"), F.explode(F.sequence(F.lit(10), F.lit(500), F.lit(10))).alias("n"))
    return grid.select("effect", "n", E.two_sample_power(F.col("effect"), F.col("n").cast("double")).alias("power"))


@register("pearson", "SELECT l_returnflag, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY l_returnflag", rounded=("r",))
def _pearson(spark, sf):
    return A.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).drop("p_value")


@register("spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT count(*) AS n, corr(x, y) AS r FROM r", rounded=("r",))
def _spearman(spark, sf):
    return A.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").drop("p_value")


@register(
    "kendall",
    """WITH c AS (SELECT c_acctbal AS x, c_nationkey AS y, c_custkey AS i FROM customer), n AS (SELECT count(*) * 1.0 AS n FROM c),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) * 1.0 AS s, sum((a.x = b.x)::INT) * 1.0 AS tx, sum((a.y = b.y)::INT) * 1.0 AS ty FROM c a JOIN c b ON a.i < b.i)
    SELECT CAST(n AS BIGINT) AS n, s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau, 3 * s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) * sqrt(n * (n - 1)) / sqrt(2 * (2 * n + 5)) AS z FROM s, n""",
    rounded=("tau", "z"),
)
def _kendall(spark, sf):
    return A.kendall(table(spark, sf, "customer"), "c_acctbal", "c_nationkey").drop("p_value")


_ENTROPY = "WITH c AS (SELECT event_type AS a, user_id % 7 AS b, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), h AS (SELECT (SELECT sum(-n / t * log2(n / t)) FROM (SELECT a, sum(n) AS n FROM c GROUP BY a), t) AS h_a, (SELECT sum(-n / t * log2(n / t)) FROM (SELECT b, sum(n) AS n FROM c GROUP BY b), t) AS h_b, (SELECT sum(-n / t * log2(n / t)) FROM c, t) AS h_ab)"


@register("entropies", f"{_ENTROPY} SELECT h_a, h_b, h_ab, h_ab - h_a AS h_b_given_a, greatest(0, h_a + h_b - h_ab) AS mutual_information, 2 * greatest(0, h_a + h_b - h_ab) / (h_a + h_b) AS normalized_mi FROM h", rounded=("h_a", "h_b", "h_ab", "h_b_given_a", "mutual_information", "normalized_mi"))
def _entropies(spark, sf):
    return C.entropies(table(spark, sf, "events").withColumn("b", F.col("user_id") % 7), "event_type", "b")


@register("entropy", "WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT l_linestatus, n / sum(n) OVER (PARTITION BY l_linestatus) AS p FROM c) SELECT l_linestatus, sum(-p * log2(p)) AS entropy FROM p GROUP BY 1", rounded=("entropy",))
def _entropy(spark, sf):
    return C.entropy(table(spark, sf, "lineitem"), "l_returnflag", by=["l_linestatus"])


_PQ = "WITH p AS (SELECT c_nationkey AS k, count(*) / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1), q AS (SELECT n_nationkey AS k, (1 + n_nationkey) / (SELECT sum(1 + n_nationkey) FROM nation) AS q FROM nation), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (k))"


@register("divergences", f"{_PQ} SELECT sum(p * log2(p / q)) FILTER (p > 0) AS kl, (sum(p * log2(2 * p / (p + q))) FILTER (p > 0) + sum(q * log2(2 * q / (p + q))) FILTER (q > 0)) / 2 AS js, sum(-p * log2(q)) FILTER (p > 0) AS cross_entropy FROM j", rounded=("kl", "js", "cross_entropy"))
def _divergences(spark, sf):
    p = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    p = D.beside(p, p.agg(F.sum("n").alias("t")), []).select("key", (F.col("n") / F.col("t")).alias("p"))
    q = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") + 1).alias("n"))
    q = D.beside(q, q.agg(F.sum("n").alias("t")), []).select("key", (F.col("n") / F.col("t")).alias("p"))
    return C.divergences(p, q)
