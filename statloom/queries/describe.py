"""Frame operations and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptive as D
from ..operators import frame
from ..registry import register, table


@register("frame_group_by", "SELECT o_orderpriority, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority", rounded=("total", "mean"), digits=3)
def _group_by(spark, sf):
    aggs = {"total": ("o_totalprice", "sum"), "mean": ("o_totalprice", "mean"), "n": ("o_totalprice", "count"), "low": ("o_totalprice", "min"), "high": ("o_totalprice", "max")}
    return frame.group_by(table(spark, sf, "orders"), ["o_orderpriority"], aggs)


@register(
    "frame_join_null_keys",
    """WITH l AS (SELECT CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_nationkey END AS key, count(*) AS n FROM customer GROUP BY 1),
    r AS (SELECT CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE s_nationkey END AS key, count(*) AS n FROM supplier GROUP BY 1)
    SELECT coalesce(l.key, r.key) AS key, l.n, r.n AS n_right FROM l FULL JOIN r ON l.key IS NOT DISTINCT FROM r.key""",
)
def _join(spark, sf):
    def counts(name, key, k):
        keyed = table(spark, sf, name).select(F.when(F.col(key) % k != 0, F.col(key)).alias("key"))
        return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    return frame.join(counts("customer", "c_nationkey", 5), counts("supplier", "s_nationkey", 7), ["key"], "outer")


@register("frame_sort_slice", "SELECT row_idx, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS row_idx FROM customer) WHERE row_idx >= 10 AND row_idx < 30")
def _slice(spark, sf):
    rows = frame.indexed(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal").desc_nulls_last(), "c_custkey")
    return frame.slice_rows(rows, 10, 30).select("row_idx", "c_custkey")


@register(
    "describe_prices",
    """SELECT l_returnflag, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, median(l_extendedprice) AS median, var_samp(l_extendedprice) AS variance,
    stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS min, max(l_extendedprice) AS max, skewness(l_extendedprice) AS skewness, kurtosis(l_extendedprice) AS kurtosis
    FROM lineitem GROUP BY l_returnflag""",
    rounded=("mean", "median", "variance", "sd", "skewness", "kurtosis"), digits=3,
)
def _describe(spark, sf):
    return D.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


@register("percentiles", "SELECT o_orderstatus, quantile_cont(o_totalprice, 0.05) AS p5, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.95) AS p95 FROM orders GROUP BY o_orderstatus", rounded=("p5", "p50", "p95"), digits=4)
def _percentiles(spark, sf):
    return D.percentiles(table(spark, sf, "orders"), "o_totalprice", [5, 50, 95], ["o_orderstatus"])


@register("mad", "WITH m AS (SELECT c_mktsegment, c_acctbal, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer) SELECT c_mktsegment, any_value(m) AS median, 1.4826 * median(abs(c_acctbal - m)) AS mad FROM m GROUP BY c_mktsegment", rounded=("median", "mad"))
def _mad(spark, sf):
    return D.mad(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


_RANKED = "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders), k AS (SELECT *, floor(n * 0.1) AS k FROM r)"


@register("trimmed_mean", f"{_RANKED} SELECT avg(v) AS trimmed_mean FROM k WHERE i > k AND i <= n - k", rounded=("trimmed_mean",), digits=4)
def _trimmed(spark, sf):
    return D.trimmed_mean(table(spark, sf, "orders"), "o_totalprice")


@register("winsorized_mean", f"{_RANKED}, e AS (SELECT min(v) FILTER (i > k) AS lo, max(v) FILTER (i <= n - k) AS hi FROM k) SELECT avg(least(greatest(v, lo), hi)) AS winsorized_mean FROM k, e", rounded=("winsorized_mean",), digits=4)
def _winsorized(spark, sf):
    return D.winsorized_mean(table(spark, sf, "orders"), "o_totalprice")


_HINGES = """WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
h AS (SELECT c_mktsegment, median(v) FILTER (i <= n // 2) AS lower, median(v) FILTER (i > n - n // 2) AS upper FROM r GROUP BY c_mktsegment)"""


@register("hinges", f"{_HINGES} SELECT *, upper - lower AS iqr FROM h", rounded=("lower", "upper", "iqr"))
def _hinges(spark, sf):
    return D.hinges(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


@register("outliers", f"{_HINGES} SELECT c_custkey FROM r JOIN h USING (c_mktsegment) WHERE v < lower - 0.4 * (upper - lower) OR v > upper + 0.4 * (upper - lower)")
def _outliers(spark, sf):
    return D.outliers(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"], 0.4).select("c_custkey")


@register(
    "biweight_midvariance",
    """WITH m AS (SELECT c_mktsegment AS g, c_acctbal AS v, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer),
    d AS (SELECT g, v - m AS d, median(abs(v - m)) OVER (PARTITION BY g) AS mad FROM m), u AS (SELECT g, d, (d / (9 * mad)) ** 2 AS u FROM d)
    SELECT g AS c_mktsegment, count(*) * sum(d * d * (1 - u) ** 4) FILTER (u < 1) / (sum((1 - u) * (1 - 5 * u)) FILTER (u < 1)) ** 2 AS biweight_midvariance FROM u GROUP BY g""",
    rounded=("biweight_midvariance",), digits=3,
)
def _biweight(spark, sf):
    return D.biweight_midvariance(table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


@register(
    "weighted_stats",
    """WITH m AS (SELECT l_returnflag, l_discount AS v, l_quantity AS w, sum(l_quantity * l_discount) OVER (PARTITION BY l_returnflag) / sum(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem),
    s AS (SELECT l_returnflag, any_value(m) AS mean, sum(w * (v - m) ** 2) / (sum(w) - sum(w * w) / sum(w)) AS variance, sum(w) ** 2 / sum(w * w) AS effective_n FROM m GROUP BY l_returnflag)
    SELECT l_returnflag, mean, variance, sqrt(variance) AS sd, effective_n FROM s""",
    rounded=("mean", "variance", "sd", "effective_n"),
)
def _weighted(spark, sf):
    return D.weighted_stats(table(spark, sf, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])


@register("weighted_quantile", "WITH c AS (SELECT l_extendedprice AS v, sum(l_quantity) OVER (ORDER BY l_extendedprice) AS c, sum(l_quantity) OVER () AS w FROM lineitem) SELECT min(v) AS quantile FROM c WHERE c >= 0.75 * w")
def _weighted_quantile(spark, sf):
    return D.weighted_quantile(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", 0.75)


@register(
    "horvitz_thompson",
    """WITH s AS (SELECT o_orderstatus, o_totalprice AS y, 0.1 + (o_orderkey % 9) / 10.0 AS p FROM orders)
    SELECT o_orderstatus, sum(y / p) AS total, sum(y / p) / 100000 AS mean, sqrt(sum((1 - p) / (p * p) * y * y)) AS se_total, sqrt(sum((1 - p) / (p * p) * y * y)) / 100000 AS se_mean FROM s GROUP BY o_orderstatus""",
    rounded=("total", "mean", "se_total", "se_mean"), digits=2,
)
def _horvitz(spark, sf):
    rows = table(spark, sf, "orders").withColumn("p", 0.1 + (F.col("o_orderkey") % 9) / 10.0)
    return D.horvitz_thompson(rows, "o_totalprice", "p", 100000, ["o_orderstatus"])


@register("design_effect", "SELECT count(*) * sum(l_quantity ** 2) / sum(l_quantity) ** 2 AS deff, sum(l_quantity) ** 2 / sum(l_quantity ** 2) AS effective_n FROM lineitem", rounded=("deff", "effective_n"), digits=4)
def _design(spark, sf):
    return D.design_effect(table(spark, sf, "lineitem"), "l_quantity")


@register(
    "ratio_estimate",
    """WITH r AS (SELECT l_extendedprice AS y, l_quantity AS x, 1 + l_tax AS w FROM lineitem), s AS (SELECT sum(w * y) / sum(w * x) AS r, sum(w * x) AS wx, count(*) AS n FROM r)
    SELECT any_value(s.r) AS ratio, any_value(s.r) * 1000 AS total, any_value(n) / (any_value(n) - 1) * sum((w * (y - s.r * x)) ** 2) / any_value(wx) ** 2 AS variance FROM r, s""",
    rounded=("ratio", "total", "variance"), digits=4,
)
def _ratio(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("w", 1 + F.col("l_tax"))
    return D.ratio_estimate(rows, "l_extendedprice", "l_quantity", "w", 1000)


@register("post_stratify", "SELECT c_custkey, 1.0 * 5000 / count(*) OVER (PARTITION BY c_mktsegment) AS post_weight FROM customer", rounded=("post_weight",))
def _post(spark, sf):
    rows = table(spark, sf, "customer").withColumn("w", F.lit(1.0))
    population = rows.select(F.col("c_mktsegment").alias("stratum")).distinct().withColumn("population", F.lit(5000))
    return D.post_stratify(rows, "w", "c_mktsegment", population).select("c_custkey", "post_weight")


_GAPS = "SELECT *, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events"


def _gaps(spark, sf):
    return table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 4 != 0, F.col("value")))


@register("missing_summary", f"SELECT event_type, count(*) AS rows, 'v' AS \"column\", count(*) - count(v) AS missing, (count(*) - count(v)) / count(*) AS proportion FROM ({_GAPS}) GROUP BY event_type", rounded=("proportion",))
def _missing(spark, sf):
    return D.missing_summary(_gaps(spark, sf), ["v"], ["event_type"])


@register("fill_mean", f"SELECT event_id, coalesce(v, avg(v) OVER (PARTITION BY event_type)) AS v FROM ({_GAPS})", rounded=("v",), digits=9)
def _fill_mean(spark, sf):
    return D.fill_with(_gaps(spark, sf), "v", "mean", ["event_type"]).select("event_id", "v")


@register("fill_median", f"SELECT event_id, coalesce(v, median(v) OVER (PARTITION BY event_type)) AS v FROM ({_GAPS})", rounded=("v",), digits=9)
def _fill_median(spark, sf):
    return D.fill_with(_gaps(spark, sf), "v", "median", ["event_type"]).select("event_id", "v")


@register("listwise_deletion", f"SELECT event_id, v FROM ({_GAPS}) WHERE v IS NOT NULL")
def _listwise(spark, sf):
    return D.complete_rows(_gaps(spark, sf), ["v", "value"]).select("event_id", "v")


@register(
    "forward_fill",
    f"""SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING),
    first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM ({_GAPS})""",
)
def _forward(spark, sf):
    return D.forward_fill(_gaps(spark, sf), "v", "ts", ["user_id"]).select("event_id", "v")


@register(
    "interpolate",
    f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM ({_GAPS})),
    w AS (SELECT event_id, i, v, CASE WHEN v IS NOT NULL THEN i END AS k, user_id, ts FROM i),
    a AS (SELECT event_id, i, v, last_value(v IGNORE NULLS) OVER b AS av, last_value(k IGNORE NULLS) OVER b AS ak, first_value(v IGNORE NULLS) OVER f AS bv, first_value(k IGNORE NULLS) OVER f AS bk FROM w
      WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, coalesce(v, av + (bv - av) * (i - ak) / (bk - ak), bv, av) AS v FROM a""",
    rounded=("v",), digits=9,
)
def _interpolate(spark, sf):
    return D.interpolate(_gaps(spark, sf), "v", "ts", ["user_id"]).select("event_id", "v")


@register(
    "histogram",
    """WITH s AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 12 AS w, count(*) AS n FROM customer),
    b AS (SELECT least(floor((c_acctbal - lo) / w), 11) AS bin, count(*) AS c FROM customer, s GROUP BY 1)
    SELECT CAST(g.bin AS BIGINT) AS bin, lo + g.bin * w AS low, lo + (g.bin + 1) * w AS high, coalesce(c, 0) AS n, coalesce(c, 0) / (s.n * w) AS density FROM range(12) AS g(bin), s LEFT JOIN b ON b.bin = g.bin""",
    rounded=("low", "high", "density"),
)
def _histogram(spark, sf):
    return D.histogram(table(spark, sf, "customer"), "c_acctbal", 12)


@register(
    "box_plot",
    """WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
    r AS (SELECT q.*, o_totalprice AS v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM orders JOIN q ON o_orderpriority = g)
    SELECT g AS o_orderpriority, any_value(q1) AS q1, any_value(m) AS median, any_value(q3) AS q3, min(v) FILTER (v >= lo) AS whisker_low, max(v) FILTER (v <= hi) AS whisker_high,
    count(*) FILTER (v < lo) AS n_low, count(*) FILTER (v > hi) AS n_high FROM r GROUP BY g""",
    rounded=("q1", "median", "q3", "whisker_low", "whisker_high"), digits=4,
)
def _box(spark, sf):
    return D.box_plot(table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"])


@register("ecdf", "SELECT l_quantity AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY l_quantity", rounded=("p",))
def _ecdf(spark, sf):
    return D.ecdf(table(spark, sf, "lineitem"), "l_quantity")


@register(
    "density",
    """WITH s AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 49 AS step, count(*) AS n FROM lineitem), c AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1),
    g AS (SELECT lo + i * step AS x, n FROM range(50) AS r(i), s)
    SELECT x, sum(c * exp(-0.5 * ((x - v) / 2.0) ** 2)) / (any_value(n) * 2.0 * sqrt(2 * pi())) AS density FROM g, c GROUP BY x""",
    rounded=("x", "density"),
)
def _density(spark, sf):
    return D.density(table(spark, sf, "lineitem"), "l_quantity", 50, 2.0)


@register("huber_mean")
def _huber(spark, sf):
    return D.huber_mean(table(spark, sf, "orders"), "o_totalprice")
