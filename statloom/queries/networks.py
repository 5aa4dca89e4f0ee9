"""Further graph, cluster, compositional, resampling, sensitivity and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import multivariate as M
from ..operators import resampling as B
from ..operators import sensitivity as N
from ..registry import register, table

_ORDERS = "WITH d AS (SELECT o_orderkey % 1009 AS a, o_custkey % 1009 AS b FROM orders WHERE o_orderkey % 1009 <> o_custkey % 1009), e AS (SELECT a AS src, b AS dst FROM d UNION SELECT b, a FROM d), v AS (SELECT DISTINCT src AS id FROM e)"


def _orders(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_orderkey") % 1009).alias("src"), (F.col("o_custkey") % 1009).alias("dst"))


@register("graph_size", f"{_ORDERS} SELECT (SELECT count(*) FROM v) AS nodes, count(*) // 2 AS edges, count(*) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS density FROM e", rounded=("density",), digits=9)
def _size(spark, sf):
    return G.graph_size(_orders(spark, sf))


@register("clustering_coefficient", f"{_ORDERS}, t AS (SELECT count(*) AS triangles FROM e a JOIN e b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN e c ON c.src = a.src AND c.dst = b.dst), w AS (SELECT CAST(sum(k * (k - 1) / 2) AS BIGINT) AS triples FROM (SELECT count(*) AS k FROM e GROUP BY src)) SELECT triangles, triples, 3 * triangles / triples AS coefficient FROM t, w", rounded=("coefficient",), digits=9)
def _clustering(spark, sf):
    return G.clustering_coefficient(_orders(spark, sf))


_MAP = "WITH RECURSIVE d AS (SELECT c_custkey AS a, c_custkey * c_custkey % 1013 AS b FROM customer WHERE c_custkey <> c_custkey * c_custkey % 1013), e AS (SELECT a AS src, b AS dst FROM d UNION SELECT b, a FROM d), r(id, other) AS (SELECT src, src FROM e UNION SELECT r.id, e.dst FROM r JOIN e ON e.src = r.other)"


@register("connected_components", f"{_MAP} SELECT id, min(other) AS component FROM r GROUP BY id")
def _components(spark, sf):
    c = F.col("c_custkey").cast("long")
    return G.connected_components(table(spark, sf, "customer").select(c.alias("src"), (c * c % 1013).alias("dst")))


_VOTES = ", ".join(f"l{k} AS (SELECT src AS id, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, c) AS i FROM s JOIN l{k - 1} l ON l.id = s.dst GROUP BY src, c) WHERE i = 1)" for k in (1, 2, 3))


@register("label_propagation_rounds", f"{_ORDERS}, s AS (SELECT src, dst FROM e UNION SELECT id, id FROM v), l0 AS (SELECT id, id AS c FROM v), {_VOTES} SELECT id, c AS community FROM l3")
def _labels(spark, sf):
    return G.label_propagation(_orders(spark, sf), rounds=3)


_POINTS = "SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer"


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


@register(
    "dbscan",
    f"""WITH RECURSIVE p AS ({_POINTS}), n AS (SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.1 AND a.id <> b.id), k AS (SELECT id FROM p LEFT JOIN n ON i = id GROUP BY id HAVING count(j) + 1 >= 4),
    e AS (SELECT i, j FROM n WHERE i IN (SELECT id FROM k) AND j IN (SELECT id FROM k)), r(id, other) AS (SELECT id, id FROM k UNION SELECT r.id, e.j FROM r JOIN e ON e.i = r.other), c AS (SELECT id, min(other) AS c FROM r GROUP BY id),
    b AS (SELECT i AS id, min(c) AS b FROM n JOIN c ON c.id = n.j GROUP BY i) SELECT p.id, coalesce(c, b) AS cluster, c IS NOT NULL AS core FROM p LEFT JOIN c ON c.id = p.id LEFT JOIN b ON b.id = p.id""",
)
def _dbscan(spark, sf):
    return M.dbscan(_points(spark, sf), "id", "x", "y", 1.1, 4)


@register("distance_matrix", "WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 1.0 AS y FROM supplier) SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id < b.id", rounded=("d",), digits=4)
def _distances(spark, sf):
    t = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("x"))
    return M.distance_matrix(t, "id", "x", rows=40)


@register(
    "silhouettes",
    f"""WITH p AS ({_POINTS}), q AS (SELECT *, id % 4 AS l FROM p), m AS (SELECT a.id, a.l, b.l AS o, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS s, count(*) AS n FROM q a, q b GROUP BY 1, 2, 3),
    t AS (SELECT id, l, max(s / (n - 1)) FILTER (l = o AND n > 1) AS a, min(s / n) FILTER (l <> o) AS b FROM m GROUP BY 1, 2) SELECT id, l AS label, coalesce((b - a) / greatest(a, b), 0) AS silhouette FROM t""",
    rounded=("silhouette",), digits=6,
)
def _silhouettes(spark, sf):
    t = _points(spark, sf).select("id", F.array("x", "y").alias("x"), (F.col("id") % 4).alias("label"))
    return M.silhouettes(t, "id", "x", "label", rows=400)


def _parts(spark, sf):
    return table(spark, sf, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") + 0.01).alias("x"))


_LOGS = "WITH l AS (SELECT ln(l_quantity) AS a, ln(l_extendedprice / 1000) AS b, ln(l_discount + 0.01) AS c FROM lineitem)"


@register("compositional_centre", f"{_LOGS}, g AS (SELECT exp(avg(a)) AS a, exp(avg(b)) AS b, exp(avg(c)) AS c FROM l) SELECT a / (a + b + c) AS p0, b / (a + b + c) AS p1, c / (a + b + c) AS p2 FROM g", rounded=("p0", "p1", "p2"), digits=9)
def _centre(spark, sf):
    return M.compositional_centre(_parts(spark, sf), "x", 3).select(*[F.col("centre")[k].alias(f"p{k}") for k in range(3)])


@register("variation_matrix", f"{_LOGS}, v AS (SELECT var_samp(a - b) AS ab, var_samp(a - c) AS ac, var_samp(b - c) AS bc FROM l) SELECT i, j, CASE WHEN i + j = 1 THEN ab WHEN i + j = 2 THEN ac ELSE bc END AS variance FROM v, (VALUES (0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)) AS p(i, j)", rounded=("variance",), digits=6)
def _variation(spark, sf):
    return M.variation_matrix(_parts(spark, sf), "x", 3)


@register("ilr_round_trip", "SELECT l_orderkey, l_linenumber, l_quantity / s AS a, l_extendedprice / 1000 / s AS b, (l_discount + 0.01) / s AS c FROM (SELECT *, l_quantity + l_extendedprice / 1000 + l_discount + 0.01 AS s FROM lineitem)", rounded=("a", "b", "c"), digits=9)
def _ilr(spark, sf):
    t = table(spark, sf, "lineitem")
    y = V.ilr(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") + 0.01))
    t = t.select("l_orderkey", "l_linenumber", y.alias("y"))
    return t.select("l_orderkey", "l_linenumber", V.ilr_inverse("y").alias("x")).select("l_orderkey", "l_linenumber", *[F.col("x")[k].alias(n) for k, n in enumerate("abc")])


@register("bases", "SELECT p_partkey, (p_size - 1) / 49 AS p1, ((p_size - 1) / 49) ** 3 AS p3, sin(2 * pi() * (p_size - 1) / 49) AS s1, cos(4 * pi() * (p_size - 1) / 49) AS c2, 1.0 AS total FROM part", rounded=("p1", "p3", "s1", "c2", "total"), digits=9)
def _bases(spark, sf):
    p, f, b = V.polynomial_basis("p_size", 3, 1, 50), V.fourier_basis("p_size", 5, 1, 50), V.bspline_basis("p_size", 7, 1, 50.001)
    t = table(spark, sf, "part").select("p_partkey", p.alias("p"), f.alias("f"), b.alias("b"))
    return t.select("p_partkey", F.col("p")[1].alias("p1"), F.col("p")[3].alias("p3"), F.col("f")[1].alias("s1"), F.col("f")[4].alias("c2"), F.aggregate("b", F.lit(0.0), lambda a, v: a + v).alias("total"))


@register("halton", "WITH RECURSIVE h(i, base, rest, f, x) AS (SELECT i, b, i, 1.0::DOUBLE / b, 0.0::DOUBLE FROM range(6, 206) AS r(i), (VALUES (2), (3), (5)) v(b) UNION ALL SELECT i, base, rest // base, f / base, x + f * (rest % base) FROM h WHERE rest > 0) SELECT i, max(x) FILTER (base = 2) AS x1, max(x) FILTER (base = 3) AS x2, max(x) FILTER (base = 5) AS x3 FROM h GROUP BY i", rounded=("x1", "x2", "x3"), digits=9)
def _halton(spark, sf):
    return N.halton(spark, 3, 200, skip=5)


@register("latin_hypercube", "SELECT i, i AS x1, i AS x2 FROM range(500) AS r(i)")
def _hypercube(spark, sf):
    """The strata of each dimension, sorted: every one has one point."""
    x = N.latin_hypercube(spark, 2, 500, seed=3)
    one, two = (x.select(F.floor(F.col(c) * 500).alias(c)) for c in ("x1", "x2"))
    return one.join(two, one["x1"] == two["x2"]).select(F.col("x1").alias("i"), "x1", "x2")


def _ishigami(x):
    a, b, c = (2 * 3.141592653589793 * (v - 0.5) for v in x)
    return F.sin(a) + 7 * F.pow(F.sin(b), 2) + 0.1 * F.pow(c, 4) * F.sin(a)


@register("sobol_indices")
def _sobol(spark, sf):
    return N.sobol_indices(spark, _ishigami, 3, 20_000)


@register("fourier_indices")
def _fast(spark, sf):
    return N.fourier_indices(spark, _ishigami, 3)


@register("morris")
def _morris(spark, sf):
    return N.morris(spark, _ishigami, 3)


@register("correlation_screening", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS ay, corr(l_discount, l_extendedprice) AS cy, corr(l_quantity, l_discount) AS ab FROM lineitem), r AS (SELECT 'l_quantity' AS feature, ay AS pearson, (ay - cy * ab) / sqrt((1 - cy * cy) * (1 - ab * ab)) AS partial FROM c UNION ALL SELECT 'l_discount', cy, (cy - ay * ab) / sqrt((1 - ay * ay) * (1 - ab * ab)) FROM c) SELECT feature, pearson, partial, CAST(row_number() OVER (ORDER BY abs(pearson) DESC) AS INTEGER) AS place FROM r", rounded=("pearson", "partial"), digits=8)
def _screening(spark, sf):
    return N.correlation_screening(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")


@register("block_bootstrap")
def _block(spark, sf):
    """Blocks of a user's events of one day share their weights."""
    t = table(spark, sf, "events").withColumn("block", F.struct("user_id", F.to_date("ts")))
    return B.replicate_interval(B.resampled_means(t, "value", "block", "poisson", 200, 1))


@register("bayesian_bootstrap")
def _bayesian(spark, sf):
    return B.replicate_interval(B.resampled_means(table(spark, sf, "events"), "value", "event_id", "exponential", 200, 1))


@register("wild_bootstrap")
def _wild(spark, sf):
    t = table(spark, sf, "events")
    mean = t.agg(F.avg("value")).first()[0]
    return B.replicate_interval(B.resampled_means(t.withColumn("e", F.col("value") - mean), "e", "event_id", "mammen", 200, 1))


@register("sign_flip_test")
def _flip(spark, sf):
    return B.sign_flip_test(table(spark, sf, "lineitem").withColumn("key", F.struct("l_orderkey", "l_linenumber")), "l_discount", "key", 0.05, 300)


@register("bayes_factor", "WITH l AS (SELECT -l_quantity / 10 AS a, -l_discount * 20 AS b FROM lineitem), m AS (SELECT ln(count(*)) - max(-a) - ln(sum(exp(-a - (SELECT max(-a) FROM l)))) AS ma, ln(count(*)) - max(-b) - ln(sum(exp(-b - (SELECT max(-b) FROM l)))) AS mb FROM l) SELECT ma - mb AS log_factor, exp(ma - mb) AS factor FROM m", rounded=("log_factor", "factor"), digits=8)
def _factor(spark, sf):
    return B.bayes_factor(table(spark, sf, "lineitem").select((-F.col("l_quantity") / 10).alias("a"), (-F.col("l_discount") * 20).alias("b")), "a", "b")


@register("fit_beta", "WITH m AS (SELECT l_returnflag, avg((l_quantity - 0.5) / 51) AS m, var_samp((l_quantity - 0.5) / 51) AS s FROM lineitem GROUP BY 1) SELECT l_returnflag, m * (m * (1 - m) / s - 1) AS alpha, (1 - m) * (m * (1 - m) / s - 1) AS beta FROM m", rounded=("alpha", "beta"), digits=7)
def _fit_beta(spark, sf):
    return B.fit_beta(table(spark, sf, "lineitem").withColumn("x", (F.col("l_quantity") - 0.5) / 51), "x", ["l_returnflag"])


@register("goodness_of_fit", "WITH o AS (SELECT 1 - exp(-o_totalprice / 150000) AS f, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders), g AS (SELECT greatest(1e-15, least(1 - 1e-15, f)) AS f, i, n FROM o) SELECT any_value(n) AS n, -any_value(n) - sum(((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / n) AS anderson_darling, 1 / (12 * any_value(n)) + sum((f - (2 * i - 1) / (2 * n)) ** 2) AS cramer_von_mises FROM g", rounded=("anderson_darling", "cramer_von_mises"), digits=4)
def _fit(spark, sf):
    return B.goodness_of_fit(table(spark, sf, "orders"), "o_totalprice", "exponential", 1 / 150000)


@register("effective_size")
def _ess(spark, sf):
    return B.effective_size(table(spark, sf, "events"), "value", "ts", ["user_id"], 20)


@register(
    "running_moments",
    """WITH w AS (SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS mean, var_samp(value) OVER w AS variance, skewness(value) OVER w AS skewness, kurtosis(value) OVER w AS kurtosis FROM (SELECT * REPLACE (sqrt(value) AS value) FROM events) AS events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, n, mean, variance, CASE WHEN n > 2 AND variance > 0 THEN skewness END AS skewness, CASE WHEN n > 3 AND variance > 0 THEN kurtosis END AS kurtosis FROM w""",
    rounded=("mean", "variance", "skewness", "kurtosis"), digits=5,
)
def _moments(spark, sf):
    t = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id")).withColumn("value", F.sqrt("value"))
    return streaming.running_moments(t, "value", "o", ["user_id"]).select("event_id", "n", "mean", "variance", "skewness", "kurtosis")


@register("running_covariances", "SELECT event_id, avg(x) OVER w AS mean_x, covar_samp(x, y) OVER w AS cov, var_samp(x) OVER w AS var FROM (SELECT event_id, user_id, sqrt(value) AS x, sin(event_id) AS y FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", rounded=("mean_x", "cov", "var"), digits=7)
def _covariances(spark, sf):
    t = table(spark, sf, "events").withColumns({"x": F.sqrt("value"), "y": F.sin("event_id")})
    out = streaming.running_covariances(t, ["x", "y"], "event_id", ["user_id"])
    return out.select("event_id", "mean_x", F.col("cov_x_y").alias("cov"), F.col("cov_x_x").alias("var"))


@register("running_quantile", "SELECT event_id, list_sort(list(value) OVER w)[CAST(ceil(count(*) OVER w / 2) AS BIGINT)] AS quantile FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _running_quantile(spark, sf):
    return streaming.running_quantile(table(spark, sf, "events"), "value", "event_id", ["user_id"], 0.5, 100_000).select("event_id", "quantile")
