"""Series, vectors, graphs, space, streams and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import multivariate as M
from ..operators import resampling as B
from ..operators import series as S
from ..registry import register, table

_USER = "PARTITION BY user_id ORDER BY ts"


#: Roots of the values have no exact ties at the digit that is rounded.
_ROOTS = "(SELECT * REPLACE (sqrt(value) AS value) FROM events) AS events"


def _roots(spark, sf):
    return table(spark, sf, "events").withColumn("value", F.sqrt("value"))


def _events(spark, sf):
    return table(spark, sf, "events")


@register("moving_average", f"SELECT event_id, average FROM (SELECT event_id, avg(value) OVER ({_USER} ROWS 4 PRECEDING) AS average, row_number() OVER ({_USER}) AS i FROM events) WHERE i >= 5", rounded=("average",), digits=9)
def _sma(spark, sf):
    return S.moving_average(_events(spark, sf), "value", "ts", ["user_id"], 5).select("event_id", "average")


@register("weighted_moving_average", f"SELECT event_id, average FROM (SELECT event_id, (3 * value + 2 * lag(value) OVER w + lag(value, 2) OVER w) / 6 AS average, row_number() OVER w AS i FROM events WINDOW w AS ({_USER})) WHERE i >= 3", rounded=("average",), digits=9)
def _wma(spark, sf):
    return S.moving_average(_events(spark, sf), "value", "ts", ["user_id"], 3, weighted=True).select("event_id", "average")


@register("second_difference", f"SELECT event_id, d AS difference FROM (SELECT event_id, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d FROM events WINDOW w AS ({_USER})) WHERE d IS NOT NULL", rounded=("difference",), digits=9)
def _difference(spark, sf):
    return S.difference(_events(spark, sf), "value", "ts", ["user_id"], 2).select("event_id", "difference")


@register(
    "autocorrelation",
    """WITH d AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    v AS (SELECT user_id, any_value(n) AS n, sum(d * d) AS v FROM d GROUP BY user_id),
    c AS (SELECT a.user_id, k.lag, sum(a.d * b.d) AS c FROM d a, range(6) AS k(lag), d b WHERE a.user_id = b.user_id AND b.i = a.i - k.lag GROUP BY 1, 2)
    SELECT v.user_id, CAST(k.lag AS INTEGER) AS lag, n, coalesce(c, 0) / n AS autocovariance, CASE WHEN v > 0 THEN coalesce(c, 0) / v END AS autocorrelation, 1.96 / sqrt(n) AS bound FROM v CROSS JOIN range(6) AS k(lag) LEFT JOIN c ON c.user_id = v.user_id AND c.lag = k.lag""",
    rounded=("autocovariance", "autocorrelation", "bound"),
)
def _acf(spark, sf):
    return S.autocorrelation(_events(spark, sf), "value", "ts", ["user_id"], 5)


@register("partial_autocorrelation")
def _pacf(spark, sf):
    return S.partial_autocorrelation(S.autocorrelation(_events(spark, sf), "value", "ts", ["user_id"], 5), ["user_id"])


@register("exponential_average", f"WITH RECURSIVE i AS (SELECT user_id, ts, value, row_number() OVER ({_USER}) AS i FROM events), e AS (SELECT user_id, ts, i, value AS s FROM i WHERE i = 1 UNION ALL SELECT i.user_id, i.ts, i.i, 0.3 * i.value + 0.7 * e.s FROM e JOIN i ON i.user_id = e.user_id AND i.i = e.i + 1) SELECT user_id, ts AS t, s AS average FROM e", rounded=("average",), digits=9)
def _ema(spark, sf):
    return S.exponential_average(_events(spark, sf), "value", "ts", ["user_id"], 0.3).select("user_id", "t", "average")


@register(
    "seasonal_decompose",
    f"""WITH i AS (SELECT event_id, user_id, value AS v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
      (sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) - (lag(value, 2) OVER w + lead(value, 2) OVER w) / 2) / 4 AS m FROM {_ROOTS} WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    t AS (SELECT *, i % 4 AS k, CASE WHEN i >= 2 AND i < n - 2 THEN m END AS trend FROM i),
    s AS (SELECT user_id, k, coalesce(avg(v - trend), 0) AS s FROM t GROUP BY 1, 2), c AS (SELECT user_id, k, s - avg(s) OVER (PARTITION BY user_id) AS seasonal FROM s)
    SELECT event_id, trend, seasonal, v - trend - seasonal AS residual FROM t JOIN c USING (user_id, k)""",
    rounded=("trend", "seasonal", "residual"),
)
def _decompose(spark, sf):
    return S.seasonal_decompose(_roots(spark, sf), "value", "ts", ["user_id"], 4).select("event_id", "trend", "seasonal", "residual")


@register("cusum", f"WITH s AS (SELECT user_id, avg(value) AS m, stddev_samp(value) AS s, count(*) AS n FROM events GROUP BY 1), c AS (SELECT user_id, abs(sum(value - m) OVER ({_USER})) / (s * sqrt(n)) AS c FROM events JOIN s USING (user_id)) SELECT user_id, max(c) AS statistic FROM c GROUP BY 1", rounded=("statistic",))
def _cusum(spark, sf):
    return S.cusum(_events(spark, sf), "value", "ts", ["user_id"]).select("user_id", "statistic")


_IN_ORDER = f"WITH RECURSIVE e AS (SELECT user_id, ts, value AS y, row_number() OVER ({_USER}) AS i, lead(value) OVER ({_USER}) AS next FROM events)"


@register(
    "holt_linear",
    f"""{_IN_ORDER}, h AS (SELECT user_id, ts AS t, i, y AS x, y AS level, coalesce(next - y, 0.0) AS trend, y AS fitted FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.ts, e.i, e.y, 0.5 * e.y + 0.5 * (level + trend), 0.1 * (0.5 * e.y + 0.5 * (level + trend) - level) + 0.9 * trend, level + trend FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
    SELECT user_id, t, x, level, trend, fitted FROM h""",
    rounded=("level", "trend", "fitted"), digits=8,
)
def _holt(spark, sf):
    return S.holt(_events(spark, sf), "value", "ts", ["user_id"], 0.5, 0.1)


@register(
    "kalman_local_level",
    f"""{_IN_ORDER}, k AS (SELECT user_id, 0 AS i, NULL::TIMESTAMP AS t, NULL::DOUBLE AS x, 0.0::DOUBLE AS state, 1e7::DOUBLE AS variance FROM e WHERE i = 1
      UNION ALL SELECT e.user_id, e.i, e.ts, e.y, state + (variance + 0.1) / (variance + 0.6) * (e.y - state), (1 - (variance + 0.1) / (variance + 0.6)) * (variance + 0.1) FROM k JOIN e ON e.user_id = k.user_id AND e.i = k.i + 1)
    SELECT user_id, t, x, state, variance FROM k WHERE i > 0""",
    rounded=("state", "variance"), digits=5,
)
def _kalman(spark, sf):
    return S.local_level(_events(spark, sf), "value", "ts", ["user_id"], 0.1, 0.5)


@register("mean_changepoints")
def _pelt(spark, sf):
    return S.mean_changepoints(_events(spark, sf), "value", "ts", ["user_id"])


@register("granger")
def _granger(spark, sf):
    rows = _events(spark, sf).withColumn("k", F.length("event_type"))
    return S.granger(rows, "k", "value", "ts", ["user_id"], 2)


@register(
    "unit_root",
    f"""WITH l AS (SELECT *, value - lag(value) OVER ({_USER}) AS d, lag(value) OVER ({_USER}) AS x FROM events), r AS (SELECT d AS y, x, lag(d) OVER ({_USER}) AS z FROM l), c AS (SELECT count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(y, y) AS yy FROM r WHERE z IS NOT NULL),
    b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS g FROM c), t AS (SELECT n, b / sqrt((yy - b * xy - g * zy) * n / (n - 3) * zz / (det * n)) AS statistic FROM b)
    SELECT statistic, 1::BIGINT AS lags, n, statistic < -2.86 AS stationary FROM t""",
    rounded=("statistic",), digits=6,
)
def _adf(spark, sf):
    return S.unit_root(_events(spark, sf), "value", "ts", ["user_id"])


@register("running_stats", f"SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS mean, var_samp(value) OVER w AS variance, min(value) OVER w AS min, max(value) OVER w AS max FROM {_ROOTS} WINDOW w AS ({_USER})", rounded=("mean", "variance"))
def _running(spark, sf):
    return streaming.running_stats(_roots(spark, sf), "value", "ts", ["user_id"]).select("event_id", "n", "mean", "variance", "min", "max")


@register("sliding_stats", f"SELECT event_id, count(value) OVER w AS n, avg(value) OVER w AS mean, var_samp(value) OVER w AS variance, min(value) OVER w AS min, max(value) OVER w AS max FROM {_ROOTS} WINDOW w AS ({_USER} ROWS 9 PRECEDING)", rounded=("mean", "variance"))
def _sliding(spark, sf):
    return streaming.sliding_stats(_roots(spark, sf), "value", "ts", ["user_id"], 10).select("event_id", "n", "mean", "variance", "min", "max")


@register("batch_stats", f"SELECT user_id, b AS batch, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance, min(value) AS min, max(value) AS max FROM (SELECT user_id, value, (row_number() OVER ({_USER}) - 1) // 10 AS b FROM {_ROOTS}) GROUP BY 1, 2", rounded=("mean", "variance"))
def _batch(spark, sf):
    return streaming.batch_stats(_roots(spark, sf), "value", "ts", ["user_id"], 10)


@register("running_correlation", f"SELECT event_id, covar_samp(value, event_id) OVER w AS covariance FROM {_ROOTS} WINDOW w AS ({_USER})", rounded=("covariance",))
def _running_corr(spark, sf):
    return streaming.running_correlation(_roots(spark, sf), "value", "event_id", "ts", ["user_id"]).select("event_id", "covariance")


@register("event_time_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance, min(value) AS min, max(value) AS max FROM events GROUP BY ALL", rounded=("mean", "variance"), digits=9)
def _windows(spark, sf):
    return streaming.stream_window_stats(_events(spark, sf), "value", "ts", ["event_type"], "1 day")


@register("principal_components")
def _pca(spark, sf):
    rows, names = M.unpack(table(spark, sf, "embeddings"), "embedding", 64)
    found = M.principal_components(rows, names, 8)
    return spark.createDataFrame([(k + 1, float(v), float(e)) for k, (v, e) in enumerate(zip(found.variance, found.explained, strict=True))], "component int, variance double, explained double")


@register("mahalanobis", "WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_quantity, l_extendedprice) AS c, avg(l_quantity) AS ma, avg(l_extendedprice) AS mb FROM lineitem) SELECT sum(sqrt(((l_quantity - ma) ** 2 * b - 2 * (l_quantity - ma) * (l_extendedprice - mb) * c + (l_extendedprice - mb) ** 2 * a) / (a * b - c * c))) AS total FROM lineitem, c", rounded=("total",), digits=3)
def _mahalanobis(spark, sf):
    return M.mahalanobis(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]).agg(F.sum("mahalanobis").alias("total"))


@register("k_means")
def _k_means(spark, sf):
    docs = table(spark, sf, "embeddings")
    centres, _, _ = M.k_means(docs, "embedding", 8, rounds=10)
    return M.assign(docs, "embedding", centres).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_CENTRES = "l AS (SELECT vec_id, label AS k, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM embeddings), c AS (SELECT k, j, avg(v) AS m FROM l GROUP BY 1, 2), n AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY 1)"


@register(
    "davies_bouldin",
    f"""WITH {_CENTRES}, d AS (SELECT vec_id, k, sqrt(sum((v - m) ** 2)) AS d FROM l JOIN c USING (k, j) GROUP BY 1, 2), s AS (SELECT k, avg(d) AS s FROM d GROUP BY 1),
    p AS (SELECT a.k AS a, b.k AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c AS a JOIN c AS b ON a.j = b.j AND a.k <> b.k GROUP BY 1, 2)
    SELECT avg(r) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / d) AS r FROM p JOIN s AS x ON x.k = a JOIN s AS y ON y.k = b GROUP BY a)""",
    rounded=("davies_bouldin",), digits=6,
)
def _db(spark, sf):
    return M.davies_bouldin(table(spark, sf, "embeddings"), "embedding", "label")


@register(
    "centroid_silhouette",
    f"""WITH {_CENTRES}, d AS (SELECT l.vec_id, l.k, c.k AS o, sum((v - m) ** 2) AS d FROM l JOIN c USING (j) GROUP BY 1, 2, 3), w AS (SELECT k, avg(d) AS w FROM d WHERE k = o GROUP BY 1), f AS (SELECT vec_id, d.k, o, d + w AS f FROM d JOIN w ON w.k = o),
    ab AS (SELECT vec_id, f.k, max(CASE WHEN o = f.k THEN f * n / (n - 1) END) AS a, min(CASE WHEN o <> f.k THEN f END) AS b, any_value(n) AS n FROM f JOIN n ON n.k = f.k GROUP BY 1, 2)
    SELECT avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab""",
    rounded=("silhouette",), digits=6,
)
def _silhouette(spark, sf):
    return M.centroid_silhouette(table(spark, sf, "embeddings"), "embedding", "label")


@register("gaussian_mixture")
def _gmm(spark, sf):
    return M.gaussian_mixture(_events(spark, sf), "value", 2, rounds=20)


@register(
    "adjusted_rand",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS t, sum(n) AS n FROM c),
    u AS (SELECT sum(n * (n - 1) / 2) AS u FROM (SELECT sum(n) AS n FROM c GROUP BY a)), v AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT (t - u * v / (n * (n - 1) / 2)) / ((u + v) / 2 - u * v / (n * (n - 1) / 2)) AS adjusted_rand FROM t, u, v""",
    rounded=("adjusted_rand",),
)
def _ari(spark, sf):
    return M.adjusted_rand(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@register(
    "vector_distances",
    """WITH e AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, list_distance(x, y) AS euclidean, list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS manhattan, list_max(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))) AS chebyshev,
    list_cosine_similarity(x, y) AS cosine, list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]) ** 3)) ** (1.0 / 3) AS minkowski FROM e""",
    rounded=("euclidean", "manhattan", "chebyshev", "cosine", "minkowski"),
)
def _distances(spark, sf):
    e = table(spark, sf, "embeddings")
    both = e.select("vec_id", F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return both.select("vec_id", V.euclidean("x", "y").alias("euclidean"), V.manhattan("x", "y").alias("manhattan"), V.chebyshev("x", "y").alias("chebyshev"), V.cosine_similarity("x", "y").alias("cosine"), V.minkowski("x", "y", 3).alias("minkowski"))


_PARTS = "SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice, CAST(p_partkey AS DOUBLE) + 1] AS x FROM part"


@register(
    "log_ratios",
    f"""WITH l AS (SELECT p_partkey, list_transform(x, lambda v: ln(v)) AS l, list_sum(x) AS s, x FROM ({_PARTS})), c AS (SELECT *, list_transform(l, lambda v: v - list_avg(l)) AS c FROM l)
    SELECT p_partkey, c[1] AS clr1, c[2] AS clr2, l[1] - l[3] AS alr1, sqrt(2 / 3) * (l[1] - (l[2] + l[3]) / 2) AS ilr1, sqrt(1 / 2) * (l[2] - l[3]) AS ilr2, x[1] / s AS closed1, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS norm FROM c""",
    rounded=("clr1", "clr2", "alr1", "ilr1", "ilr2", "closed1", "norm"),
)
def _ratios(spark, sf):
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_partkey").cast("double") + 1)
    rows = table(spark, sf, "part").select("p_partkey", x.alias("x"))
    c, a, i = V.clr("x"), V.alr("x"), V.ilr("x")
    return rows.select("p_partkey", c[0].alias("clr1"), c[1].alias("clr2"), a[0].alias("alr1"), i[0].alias("ilr1"), i[1].alias("ilr2"), V.closure("x")[0].alias("closed1"), V.aitchison_norm("x").alias("norm"))


_EDGES = "WITH e0 AS (SELECT c_custkey AS src, CAST(c_nationkey AS BIGINT) AS dst FROM customer WHERE c_custkey <> c_nationkey), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), v AS (SELECT DISTINCT src AS id FROM e)"


def _edges(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


@register("degree_centrality", f"{_EDGES} SELECT id, count(*) AS degree, count(*) / ((SELECT count(*) FROM v) - 1) AS centrality FROM v JOIN e ON src = id GROUP BY id", rounded=("centrality",))
def _degree(spark, sf):
    return G.degree_centrality(_edges(spark, sf))


_RANK = ", ".join(f"r{k} AS (SELECT v.id, 0.15 / (SELECT count(*) FROM v) + 0.85 * sum(r.rank / o.k) AS rank FROM v JOIN e ON e.dst = v.id JOIN o ON o.src = e.src JOIN r{k - 1} r ON r.id = e.src GROUP BY v.id)" for k in (1, 2, 3))


@register("page_rank_rounds", f"{_EDGES}, o AS (SELECT src, count(*) AS k FROM e GROUP BY src), r0 AS (SELECT id, 1 / (SELECT count(*) FROM v) AS rank FROM v), {_RANK} SELECT id, rank FROM r3", rounded=("rank",), digits=9)
def _page_rank(spark, sf):
    return G.page_rank(_edges(spark, sf), directed=False, rounds=3)


@register("modularity", f"{_EDGES}, m AS (SELECT count(*) AS m FROM e), b AS (SELECT src % 5 AS a, dst % 5 AS b FROM e), s AS (SELECT a, count(*) AS d, count(*) FILTER (a = b) AS i FROM b GROUP BY a) SELECT sum(i / m - (d / m) ** 2) AS modularity FROM s, m", rounded=("modularity",))
def _modularity(spark, sf):
    e = _edges(spark, sf)
    return G.modularity(e, G.vertices(e).withColumn("community", F.col("id") % 5))


@register("closeness")
def _closeness(spark, sf):
    return G.closeness(G.distances_from(_edges(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))))


_POINTS = "WITH p AS (SELECT c_custkey AS id, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y, c_acctbal % 7 AS v FROM customer), w AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.5)"


def _points(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_acctbal") % 7).alias("v"))


@register("band_weights", f"{_POINTS} SELECT i, count(*) AS n, sum(d) AS total FROM w GROUP BY i", rounded=("total",))
def _band(spark, sf):
    return G.band_sums(_points(spark, sf), "id", "x", "y", 1.5)


@register(
    "moran",
    f"""{_POINTS}, m AS (SELECT count(*) * 1.0 AS n, avg(v) AS m, var_pop(v) * count(*) AS m2 FROM p), c AS (SELECT sum((a.v - m) * (b.v - m)) AS c, count(*) * 1.0 AS s0 FROM w JOIN p a ON a.id = i JOIN p b ON b.id = j, m),
    k AS (SELECT i, count(*) AS k FROM w GROUP BY i), s AS (SELECT sum((2.0 * k) ** 2) AS s2 FROM k)
    SELECT n / s0 * c / m2 AS i, -1 / (n - 1) AS expected, (n * n * 2 * s0 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1 / (n - 1) ** 2 AS variance FROM m, c, s""",
    rounded=("i", "expected", "variance"), digits=8,
)
def _moran(spark, sf):
    return G.band_moran(_points(spark, sf), "id", "x", "y", "v", 1.5).select("i", "expected", "variance")


@register("geary", f"{_POINTS}, m AS (SELECT count(*) * 1.0 AS n, var_pop(v) * count(*) AS m2 FROM p) SELECT any_value(n - 1) * sum((a.v - b.v) ** 2) / (2 * count(*) * any_value(m2)) AS c FROM w JOIN p a ON a.id = i JOIN p b ON b.id = j, m", rounded=("c",))
def _geary(spark, sf):
    return G.band_geary(_points(spark, sf), "id", "x", "y", "v", 1.5)


@register("variogram", f"{_POINTS} SELECT CAST(floor(d / 0.25) AS BIGINT) AS bin, count(*) AS n, avg(d) AS distance, avg((a.v - b.v) ** 2) / 2 AS gamma FROM w JOIN p a ON a.id = i JOIN p b ON b.id = j WHERE i < j GROUP BY 1", rounded=("distance", "gamma"))
def _variogram(spark, sf):
    return G.band_variogram(_points(spark, sf), "id", "x", "y", "v", 1.5, 0.25)


@register("prediction_scores", "WITH r AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 2100 AS p FROM lineitem) SELECT l_returnflag, avg((a - p) ** 2) AS mse, sqrt(avg((a - p) ** 2)) AS rmse, avg(abs(a - p)) AS mae, 1 - sum((a - p) ** 2) / (var_pop(a) * count(*)) AS r2 FROM r GROUP BY 1", rounded=("mse", "rmse", "mae", "r2"), digits=2)
def _scores(spark, sf):
    return B.prediction_scores(table(spark, sf, "lineitem").withColumn("p", F.col("l_quantity") * 2100), "l_extendedprice", "p", ["l_returnflag"])


_FITS = {
    "normal": "avg(l_quantity) AS mean, stddev_pop(l_quantity) AS sd",
    "exponential": "1 / avg(l_quantity) AS rate",
    "poisson": "avg(l_quantity) AS rate",
    "geometric": "1 / (1 + avg(l_quantity)) AS p",
    "lognormal": "avg(ln(l_quantity)) AS mu, stddev_pop(ln(l_quantity)) AS sigma",
}
for _name, _cols in _FITS.items():

    @register(f"fit_{_name}", f"SELECT l_returnflag, {_cols} FROM lineitem GROUP BY l_returnflag", rounded=tuple(c.split()[-1] for c in _cols.split(", ")))
    def _fit(spark, sf, name=_name):
        return B.fit_distribution(table(spark, sf, "lineitem"), "l_quantity", name, ["l_returnflag"])


@register("fit_gamma")
def _fit_gamma(spark, sf):
    return B.fit_distribution(table(spark, sf, "lineitem"), "l_quantity", "gamma", ["l_returnflag"])


@register("beta_binomial", "WITH s AS (SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') + 1.0 AS alpha, count(*) FILTER (l_returnflag <> 'R') + 1.0 AS beta FROM lineitem GROUP BY 1) SELECT *, alpha / (alpha + beta) AS mean, alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1)) AS variance FROM s", rounded=("alpha", "beta", "mean", "variance"), digits=10)
def _beta(spark, sf):
    return B.beta_binomial(table(spark, sf, "lineitem"), F.col("l_returnflag") == "R", by=["l_linestatus"])


@register("normal_normal", "SELECT l_returnflag, sum(l_quantity) / 200 / (1 / 1000 + count(*) / 200) AS mean, 1 / (1 / 1000 + count(*) / 200) AS variance FROM lineitem GROUP BY 1", rounded=("mean", "variance"))
def _normal(spark, sf):
    return B.normal_normal(table(spark, sf, "lineitem"), "l_quantity", 200.0, by=["l_returnflag"])


@register("gamma_poisson", "WITH s AS (SELECT l_returnflag, sum(l_quantity) + 1.0 AS alpha, count(*) + 1.0 AS beta FROM lineitem GROUP BY 1) SELECT *, alpha / beta AS mean, alpha / beta ** 2 AS variance FROM s", rounded=("alpha", "beta", "mean", "variance"))
def _gamma(spark, sf):
    return B.gamma_poisson(table(spark, sf, "lineitem"), "l_quantity", by=["l_returnflag"])


@register("gelman_rubin", "WITH c AS (SELECT l_linenumber, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1) SELECT sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v)) AS r_hat FROM c", rounded=("r_hat",))
def _r_hat(spark, sf):
    return B.gelman_rubin(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity")


@register("jackknife_mean", "SELECT o_orderstatus, avg(o_totalprice) AS estimate, 0.0::DOUBLE AS bias, sqrt(var_samp(o_totalprice) / count(*)) AS se FROM orders GROUP BY 1", rounded=("estimate", "se"), digits=4)
def _jackknife(spark, sf):
    return B.jackknife_mean(table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])


@register("bootstrap_mean")
def _bootstrap(spark, sf):
    return B.poisson_bootstrap(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 100)


@register("permutation_test")
def _permutation(spark, sf):
    return B.permutation_test(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", "c_custkey", 100)


@register("stratified_sample", "SELECT o_orderstatus, CAST(ceil(count(*) * 0.1) AS BIGINT) AS n FROM orders GROUP BY 1")
def _stratified(spark, sf):
    return B.stratified_sample(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey", 0.1).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("cross_validate_linear")
def _cv(spark, sf):
    rows = table(spark, sf, "part")
    return B.cross_validate_linear(rows, ["p_size"], "p_retailprice", "p_partkey")
