"""Bayesian networks over bands of line items, paths and factors of their prices."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import bayesnet as B
from ..operators import sem as S
from ..registry import register, table

_NAMES = ("quantity", "discount", "price", "revenue", "flag")
_BANDS = """b AS (SELECT CAST(CAST(ceil(l_quantity / 13) AS INT) AS VARCHAR) AS quantity, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS discount, CAST(CAST(floor(l_extendedprice / 20000) AS INT) AS VARCHAR) AS price,
    CAST(CAST(floor(l_extendedprice * (1 - l_discount) / 20000) AS INT) AS VARCHAR) AS revenue, l_returnflag AS flag FROM lineitem)"""


def _bands(spark, sf):
    price, revenue = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf, "lineitem").select(
        F.ceil(F.col("l_quantity") / 13).cast("int").cast("string").alias("quantity"),
        F.when(F.col("l_discount") > 0.05, "high").otherwise("low").alias("discount"),
        F.floor(price / 20000).cast("int").cast("string").alias("price"),
        F.floor(revenue / 20000).cast("int").cast("string").alias("revenue"),
        F.col("l_returnflag").alias("flag"),
    )


def _score_sql(node: str, parents: tuple[str, ...]) -> str:
    by = ", ".join(parents)
    over = f"OVER (PARTITION BY {by})" if parents else "OVER ()"
    q = f"(SELECT count(*) FROM (SELECT DISTINCT {by} FROM b))" if parents else "1"
    names = ", ".join(f"'{p}'" for p in parents)
    return f"""SELECT '{node}' AS node, concat_ws(',', {names or "''"}) AS parents, sum(n * ln(n / t)) - 0.5 * {q} * ((SELECT count(DISTINCT {node}) FROM b) - 1) * ln((SELECT count(*) FROM b)) AS score
      FROM (SELECT n, sum(n) {over} AS t FROM (SELECT {", ".join((node, *parents))}, count(*)::DOUBLE AS n FROM b GROUP BY ALL))"""


_FAMILIES = [(v, ps) for v in _NAMES for k in range(3) for ps in combinations([x for x in _NAMES if x != v], k)]


@register("family_scores", f"WITH {_BANDS} " + " UNION ALL ".join(_score_sql(v, ps) for v, ps in _FAMILIES), rounded=("score",), digits=3)
def _scores(spark, sf):
    out = B.family_scores(B.configurations(_bands(spark, sf), _NAMES), _FAMILIES)
    return out.withColumn("parents", F.concat_ws(",", "parents"))


_ONE = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, * FROM ({_score_sql(_NAMES[i], (_NAMES[j],) if j >= 0 else ())})" for i in range(len(_NAMES)) for j in range(-1, i))


@register("greedy_parents", f"WITH {_BANDS}, s AS ({_ONE}), t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS r FROM s) SELECT node AS child, parents AS parent, score FROM t WHERE r = 1 AND j >= 0", rounded=("score",), digits=3)
def _parents(spark, sf):
    """Each variable's best single parent among those before it, if it has one, and the family's score."""
    rows = _bands(spark, sf)
    network, _ = B.learn_structure(rows, _NAMES, most=1)
    families = [(c, [p]) for p, c in network.edges]
    return B.family_scores(B.configurations(rows, _NAMES), families).select(F.col("node").alias("child"), F.col("parents")[0].alias("parent"), "score")


_NETWORK = {"quantity": [], "discount": [], "price": ["quantity"], "revenue": ["price", "discount"], "flag": ["revenue"]}


def _tables_sql() -> str:
    out = []
    for v, ps in _NETWORK.items():
        over = f"PARTITION BY {', '.join(ps)}" if ps else ""
        out.append(f"t_{v} AS (SELECT {', '.join((v, *ps))}, count(*)::DOUBLE / sum(count(*)) OVER ({over}) AS p FROM b GROUP BY {', '.join((v, *ps))})")
    return ", ".join(out)


@register(
    "network_posterior",
    f"""WITH {_BANDS}, {_tables_sql()}, j AS (SELECT q.quantity AS value, sum(q.p * d.p * c.p * r.p * f.p) AS p FROM t_quantity AS q, t_discount AS d JOIN t_price AS c ON c.quantity = q.quantity JOIN t_revenue AS r ON r.price = c.price AND r.discount = d.discount JOIN t_flag AS f ON f.revenue = r.revenue
    WHERE f.flag = 'R' AND d.discount = 'high' AND r.revenue = '1' GROUP BY 1) SELECT value, p / sum(p) OVER () AS p FROM j""",
    rounded=("p",), digits=9,
)
def _posterior(spark, sf):
    """What quantity a returned line with a high discount and a middling revenue is likely to have."""
    network = B.Network({v: list(ps) for v, ps in _NETWORK.items()})
    return B.infer(network, B.fit_tables(_bands(spark, sf), network), "quantity", {"flag": "R", "discount": "high", "revenue": "1"})


_PRICES = "x AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_extendedprice * (1 - l_discount) + 400 * l_quantity AS DOUBLE) AS r FROM lineitem), c AS (SELECT corr(q, p) AS qp, corr(q, r) AS qr, corr(p, r) AS pr FROM x)"


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) + 400 * F.col("l_quantity")).cast("double").alias("r"))


@register(
    "path_effects",
    f"""WITH {_PRICES}, b AS (SELECT qp, (qr - pr * qp) / (1 - qp * qp) AS qr, (pr - qr * qp) / (1 - qp * qp) AS pr FROM c)
    SELECT 'q' AS source, 'p' AS target, qp AS direct, 0.0 AS indirect, qp AS total FROM b UNION ALL SELECT 'q', 'r', qr, qp * pr, qr + qp * pr FROM b UNION ALL SELECT 'p', 'r', pr, 0.0, pr FROM b""",
    rounded=("direct", "indirect", "total"), digits=8,
)
def _effects(spark, sf):
    """How quantity acts on a charge, by itself and through the price."""
    return S.path_analysis(_prices(spark, sf), [("q", "p"), ("q", "r"), ("p", "r")]).table(spark)


_INDICATORS = "x AS (SELECT l_extendedprice * (1 + 3 * l_discount) AS a, l_extendedprice * (1 - 5 * l_tax) AS b, l_extendedprice + 1500.0 * l_quantity AS c FROM lineitem), k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x)"


@register(
    "factor_loadings",
    f"""WITH {_INDICATORS}, l AS (SELECT unnest(['a', 'b', 'c']) AS indicator, unnest([sqrt(ab * ac / bc), sqrt(ab * bc / ac), sqrt(ac * bc / ab)]) AS loading FROM k)
    SELECT 'price' AS factor, indicator, loading, loading ** 2 AS communality, 1 - loading ** 2 AS uniqueness FROM l""",
    rounded=("loading", "communality", "uniqueness"), digits=6,
)
def _loadings(spark, sf):
    """One factor behind three prices, whose likelihood has a closed form."""
    price = F.col("l_extendedprice")
    t = table(spark, sf, "lineitem").select((price * (1 + 3 * F.col("l_discount"))).alias("a"), (price * (1 - 5 * F.col("l_tax"))).alias("b"), (price + 1500.0 * F.col("l_quantity")).alias("c"))
    return S.confirmatory_factors(t, {"price": ["a", "b", "c"]}).table(spark)


@register(
    "model_fit",
    f"""WITH {_INDICATORS}, d AS (SELECT *, ln(1 + 2 * ab * ac * bc - ab ** 2 - ac ** 2 - bc ** 2) AS log_all, (SELECT count(*) FROM x) AS n FROM k),
    f AS (SELECT n, -(n - 1) * (log_all - ln(1 - ab ** 2)) AS chi, -(n - 1) * log_all AS alone, sqrt((ac ** 2 + bc ** 2) / 6) AS srmr FROM d)
    SELECT chi AS chi_squared, 2.0 AS df, sqrt((chi - 2) / (2 * (n - 1))) AS rmsea, 1 - (chi - 2) / (alone - 3) AS cfi, (alone / 3 - chi / 2) / (alone / 3 - 1) AS tli, srmr, chi + 8 AS aic, chi + 4 * ln(n) AS bic FROM f""",
    rounded=("chi_squared", "rmsea", "cfi", "tli", "srmr", "aic", "bic"), digits=4,
)
def _fit(spark, sf):
    """The fit of a model in which only two of the three prices go together."""
    price = F.col("l_extendedprice")
    t = table(spark, sf, "lineitem").select((price * (1 + 3 * F.col("l_discount"))).alias("a"), (price * (1 - 5 * F.col("l_tax"))).alias("b"), (price + 1500.0 * F.col("l_quantity")).alias("c"))
    n, r = S.correlations(t, ["a", "b", "c"])
    implied = r.copy()
    implied[2, :2] = implied[:2, 2] = 0.0
    got = S.fit_indices(r, implied, n, 4)
    del got["p_value"]
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))
