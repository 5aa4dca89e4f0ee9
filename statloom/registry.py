"""Queries of the statistics part of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def register(name: str, sql: str | None = None, rounded: tuple[str, ...] = (), digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows.

    Both round the columns ``rounded``: sums of doubles depend on their order in the last digits.
    """

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = f
        if rounded:
            _QUERIES[name] = lambda spark, sf: f(spark, sf).withColumns({c: F.round(c, digits) for c in rounded})
        if sql is not None:
            _SQL[name] = sql if not rounded else "SELECT * REPLACE ({}) FROM ({}) AS q".format(", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in rounded), sql)
        return f

    return put


def queries() -> dict[str, Query]:
    from . import queries as _  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import queries as _  # noqa: F401

    return dict(_SQL)


@register(
    "describe_by_group",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty,
    avg(l_extendedprice) AS mean_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc
    FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _describe_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").alias("sum_qty"),
            F.avg("l_extendedprice").alias("mean_price"),
            F.min("l_discount").alias("min_disc"),
            F.max("l_discount").alias("max_disc"),
        )
    )
