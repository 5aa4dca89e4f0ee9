"""Bootstraps of blocks of events and of a regression's residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import regression as R
from ..registry import register, table


@register("block_edges", "WITH m AS (SELECT avg(value) AS value, avg(value * value) AS square FROM events) SELECT unnest(range(20))::INT AS rep, value, square FROM m", rounded=("value", "square"), digits=7)
def _edges(spark, sf):
    """Blocks as long as the table: every replicate is the table itself, whatever row a circular block begins at."""
    t = table(spark, sf, "events")
    return B.block_means(t, {"value": F.col("value"), "square": F.col("value") * F.col("value")}, ["event_id"], t.count(), 20, "circular")


@register("moving_blocks")
def _moving(spark, sf):
    t = table(spark, sf, "events")
    return B.replicate_summary(B.block_means(t, {"m": F.col("value")}, ["event_id"], replicates=300, seed=2), "m", t.agg(F.avg("value")).first()[0])


@register("stationary_blocks")
def _stationary(spark, sf):
    t = table(spark, sf, "events")
    return B.replicate_summary(B.block_means(t, {"m": F.col("value")}, ["event_id"], replicates=300, kind="stationary", seed=3), "m", t.agg(F.avg("value")).first()[0])


@register("wild_slope")
def _wild(spark, sf):
    """The slope of price on quantity when residuals keep their sizes and lose their signs."""
    t = table(spark, sf, "lineitem")
    model = R.ordinary(t, ["l_quantity"], "l_extendedprice")
    s = t.agg(F.avg("l_quantity").alias("m"), F.regr_sxx("l_extendedprice", "l_quantity").alias("sxx")).first()
    t = model.transform(t, "fitted").withColumns({"residual": F.col("l_extendedprice") - F.col("fitted"), "row": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    reps = B.wild_functionals(t, "fitted", "residual", {"slope": (F.col("l_quantity") - s["m"]) / float(s["sxx"])}, "row", 300)
    return B.replicate_summary(reps, "slope", float(model.coefficients[1]))


@register("corrected_interval")
def _corrected(spark, sf):
    return B.corrected_interval(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 500)
