"""Causal estimates and meta-analysis, each from one or two aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import staged, with_average_rank, with_row_index
from ..plans.gram import centred
from .descriptive import beside, observed
from .regression import LinearModel, complete, from_moments, linear, logistic


def propensity_scores(df: DataFrame, features: list[str], treatment: str, name: str = "score") -> DataFrame:
    """Adds the probability of treatment from a logistic regression."""
    model = logistic(df, features, treatment, rounds=25)
    return df.withColumn(name, 1 / (1 + F.exp(-linear(model.coefficients, features))))


def inverse_probability(df: DataFrame, y: str, treatment: str, score: str) -> DataFrame:
    """Average effects on all and on the treated by inverse probability weights; scores are kept in [0.01, 0.99]."""
    v, t, e = observed(y), observed(treatment), F.least(F.greatest(observed(score), F.lit(0.01)), F.lit(0.99))
    rows = df.select(v.alias("y"), t.alias("t"), e.alias("e")).dropna()
    y_, t_, e_ = F.col("y"), F.col("t"), F.col("e")
    odds = (1 - t_) * e_ / (1 - e_)
    return rows.agg(
        F.avg(t_ * y_ / e_ - (1 - t_) * y_ / (1 - e_)).alias("ate"), (F.sum(t_ * y_) / F.sum(t_) - F.sum(odds * y_) / F.sum(odds)).alias("att"), F.count(F.lit(1)).alias("n")
    )


def nearest_score_matching(df: DataFrame, y: str, treatment: str, score: str, id_col: str, buckets: int = 1024) -> DataFrame:
    """The treated rows with the control row of the nearest score (ties: the least id), with replacement.

    Scores are cut into equal buckets.  Within a bucket, windows carry the last
    and the next control; for the ends of a bucket, the outermost controls of
    the others (two rows for each bucket) are carried in the same way.  No pair
    of rows is formed but the match.
    """
    rows = df.select(F.col(id_col).alias("id"), observed(y).alias("y"), observed(treatment).alias("t"), observed(score).alias("e")).dropna()
    rows = rows.withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.col("e") * buckets)))
    # of controls with one score, the least id counts
    control = rows.where("t = 0").groupBy("b", "e").agg(F.min(F.struct("id", "y")).alias("c"))
    control = control.select("b", "e", F.struct("e", "c.id", "c.y").alias("c"))
    ends = control.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    grid = df.sparkSession.range(buckets).select(F.col("id").alias("b")).join(F.broadcast(ends), "b", "left")  # one row per bucket
    back, ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    grid = grid.select("b", F.last("hi", True).over(back).alias("outer_lo"), F.first("lo", True).over(ahead).alias("outer_hi"))
    mixed = rows.where("t = 1").select("b", "e", "id", "y", F.lit(None).cast(dict(control.dtypes)["c"]).alias("c"))
    mixed = mixed.unionByName(control.select("b", "e", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit(None).cast("double").alias("y"), "c"))
    upto, after = Window.partitionBy("b").orderBy("e").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("b").orderBy("e").rangeBetween(0, Window.unboundedFollowing)
    near = mixed.select("b", "e", "id", "y", F.last("c", True).over(upto).alias("lo"), F.first("c", True).over(after).alias("hi")).where("id is not null")
    near = near.join(F.broadcast(grid), "b")
    lo, hi = F.coalesce("lo", "outer_lo"), F.coalesce("hi", "outer_hi")

    def gap(c: Column) -> Column:
        return F.when(c.isNotNull(), F.struct(F.abs(c["e"] - F.col("e")).alias("gap"), c["id"].alias("match"), c["y"].alias("match_y")))

    best = F.coalesce(F.least(gap(lo), gap(hi)), gap(lo), gap(hi))
    return near.withColumn("m", best).select("id", "y", "m.match", "m.match_y", "m.gap").where("match is not null")


def matched_effect(pairs: DataFrame) -> DataFrame:
    """The average effect on the treated of matched rows, with its standard error."""
    d = F.col("y") - F.col("match_y")
    return pairs.agg(F.avg(d).alias("att"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se"), F.count(d).alias("n"))


def difference_in_differences(df: DataFrame, y: str, treated: Column, post: Column) -> DataFrame:
    """Four means, their double difference, its standard error and p-value."""
    v = observed(y)
    sides = {"m11": treated & post, "m10": treated & ~post, "m01": ~treated & post, "m00": ~treated & ~post}
    aggs = []
    for k, c in sides.items():
        x = F.when(c, v)
        aggs += [F.avg(x).alias(k), (F.var_samp(x) / F.count(x)).alias(f"e{k}")]
    s = df.agg(*aggs)
    s = s.select(*sides, (F.col("m11") - F.col("m10") - (F.col("m01") - F.col("m00"))).alias("estimate"), F.sqrt(sum((F.col(f"e{k}") for k in sides), F.lit(0.0))).alias("se"))
    return s.withColumn("p_value", special.column("normal_two_sided", F.col("estimate") / F.col("se")))


def two_stage(df: DataFrame, y: str, features: list[str], instruments: list[str]) -> LinearModel:
    """Two-stage least squares from one matrix of products; stats has the mean first-stage F."""
    if len(instruments) < len(features):
        raise ValueError("there must be as many instruments as features")
    cols = [*features, *instruments, y]
    n, mean, s = centred(complete(df, cols), cols)
    p, q = len(features), len(instruments)
    x, z, last = list(range(p)), list(range(p, p + q)), p + q
    szz, szx, szy = s[np.ix_(z, z)], s[np.ix_(z, x)], s[z, last]
    first = np.linalg.solve(szz, szx)
    a, b = first.T @ szx, first.T @ szy
    beta = np.linalg.solve(a, b)
    b0 = mean[last] - mean[x] @ beta
    rss = s[last, last] - 2 * beta @ s[x, last] + beta @ s[np.ix_(x, x)] @ beta
    mse = rss / (n - p - 1)
    inverse = np.linalg.inv(a)
    se = np.sqrt(mse * np.append(1 / n + mean[x] @ inverse @ mean[x], np.diag(inverse)))
    fs = [from_moments(instruments, n, mean[[*z, k]], s[np.ix_([*z, k], [*z, k])]).stats["f"] for k in x]
    return LinearModel(features, np.append(b0, beta), se, n, 0, {"first_stage_f": float(np.mean(fs)), "rss": float(rss)})


def regression_discontinuity(df: DataFrame, y: str, running: str, cutoff: float, bandwidth: float | None = None) -> DataFrame:
    """The jump of two linear fits at the cutoff, which belongs to the upper side."""
    v, r = observed(y), observed(running) - cutoff
    rows = df.select(v.alias("y"), r.alias("r")).dropna()
    if bandwidth:
        rows = rows.where(F.abs("r") <= bandwidth)
    aggs = []
    for side, c in (("above", F.col("r") >= 0), ("below", F.col("r") < 0)):
        a, b = F.when(c, F.col("y")), F.when(c, F.col("r"))
        aggs += [F.regr_intercept(a, b).alias(side), F.count(a).alias(f"n_{side}")]
    s = rows.agg(*aggs)
    return s.select((F.col("above") - F.col("below")).alias("estimate"), "above", "below", "n_above", "n_below")


def fuzzy_discontinuity(df: DataFrame, y: str, treatment: str, running: str, cutoff: float, bandwidth: float | None = None) -> LinearModel:
    """Two-stage fit with the side of the cutoff as instrument and the centred running variable in both stages."""
    rows = df.select(observed(y).alias("y"), observed(treatment).alias("t"), (observed(running) - cutoff).alias("r"))
    rows = rows.withColumn("side", F.when(F.col("r") >= 0, 1.0).otherwise(0.0))
    if bandwidth:
        rows = rows.where(F.abs("r") <= bandwidth)
    return two_stage(rows.withColumn("r2", F.col("r")), "y", ["t", "r"], ["side", "r2"])


def fixed_effects(studies: DataFrame, effect: str, variance: str, confidence: float = 0.95) -> DataFrame:
    """Inverse-variance mean of effects with se, z, p-value and interval."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    y, w = observed(effect), 1 / observed(variance)
    s = studies.agg((F.sum(w * y) / F.sum(w)).alias("estimate"), F.sqrt(1 / F.sum(w)).alias("se"))
    s = s.withColumn("statistic", F.col("estimate") / F.col("se"))
    s = s.withColumns({"low": F.col("estimate") - z * F.col("se"), "high": F.col("estimate") + z * F.col("se")})
    return s.withColumn("p_value", special.column("normal_two_sided", F.col("statistic")))


def random_effects(studies: DataFrame, effect: str, variance: str, confidence: float = 0.95) -> DataFrame:
    """DerSimonian-Laird: estimate, se, tau2, q, i2 (percent) and interval."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    rows = studies.select(observed(effect).alias("y"), observed(variance).alias("v")).dropna()
    w = 1 / F.col("v")
    one = rows.agg((F.sum(w * F.col("y")) / F.sum(w)).alias("m"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), (F.count(F.lit(1)) - 1).alias("df"))
    both = beside(rows, one, [])
    q = beside(both.agg(F.sum(w * F.pow(F.col("y") - F.col("m"), 2)).alias("q")), one, [])
    tau2 = F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / (F.col("w1") - F.col("w2") / F.col("w1")))
    q = q.select("q", "df", tau2.alias("tau2"))
    rows = beside(rows, q, [])
    u = 1 / (F.col("v") + F.col("tau2"))
    s = rows.agg((F.sum(u * F.col("y")) / F.sum(u)).alias("estimate"), F.sqrt(1 / F.sum(u)).alias("se"), F.first("tau2").alias("tau2"), F.first("q").alias("q"), F.first("df").alias("df"))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q")) * 100).otherwise(0.0)
    s = s.withColumns({"i2": i2, "low": F.col("estimate") - z * F.col("se"), "high": F.col("estimate") + z * F.col("se")})
    return s.withColumn("p_value", special.column("normal_two_sided", F.col("estimate") / F.col("se"))).drop("df")


def eggers_test(studies: DataFrame, effect: str, se: str) -> DataFrame:
    """Regression of effect / se on 1 / se: the intercept, its t and p-value."""
    from .regression import ordinary

    rows = studies.select((observed(effect) / observed(se)).alias("y"), (1 / observed(se)).alias("x"))
    model = ordinary(rows, ["x"], "y")
    return model.table(studies.sparkSession).where("term = '(intercept)'").drop("term")


def forest(studies: DataFrame, effect: str, variance: str, keep: list[str], confidence: float = 0.95) -> DataFrame:
    """Each study's effect with its interval and its weight (percent) in the random-effects mean."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    rows = studies.select(*keep, observed(effect).alias("effect"), observed(variance).alias("v")).dropna(subset=["effect", "v"])
    rows = beside(rows, random_effects(studies, effect, variance).select("tau2"), [])
    u = 1 / (F.col("v") + F.col("tau2"))
    rows = beside(rows, rows.agg(F.sum(u).alias("all")), [])
    half = z * F.sqrt("v")
    return rows.select(*keep, "effect", (F.col("effect") - half).alias("low"), (F.col("effect") + half).alias("high"), (100 * u / F.col("all")).alias("weight"))


def funnel(studies: DataFrame, effect: str, se: str, steps: int = 50, confidence: float = 0.95) -> DataFrame:
    """The pseudo-interval around the fixed-effects mean at ``steps + 1`` standard errors from 0 to the largest."""
    z = float(special.normal_quantile(0.5 + confidence / 2))
    y, s = observed(effect), observed(se)
    one = studies.agg((F.sum(y / (s * s)) / F.sum(1 / (s * s))).alias("centre"), F.max(s).alias("most"))
    rows = one.select("centre", "most", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    at = F.col("most") * F.col("step") / steps
    return rows.select("step", at.alias("se"), (F.col("centre") - z * at).alias("low"), (F.col("centre") + z * at).alias("high"))


def beggs_test(studies: DataFrame, effect: str, variance: str) -> DataFrame:
    """Kendall's rank correlation of standardised effects with variances: n, tau, z, p_value."""
    from .association import kendall

    rows = studies.select(observed(effect).alias("y"), observed(variance).alias("v")).dropna()
    one = rows.agg((F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).alias("m"), F.sum(1 / F.col("v")).alias("w"))
    rows = beside(rows, one, [])
    return kendall(rows.select(((F.col("y") - F.col("m")) / F.sqrt(F.col("v") - 1 / F.col("w"))).alias("t"), "v"), "t", "v")


def trim_and_fill(studies: DataFrame, effect: str, variance: str, rounds: int = 50) -> DataFrame:
    """Estimate of the missing studies on the side that has fewer (the estimator L0), and the mean with their mirror images.

    Effects are centred at the mean of those that stay; the rank sum of those
    above it tells how many extreme ones have no counterpart.  Columns:
    missing, side, estimate, adjusted.
    """
    rows = staged(studies.select(observed(effect).alias("y"), observed(variance).alias("v")).dropna(), "studies")
    n = rows.count()
    if not n:
        raise ValueError("no complete rows")
    mean = lambda d: d.agg(F.sum(F.col("y") / F.col("v")) / F.sum(1 / F.col("v"))).first()[0]
    plain = mean(rows)
    third = rows.agg(F.sum(F.pow(F.col("y") - plain, 3) / F.col("v"))).first()[0]
    sign = 1.0 if third >= 0 else -1.0  # the side with the long tail is complete
    ranked = with_row_index(rows.withColumn("s", sign * F.col("y")), F.col("s").desc(), F.col("v"), name="place")
    k, centre = 0, plain
    for _ in range(rounds):
        dist = ranked.withColumn("d", F.col("s") - sign * centre)
        dist = with_average_rank(dist.withColumn("a", F.abs("d")), "a", "rank")
        total = dist.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0))).first()[0]
        new = int(max(0, min(n - 2, round((4 * total - n * (n + 1)) / (2 * n - 1)))))
        if new == k:
            break
        k = new
        centre = mean(ranked.where(F.col("place") >= k))
    mirrored = ranked.where(F.col("place") < k).select((2 * F.lit(centre) - F.col("y")).alias("y"), "v")
    adjusted = mean(rows.unionByName(mirrored)) if k else plain
    return studies.sparkSession.createDataFrame([(k, "left" if sign > 0 else "right", plain, adjusted)], "missing int, side string, estimate double, adjusted double")
