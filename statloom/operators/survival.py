"""Survival curves and the test of two of them.

Rows are reduced to one row per group and different time with partial
aggregation; numbers at risk are reverse running sums of those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..plans.order import running, staged, with_row_index
from .descriptive import observed


def life_table(df: DataFrame, time: str, event: Column | str, by: list[str] = ()) -> DataFrame:
    """Per group and different time: events, all rows that end there, and the number at risk."""
    by = list(by)
    e = F.col(event) if isinstance(event, str) else event
    t = observed(time)
    rows = df.where(t.isNotNull() & e.isNotNull()).groupBy(*by, t.alias("time")).agg(F.count_if(e.cast("boolean")).alias("events"), F.count(F.lit(1)).alias("ended"))
    if by:
        later = Window.partitionBy(*by).orderBy("time").rowsBetween(0, Window.unboundedFollowing)
        return rows.withColumn("at_risk", F.sum("ended").over(later))
    return running(with_row_index(rows, "time", name="__i"), "__i", "ended", "at_risk", "sum", backward=True).drop("__i")


def _cumulated(rows: DataFrame, by: list[str], **terms: Column) -> DataFrame:
    """Adds running sums by time of terms."""
    if by:
        upto = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({k: F.sum(v).over(upto) for k, v in terms.items()})
    rows = with_row_index(rows, "time", name="__i")
    for k, v in terms.items():
        rows = running(rows.withColumn(f"__{k}", v), "__i", f"__{k}", k).drop(f"__{k}")
    return rows.drop("__i")


def kaplan_meier(df: DataFrame, time: str, event: Column | str, by: list[str] = (), confidence: float = 0.95) -> DataFrame:
    """Per different time: at_risk, events, survival, Greenwood's se and the log-log interval."""
    by = list(by)
    z = float(special.normal_quantile(0.5 + confidence / 2))
    d, n = F.col("events"), F.col("at_risk")
    rows = _cumulated(
        life_table(df, time, event, by), by,
        __log=F.when(d < n, F.ln(1 - d / n)).otherwise(0.0), __zero=F.when(d == n, 1).otherwise(0), __green=F.when(d < n, d / (n * (n - d))).otherwise(0.0),
    )
    s = F.when(F.col("__zero") > 0, 0.0).otherwise(F.exp("__log"))
    rows = rows.withColumn("survival", s)
    s = F.col("survival")
    half = z * F.sqrt("__green") / F.abs(F.ln(s))
    inside = (s > 0) & (s < 1)
    low, high = (F.when(inside, F.pow(s, F.exp(sign * half))).otherwise(s) for sign in (1, -1))
    return rows.select(*by, "time", "at_risk", "events", "survival", (s * F.sqrt("__green")).alias("se"), low.alias("low"), high.alias("high"))


def median_survival(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """The first time at which survival is at most one half; null if it never is."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def nelson_aalen(df: DataFrame, time: str, event: Column | str, by: list[str] = ()) -> DataFrame:
    """Cumulative hazard and its variance."""
    by = list(by)
    d, n = F.col("events"), F.col("at_risk")
    rows = _cumulated(life_table(df, time, event, by), by, hazard=d / n, variance=d / (n * n))
    return rows.select(*by, "time", "at_risk", "events", "hazard", "variance")


def log_rank(df: DataFrame, time: str, event: Column | str, group: str, a, b) -> DataFrame:
    """Observed and expected events of group a, the statistic and its p-value."""
    e = F.col(event) if isinstance(event, str) else event
    t, first = observed(time), F.col(group) == F.lit(a)
    rows = df.where(t.isNotNull() & e.isNotNull() & F.col(group).isin(a, b))
    rows = rows.groupBy(t.alias("time")).agg(
        F.count_if(e.cast("boolean")).alias("d"), F.count_if(e.cast("boolean") & first).alias("d1"), F.count(F.lit(1)).alias("c"), F.count_if(first).alias("c1")
    )
    rows = with_row_index(rows, "time", name="i")
    rows = running(running(rows, "i", "c", "n", "sum", backward=True), "i", "c1", "n1", "sum", backward=True)
    n, n1, d = F.col("n"), F.col("n1"), F.col("d")
    expected = d * n1 / n
    var = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    s = rows.agg(F.sum("d1").alias("observed"), F.sum(expected).alias("expected"), F.sum(var).alias("variance"))
    s = s.withColumn("statistic", F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))
    return s.withColumn("p_value", special.column("chi2_sf", F.col("statistic"), F.lit(1.0)))


@dataclass
class CoxModel:
    """Log hazard ratios, their covariance, the log partial likelihood (Breslow) and its value without features."""

    features: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    n: int
    events: int
    rounds: int

    def table(self, spark) -> DataFrame:
        """One row for each feature: term, estimate, hazard_ratio, se, statistic, p_value."""
        rows = []
        for name, b, v in zip(self.features, self.coefficients.tolist(), np.diag(self.covariance).tolist(), strict=True):
            z = b / np.sqrt(v) if v > 0 else float("nan")
            rows.append((name, b, float(np.exp(b)), float(np.sqrt(max(v, 0.0))), float(z), float(special.normal_two_sided(z))))
        return spark.createDataFrame(rows, "term string, estimate double, hazard_ratio double, se double, statistic double, p_value double")

    def likelihood_ratio(self) -> tuple[float, float]:
        """The statistic against no features and its p-value."""
        s = 2 * (self.log_likelihood - self.null_log_likelihood)
        return s, float(special.chi2_sf(s, float(len(self.features))))


def cox_regression(df: DataFrame, time: str, event: Column | str, features: list[str], rounds: int = 25, tol: float = 1e-9) -> CoxModel:
    """Proportional hazards by Newton's method on Breslow's partial likelihood, with true risk sets.

    A round is one pass: sums of exp(xb), x exp(xb) and xx' exp(xb) for each
    different time.  Risk sets are reverse running sums of those over range
    partitions of the times, so no task sees more than its range; the driver
    gets p + p * p numbers.
    """
    e = F.col(event) if isinstance(event, str) else event
    p = len(features)
    rows = df.select(observed(time).alias("__t"), e.cast("boolean").alias("__e"), *[observed(c).alias(f"x{i}") for i, c in enumerate(features)]).dropna()
    centre = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("__e").alias("d"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(p)]).first()
    if not centre["d"]:
        raise ValueError("there must be an event")
    rows = rows.select("__t", "__e", *[(F.col(f"x{i}") - float(centre[f"x{i}"])).alias(f"x{i}") for i in range(p)])
    edges = sorted(set(rows.approxQuantile("__t", [k / 64 for k in range(1, 64)], 0.005)))  # at most 63 numbers
    block = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("__t")))
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    rows = staged(rows.withColumn("__b", block), "cox")
    beta, last, null = np.zeros(p), None, None
    for done in range(1, rounds + 1):
        eta = sum((float(beta[i]) * F.col(f"x{i}") for i in range(p)), F.lit(0.0))
        w = F.exp(eta)
        sums = {"s": w} | {f"s{i}": w * F.col(f"x{i}") for i in range(p)} | {f"s{i}_{j}": w * F.col(f"x{i}") * F.col(f"x{j}") for i, j in upper}
        hit = {"d": F.when(F.col("__e"), 1.0).otherwise(0.0), "ll": F.when(F.col("__e"), eta).otherwise(0.0)} | {f"d{i}": F.when(F.col("__e"), F.col(f"x{i}")).otherwise(0.0) for i in range(p)}
        times = rows.groupBy("__b", "__t").agg(*[F.sum(v).alias(k) for k, v in (sums | hit).items()])
        later = Window.partitionBy("__b").orderBy("__t").rowsBetween(0, Window.unboundedFollowing)
        blocks = times.groupBy("__b").agg(*[F.sum(k).alias(f"b_{k}") for k in sums])
        after = Window.orderBy(F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
        blocks = blocks.select("__b", *[F.coalesce(F.sum(f"b_{k}").over(after), F.lit(0.0)).alias(f"b_{k}") for k in sums])
        risk = times.withColumns({k: F.sum(k).over(later) for k in sums}).join(F.broadcast(blocks), "__b").where("d > 0")
        total = {k: F.col(k) + F.col(f"b_{k}") for k in sums}
        mean = {i: total[f"s{i}"] / total["s"] for i in range(p)}
        got = risk.agg(
            F.sum(F.col("ll") - F.col("d") * F.ln(total["s"])).alias("ll"),
            *[F.sum(F.col(f"d{i}") - F.col("d") * mean[i]).alias(f"u{i}") for i in range(p)],
            *[F.sum(F.col("d") * (total[f"s{i}_{j}"] / total["s"] - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in upper],
        ).first()
        score, info = np.array([got[f"u{i}"] for i in range(p)]), np.zeros((p, p))
        for i, j in upper:
            info[i, j] = info[j, i] = got[f"h{i}_{j}"]
        null = got["ll"] if null is None else null
        step = np.linalg.solve(info, score)
        if last is not None and abs(got["ll"] - last) < tol * (1 + abs(last)) and np.abs(step).max() < 1e-6:
            break
        last = got["ll"]
        if done < rounds:
            beta = beta + step
    return CoxModel(features, beta, np.linalg.inv(info), got["ll"], null, centre["n"], centre["d"], done)
