"""Resampling, scores of predictions, and fits of distributions.

A resample is never built: rows that count k times get the weight k, drawn from
a hash of seed, replicate and row, so any executor draws the same numbers again.
Linear statistics of all replicates come from one aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .descriptive import beside, observed


def _uniform(*parts) -> Column:
    """A number in (0, 1) from a hash."""
    h = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (h.cast("double") + 0.5) / float(1 << 53)


def poisson_bootstrap(df: DataFrame, x: str, id_col: str, replicates: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """Bootstrap of the mean with Poisson(1) weights of rows: estimate, bias, se and percentile interval."""
    rows = df.select(F.col(id_col).alias("i"), observed(x).alias("v")).where("v is not null")
    means = resampled_means(rows, "v", "i", "poisson", replicates, seed).select(F.col("mean").alias("m"))
    low = (1 - confidence) / 2
    s = means.agg(F.avg("m").alias("m"), F.stddev_samp("m").alias("se"), F.percentile("m", [low, 1 - low]).alias("q"))
    whole = rows.agg(F.avg("v").alias("estimate"))
    both = whole.crossJoin(F.broadcast(s))  # one row each
    return both.select("estimate", (F.col("m") - F.col("estimate")).alias("bias"), "se", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def permutation_test(df: DataFrame, x: str, group: str, a, b, id_col: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Two-sided test of a difference of means: labels are dealt again in each replicate with the groups' shares."""
    rows = df.where(F.col(group).isin(a, b)).select(F.col(id_col).alias("i"), observed(x).alias("v"), (F.col(group) == F.lit(a)).alias("g")).where("v is not null")
    s = rows.agg(F.avg(F.col("g").cast("double")).alias("share"), (F.avg(F.when(F.col("g"), F.col("v"))) - F.avg(F.when(~F.col("g"), F.col("v")))).alias("d")).first()
    total = rows.agg(F.count("v").cast("double").alias("n"), F.sum("v").alias("t"))
    sums = beside(_resampled_sums(rows.select(F.xxhash64(F.lit(seed).cast("long"), "i").alias("k"), F.col("v").alias("x")), "share", replicates, float(s["share"] or 0)), total, [])
    d = sums.where("w > 0 AND w < n").select((F.col("wx") / F.col("w") - (F.col("t") - F.col("wx")) / (F.col("n") - F.col("w"))).alias("d"))
    return d.agg(F.lit(s["d"]).alias("statistic"), ((F.count_if(F.abs("d") >= abs(s["d"] or 0.0)) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def jackknife_mean(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Estimate, bias and se of the mean by leaving out one row at a time, from sums."""
    v = observed(x)
    n = F.count(v).cast("double")
    return df.groupBy(*by).agg(F.avg(v).alias("estimate"), F.lit(0.0).alias("bias"), F.sqrt(F.var_samp(v) / n).alias("se"))


def stratified_sample(df: DataFrame, stratum: str, id_col: str, fraction: float, seed: int = 0) -> DataFrame:
    """ceil(fraction * rows) rows of each stratum, the least by a hash of the id.

    Each stratum's bound on the hash is found from counts of 4096 hash cells; only rows of the bound's cell are ranked.
    """
    from pyspark.sql import Window

    rows = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_col))).withColumn("__c", F.shiftrightunsigned("__h", 52))
    cells = rows.groupBy(F.col(stratum).alias("__s"), "__c").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumns({"__b": F.coalesce(F.sum("__n").over(upto), F.lit(0)), "__k": F.ceil(F.sum("__n").over(Window.partitionBy("__s")) * fraction)})
    both = rows.join(cells.withColumnRenamed("__c", "__d"), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__c") == F.col("__d")))
    whole = F.col("__b") + F.col("__n") <= F.col("__k")
    edge = both.where(~whole & (F.col("__b") < F.col("__k")))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", id_col))
    edge = edge.withColumn("__r", rank).where(F.col("__r") + F.col("__b") <= F.col("__k"))
    return both.where(whole).select(*df.columns).unionByName(edge.select(*df.columns))


def folds(df: DataFrame, id_col: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds a fold from 0 to k - 1 by a hash of the id."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(k)).cast("int"))


def cross_validate_linear(df: DataFrame, features: list[str], y: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Mean squared error of ordinary least squares on each fold: one aggregate of products by fold fits all k models."""
    from ..plans.gram import matrix, products
    from .regression import complete, linear

    rows = folds(complete(df, [*features, y], id_col), id_col, k, seed).persist()
    try:
        cols = [F.lit(1.0), *map(F.col, features), F.col(y)]
        sums = {r["fold"]: matrix(r, len(cols)) for r in rows.groupBy("fold").agg(*products(cols)).collect()}  # k rows
        total, p = sum(sums.values()), len(features) + 1
        error = F.lit(None).cast("double")
        for f, g in sums.items():
            b = np.linalg.solve((total - g)[:p, :p], (total - g)[:p, p])
            error = F.when(F.col("fold") == f, F.pow(F.col(y) - linear(b, features), 2)).otherwise(error)
        scores = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mse")).collect()
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(sorted(map(tuple, scores)), "fold int, n long, mse double")


def prediction_scores(df: DataFrame, actual: str, predicted: str, by: list[str] = ()) -> DataFrame:
    """mse, rmse, mae and R squared."""
    a, p = observed(actual), observed(predicted)
    rows = df.select(*by, a.alias("a"), p.alias("p")).dropna(subset=["a", "p"])
    d = F.col("a") - F.col("p")
    return rows.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.sum(d * d) / (F.var_pop("a") * F.count("a"))).alias("r2"))


def fit_distribution(df: DataFrame, x: str, name: str, by: list[str] = ()) -> DataFrame:
    """Parameters of normal, exponential, poisson, geometric, beta, lognormal or gamma from moments or likelihood."""
    v = observed(x)
    rows = df.select(*by, v.alias("v")).where("v is not null")
    v, m = F.col("v"), F.avg("v")
    if name == "normal":
        cols = [m.alias("mean"), F.stddev_pop(v).alias("sd")]
    elif name == "exponential":
        cols = [(1 / m).alias("rate")]
    elif name == "poisson":
        cols = [m.alias("rate")]
    elif name == "geometric":
        cols = [(1 / (1 + m)).alias("p")]
    elif name == "lognormal":
        cols = [F.avg(F.ln(v)).alias("mu"), F.stddev_pop(F.ln(v)).alias("sigma")]
    elif name == "beta":
        k = m * (1 - m) / F.var_samp(v) - 1
        cols = [(m * k).alias("alpha"), ((1 - m) * k).alias("beta")]
    elif name == "gamma":
        s = rows.groupBy(*by).agg(m.alias("__m"), (F.ln(m) - F.avg(F.ln(v))).alias("__s"))
        start = (3 - F.col("__s") + F.sqrt(F.pow(F.col("__s") - 3, 2) + 24 * F.col("__s"))) / (12 * F.col("__s"))
        s = s.withColumn("shape", start)
        for _ in range(3):  # Newton steps on log k - digamma(k) = s; one row for each group
            step = (F.ln("shape") - special.column("digamma", F.col("shape")) - F.col("__s")) / (1 / F.col("shape") - (special.column("digamma", F.col("shape") + 1e-5) - special.column("digamma", F.col("shape") - 1e-5)) / 2e-5)
            s = s.withColumn("shape", F.col("shape") - step)
        return s.select(*by, "shape", (F.col("shape") / F.col("__m")).alias("rate"))
    else:
        raise ValueError(f"unknown distribution {name!r}")
    return rows.groupBy(*by).agg(*cols)


def beta_binomial(df: DataFrame, success: Column, alpha: float = 1.0, beta: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Posterior of a proportion: alpha, beta, mean, variance."""
    s = df.where(success.isNotNull()).groupBy(*by).agg((F.count_if(success) + F.lit(alpha)).alias("alpha"), (F.count_if(~success) + F.lit(beta)).alias("beta"))
    a, b = F.col("alpha"), F.col("beta")
    return s.withColumns({"mean": a / (a + b), "variance": a * b / (F.pow(a + b, 2) * (a + b + 1))})


def normal_normal(df: DataFrame, x: str, known_variance: float, mean: float = 0.0, variance: float = 1000.0, by: list[str] = ()) -> DataFrame:
    """Posterior mean and variance of a mean with known variance."""
    v = observed(x)
    s = df.groupBy(*by).agg(F.count(v).alias("__n"), F.sum(v).alias("__s"))
    precision = 1 / variance + F.col("__n") / known_variance
    return s.select(*by, ((mean / variance + F.col("__s") / known_variance) / precision).alias("mean"), (1 / precision).alias("variance"))


def gamma_poisson(df: DataFrame, x: str, alpha: float = 1.0, beta: float = 1.0, by: list[str] = ()) -> DataFrame:
    """Posterior of a rate of counts: alpha, beta, mean, variance."""
    v = observed(x)
    s = df.groupBy(*by).agg((F.coalesce(F.sum(v), F.lit(0.0)) + alpha).alias("alpha"), (F.count(v) + F.lit(beta)).alias("beta"))
    return s.withColumns({"mean": F.col("alpha") / F.col("beta"), "variance": F.col("alpha") / F.pow("beta", 2)})


def gelman_rubin(chains: DataFrame, chain: str, x: str) -> DataFrame:
    """Potential scale reduction of chains of equal length."""
    c = chains.groupBy(chain).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    n = F.max("n")
    return c.agg(F.sqrt(((n - 1) / n * F.avg("v") + F.var_samp("m")) / F.avg("v")).alias("r_hat"))


def resampled_means(df: DataFrame, x: str, key: str, kind: str = "poisson", reps: int = 200, seed: int = 0) -> DataFrame:
    """Means of replicates (rep, mean): each key has a random weight in every replicate.

    Rows of one key share their weights, so the key of a block of neighbouring
    rows gives a block bootstrap, a row's own key the usual one.  Kinds: poisson
    counts, exponential (Bayesian bootstrap), rademacher and mammen (wild: the
    mean of x times its sign).  Weights depend on key and seed alone.  A task
    adds up one pair of numbers for each replicate; rows are not multiplied.
    """
    if kind not in ("poisson", "exponential", "rademacher", "mammen"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = df.select(F.xxhash64(F.lit(seed).cast("long"), key).alias("k"), observed(x).alias("x")).dropna()
    return _resampled_sums(rows, kind, reps).select("rep", F.when(F.col("w") != 0, F.col("wx") / F.col("w")).alias("mean"))


def _resampled_sums(rows: DataFrame, kind: str, reps: int, share: float = 0.5) -> DataFrame:
    """Rows (rep, w, wx): sums of weights and of weights times x over rows (k, x); ``share``: weight 1 with that chance, else 0."""
    import pyarrow as pa

    golden = (5**0.5 + 1) / 2
    limits = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(16)])

    def weights(k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = k[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(reps, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            for _ in range(2):
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            u = ((h ^ (h >> np.uint64(32))) >> np.uint64(11)).astype(float) / (1 << 53)
        if kind == "poisson":
            return np.searchsorted(limits, u, side="right").astype(float)
        if kind == "exponential":
            return -np.log1p(-u)
        if kind == "share":
            return (u < share).astype(float)
        if kind == "rademacher":
            return np.where(u < 0.5, -1.0, 1.0)
        return np.where(u < golden / 5**0.5, 1 - golden, golden)

    def run(batches):
        total = np.zeros((2, reps))
        for batch in batches:
            k, v = batch.column("k").to_numpy().view(np.uint64), batch.column("x").to_numpy()
            for i in range(0, len(k), 4096):
                w = weights(k[i : i + 4096])
                total += w.sum(axis=0), v[i : i + 4096] @ w
                if kind in ("rademacher", "mammen"):
                    total[0] += len(v[i : i + 4096]) - w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array(total[0]), pa.array(total[1])], ["rep", "w", "wx"])

    return rows.mapInArrow(run, "rep long, w double, wx double").groupBy("rep").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"))


def replicate_interval(reps: DataFrame, x: str = "mean", confidence: float = 0.95) -> DataFrame:
    """estimate, se and percentile interval of replicates."""
    tail = (1 - confidence) / 2
    return reps.agg(F.avg(x).alias("estimate"), F.stddev_samp(x).alias("se"), F.percentile(x, tail).alias("low"), F.percentile(x, 1 - tail).alias("high"))


def sign_flip_test(df: DataFrame, x: str, key: str, centre: float = 0.0, reps: int = 1000, seed: int = 0) -> DataFrame:
    """One-sample permutation test: the share of sign flips about the centre with a mean as far from 0."""
    rows = df.select(key, (observed(x) - centre).alias("d")).dropna()
    seen = rows.agg(F.avg("d").alias("seen"))
    flips = beside(resampled_means(rows, "d", key, "rademacher", reps, seed), seen, [])
    far = F.count_if(F.abs("mean") >= F.abs("seen") - 1e-12)
    return flips.agg(F.first("seen").alias("difference"), ((far + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def bayes_factor(df: DataFrame, a: str, b: str) -> DataFrame:
    """Harmonic-mean marginal likelihoods of two columns of log-likelihoods: log_factor, factor."""
    x, y = observed(a), observed(b)
    rows = df.select(x.alias("a"), y.alias("b"))
    top = rows.agg(F.max(-F.col("a")).alias("ta"), F.max(-F.col("b")).alias("tb"))
    s = beside(rows, top, []).agg(*[(F.ln(F.count(c)) - F.first(t) - F.ln(F.sum(F.exp(-F.col(c) - F.col(t))))).alias(f"m{c}") for c, t in (("a", "ta"), ("b", "tb"))])
    return s.select((F.col("ma") - F.col("mb")).alias("log_factor"), F.exp(F.col("ma") - F.col("mb")).alias("factor"))


def fit_beta(df: DataFrame, x: str, by: list[str] = ()) -> DataFrame:
    """Shapes of a beta distribution by moments."""
    v = observed(x)
    s = df.groupBy(*by).agg(F.avg(v).alias("m"), F.var_samp(v).alias("s"))
    k = F.col("m") * (1 - F.col("m")) / F.col("s") - 1
    return s.select(*by, (F.col("m") * k).alias("alpha"), ((1 - F.col("m")) * k).alias("beta"))


def fit_zero_inflated_poisson(df: DataFrame, x: str, rounds: int = 500, tol: float = 1e-12) -> tuple[float, float]:
    """(rate, share of extra zeros) by expectation-maximisation over three numbers: rows, zeros and the sum."""
    v = observed(x)
    s = df.agg(F.count(v).alias("n"), F.count_if(v == 0).alias("z"), F.sum(v).alias("s")).first()
    n, zeros, total = s["n"], s["z"], s["s"] or 0.0
    if not n:
        raise ValueError("no values")
    share, rate = max(0.0, zeros / n - np.exp(-total / n)), max(total / n, 1e-9)
    for _ in range(rounds):
        extra = zeros * share / (share + (1 - share) * np.exp(-rate)) if share else 0.0
        new = (total / max(n - extra, 1e-12), extra / n)
        moved = max(abs(new[0] - rate), abs(new[1] - share))
        rate, share = new
        if moved < tol:
            break
    return float(rate), float(share)


def goodness_of_fit(df: DataFrame, x: str, name: str, *parameters: float) -> DataFrame:
    """Anderson-Darling and Cramer-von Mises statistics against a given distribution, from global ranks."""
    from ..functions.distributions import distribution
    from ..plans.order import with_row_index

    rows = df.select(observed(x).alias("v")).dropna()
    rows = with_row_index(rows, "v", name="i")
    f = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), distribution(name, *parameters).cdf("v")))
    rows = rows.select((F.col("i") + 1).cast("double").alias("i"), f.alias("f"))
    rows = beside(rows, rows.agg(F.count(F.lit(1)).cast("double").alias("n")), [])
    i, n = F.col("i"), F.col("n")
    ad = (2 * i - 1) * F.ln("f") + (2 * (n - i) + 1) * F.ln(1 - F.col("f"))
    cm = F.pow(F.col("f") - (2 * i - 1) / (2 * n), 2)
    s = rows.agg(F.max("n").alias("n"), F.sum(ad / n).alias("a"), F.sum(cm).alias("c"))
    return s.select(F.col("n").cast("long").alias("n"), (-F.col("n") - F.col("a")).alias("anderson_darling"), (1 / (12 * F.col("n")) + F.col("c")).alias("cramer_von_mises"))


def effective_size(df: DataFrame, x: str, t: str, series: list[str], lags: int = 100) -> DataFrame:
    """Draws of each chain over one plus twice its autocorrelations up to the first negative one."""
    from .series import autocorrelation

    r = autocorrelation(df, x, t, series, lags).where("lag > 0")
    first = r.groupBy(*series).agg(F.min(F.when(F.coalesce("autocorrelation", F.lit(-1.0)) < 0, F.col("lag"))).alias("end"))
    kept = (r.join(first, series) if series else beside(r, first, [])).where("end is null or lag < end")
    got = kept.groupBy(*series).agg(F.sum("autocorrelation").alias("s"))
    n = df.where(observed(x).isNotNull()).groupBy(*series).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(got, series, "left") if series else beside(n, got, [])
    return out.select(*series, "n", F.when(F.col("n") < 10, F.col("n").cast("double")).otherwise(F.col("n") / (1 + 2 * F.coalesce("s", F.lit(0.0)))).alias("effective"))


def chain_diagnostics(chains: DataFrame, chain: str, x: str, t: str, lags: int = 100) -> DataFrame:
    """Rows (chain, n, mean, sd, effective, r_hat): each chain's moments and effective size, and the scale reduction of all of them."""
    v = observed(x)
    own = chains.groupBy(chain).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    size = effective_size(chains, x, t, [chain], lags)
    size = size.select(F.col(chain).alias("__c"), "effective")
    both = own.join(size, F.col(chain) == F.col("__c"), "left").drop("__c")
    return beside(both, gelman_rubin(chains.where(v.isNotNull()), chain, x), [])
