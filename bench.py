"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

QUERIES = (
    "describe_by_group", "describe_prices", "percentiles", "trimmed_mean", "hinges", "weighted_stats", "t_welch", "anova_two_way", "mann_whitney", "kruskal_wallis",
    "chi_squared_independence", "adjust_benjamini_hochberg", "spearman", "kendall", "linear_multiple", "logistic", "influence", "kaplan_meier", "log_rank", "score_matching",
    "autocorrelation", "seasonal_decompose", "running_stats", "event_time_windows", "principal_components", "vector_distances", "page_rank_rounds", "moran", "bootstrap_mean", "cross_validate_linear",
    "winsorized_mean", "cox_regression", "clustering_coefficient", "connected_components", "distribution_functions", "mixed_intercepts", "nested_cross_validation", "family_scores", "nearest_points", "smooth_curves", "arima_lags",
)


def special_rates(n: int = 100_000) -> dict[str, float]:
    """Milliseconds for 100,000 values of each special function on one core, with varied arguments so that nothing is cached."""
    import numpy as np

    from statloom.functions import special as S

    u = (np.arange(n) + 0.5) / n
    calls = {
        "gammaLn(5.5)": lambda: S.gamma_ln(5 + u), "gammaLn(0.1)": lambda: S.gamma_ln(0.1 + 0.1 * u), "gamma(5.5)": lambda: S.gamma(5 + u), "betaFn(2, 5)": lambda: S.beta(2 + u, 5.0), "betaFn(0.5, 0.5)": lambda: S.beta(0.5 + u / 9, 0.5),
        "erf(1.0)": lambda: S.erf(0.9 + 0.2 * u), "erf(2.5)": lambda: S.erf(2.4 + 0.2 * u), "erfc(1.0)": lambda: S.erfc(0.9 + 0.2 * u), "regularizedGammaP(2, 3)": lambda: S.gamma_p(2.0, 2.5 + u), "regularizedGammaP(10, 5)": lambda: S.gamma_p(10.0, 4.5 + u),
        "regularizedBeta(0.5, 2, 5)": lambda: S.beta_i(0.4 + 0.2 * u, 2.0, 5.0), "regularizedBeta(0.3, 0.5, 0.5)": lambda: S.beta_i(0.2 + 0.2 * u, 0.5, 0.5), "logFactorial(100)": lambda: S.log_factorial(50 + np.floor(100 * u)), "binomialCoeff(20, 10)": lambda: S.binomial(20.0, np.floor(20 * u)),
    }
    took = {}
    for name, call in calls.items():
        call()
        began = time.time()
        call()
        took[name] = round((time.time() - began) * 1000 * 100_000 / n, 2)
    return took


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from statloom import registry

    queries = registry.queries()
    spark.read.parquet(f"{sf}/lineitem.parquet").count()  # starts the session before the clock
    took: dict[str, float] = {}
    for name in QUERIES:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "special_ms_per_100k": special_rates(), "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
