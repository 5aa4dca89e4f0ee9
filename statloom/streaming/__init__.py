"""Online statistics: windows over ordered tables and Structured Streaming queries.

The functions named ``stream_*`` take a streaming DataFrame (and work on batch
ones); the others take a table with an explicit order and one or more series.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.descriptive import observed


def _snapshot(v: Column, w) -> dict[str, Column]:
    return {"n": F.count(v).over(w), "mean": F.avg(v).over(w), "variance": F.var_samp(v).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w)}


def running_stats(df: DataFrame, x: str, t: str, series: list[str]) -> DataFrame:
    """The statistics of a series up to each row."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(_snapshot(observed(x), w))


def sliding_stats(df: DataFrame, x: str, t: str, series: list[str], size: int) -> DataFrame:
    """The statistics of the last ``size`` rows at each row."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(-(size - 1), 0)
    return df.withColumns(_snapshot(observed(x), w))


def running_correlation(df: DataFrame, x: str, y: str, t: str, series: list[str]) -> DataFrame:
    """Covariance and correlation of two columns up to each row."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    u, v = observed(x), observed(y)
    return df.withColumns({"covariance": F.covar_samp(u, v).over(w), "correlation": F.corr(u, v).over(w)})


def batch_stats(df: DataFrame, x: str, t: str, series: list[str], size: int) -> DataFrame:
    """The statistics of each run of ``size`` rows, the last one perhaps shorter."""
    w = Window.partitionBy(*series).orderBy(t)
    v = observed(x)
    rows = df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return rows.groupBy(*series, "batch").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))


def stream_window_stats(stream: DataFrame, x: str, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Event-time windows with a watermark; partial aggregates merge in the state store."""
    v = observed(x)
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(span, *keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "variance", "min", "max")


def stream_session_stats(stream: DataFrame, x: str, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    v = observed(x)
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n", "total")


def _detector(key: str, x: str, t: str, warmup: int, threshold: float, drift: float):
    """CUSUM of z scores of one key: state is count, mean, m2 and both sums."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, up, down = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
        found: list[tuple] = []
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        for at, v in zip(rows[t], rows[x], strict=True):
            if n >= warmup and m2 > 0:
                z = (v - mean) / (m2 / (n - 1)) ** 0.5
                up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
                if up > threshold or down > threshold:
                    found.append((keys[0], at, "up" if up > threshold else "down", max(up, down)))
                    n, mean, m2, up, down = 0, 0.0, 0.0, 0.0, 0.0
                    continue
            n += 1
            step = v - mean
            mean += step / n
            m2 += step * (v - mean)
        state.update((n, float(mean), float(m2), float(up), float(down)))
        yield pd.DataFrame(found, columns=[key, t, "direction", "score"])

    return run


def stream_changes(stream: DataFrame, x: str, ts: str, key: str, warmup: int = 30, threshold: float = 3.0, drift: float = 0.5) -> DataFrame:
    """Changes of level of each key's values: (key, ts, direction, score); a key's statistics start afresh after one."""
    rows = stream.select(F.col(key), F.col(ts), observed(x).alias(x)).where(F.col(x).isNotNull())
    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, direction string, score double"
    return rows.groupBy(key).applyInPandasWithState(_detector(key, x, ts, warmup, threshold, drift), schema, "n long, mean double, m2 double, up double, down double", "append", GroupStateTimeout.NoTimeout)


def running_moments(df: DataFrame, x: str, t: str, series: list[str]) -> DataFrame:
    """Count, mean, variance, and adjusted skewness and excess kurtosis of a series up to each row."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    v = observed(x)
    rows = df.withColumns({"__n": F.count(v).over(w).cast("double"), "__s": F.skewness(v).over(w), "__k": F.kurtosis(v).over(w), "n": F.count(v).over(w), "mean": F.avg(v).over(w), "variance": F.var_samp(v).over(w)})
    n = F.col("__n")
    skew = F.when((n > 2) & (F.col("variance") > 0), F.col("__s") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n > 3) & (F.col("variance") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__k") + 6))
    return rows.withColumns({"skewness": skew, "kurtosis": kurt}).drop("__n", "__s", "__k")


def running_covariances(df: DataFrame, columns: list[str], t: str, series: list[str]) -> DataFrame:
    """Means, and the sample covariance and correlation of each pair of columns, up to each row."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    new = {f"mean_{c}": F.avg(observed(c)).over(w) for c in columns}
    new |= {f"cov_{a}_{b}": F.covar_samp(observed(a), observed(b)).over(w) for a, b in pairs}
    new |= {f"cor_{a}_{b}": F.corr(observed(a), observed(b)).over(w) for a, b in pairs if a != b}
    return df.withColumns(new)


def running_quantile(df: DataFrame, x: str, t: str, series: list[str], p: float = 0.5, accuracy: int = 1000) -> DataFrame:
    """A quantile of a series up to each row, from a mergeable sketch of bounded size."""
    w = Window.partitionBy(*series).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("quantile", F.percentile_approx(observed(x), p, accuracy).over(w))


def stream_quantile(stream: DataFrame, x: str, ts: str, keys: list[str], width: str, p: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """Quantiles of event-time windows; the sketch merges in the state store."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(observed(x)).alias("n"), F.percentile_approx(observed(x), p, 1000).alias("quantile"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "quantile")
