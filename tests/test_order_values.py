import numpy as np
import pytest

from statloom.operators import descriptive
from statloom.plans.order import values_at


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_values_at_ranks(spark, seed):
    rng = np.random.default_rng(seed)
    v = [rng.normal(size=3000), np.round(rng.exponential(1e6, 3000)), np.append(rng.integers(0, 5, 2999), 1e15).astype(float)][seed]
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    ranks = [0, 299, 1500, 2998, 2999]
    assert values_at(df, "v", ranks, bins=16) == np.sort(v)[ranks].tolist() == values_at(df, "v", ranks)
    s, k = np.sort(v), 300
    assert descriptive.trimmed_mean(df, "v").first()[0] == pytest.approx(s[k:-k].mean())
    assert descriptive.winsorized_mean(df, "v").first()[0] == pytest.approx(np.clip(s, s[k], s[-k - 1]).mean())


def test_cut_means_of_nothing_and_of_ties(spark):
    df = spark.createDataFrame([(2.0,)] * 7, "v double")
    assert descriptive.trimmed_mean(df, "v").first()[0] == 2.0 == descriptive.winsorized_mean(df, "v").first()[0]
    assert descriptive.trimmed_mean(df.limit(0), "v").first()[0] is None
