"""Exact distributed percentiles equal NumPy's linear interpolation, in one round or many."""

import numpy as np
import pytest

from anomalytics.operators.quantiles import exact_percentiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def _frame(spark, values, parts=4):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("kind", ["uniform", "ties", "hot_third", "skewed"])
def test_bracket_path_matches_numpy(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "uniform":
        v = rng.uniform(0, 1000, 5000)
    elif kind == "ties":
        v = rng.integers(0, 40, 5000).astype(float)
    elif kind == "hot_third":
        v = np.concatenate([np.full(1700, 123.45), rng.normal(100, 30, 3300)])
    else:
        v = rng.lognormal(5, 1.5, 5000)
    df = _frame(spark, v)
    got = exact_percentiles(df, "x", PROBS, accuracy=100)
    want = np.percentile(v, [p * 100 for p in PROBS])
    assert np.allclose(got, want, rtol=0, atol=1e-9 * max(1.0, float(np.abs(v).max())))


def test_small_path_matches_numpy(spark):
    v = np.random.default_rng(3).normal(0, 1, 999)
    got = exact_percentiles(_frame(spark, v), "x", PROBS)
    assert np.allclose(got, np.percentile(v, [p * 100 for p in PROBS]))


def test_paths_agree_bit_for_bit(spark):
    v = np.random.default_rng(11).uniform(0, 1, 3001)
    df = _frame(spark, v)
    a = exact_percentiles(df, "x", [0.25, 0.75, 0.99])
    b = exact_percentiles(df, "x", [0.25, 0.75, 0.99], accuracy=100)
    assert a == b


def test_nulls_ignored_and_empty(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,)], "x double")
    assert exact_percentiles(df, "x", [0.5]) == [2.0]
    assert exact_percentiles(df.where("x > 10"), "x", [0.5]) == [None]


def test_wrong_n_is_rejected(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)] * 5, "x double")
    import pytest as _pytest

    with _pytest.raises(ValueError):
        exact_percentiles(df, "x", [0.5], n=105, accuracy=100)
    assert exact_percentiles(df, "x", [0.5], n=100, accuracy=100) == [49.5]


def test_nan_counts_as_the_largest_value(spark):
    v = [float(i) for i in range(500)] + [float("nan")] * 30
    for accuracy in (50, 50_000):
        got = exact_percentiles(_frame(spark, v), "x", [0.0, 0.5, 0.9, 0.99], accuracy=accuracy)
        assert got[:3] == [0.0, 264.5, pytest.approx(476.1)] and got[3] != got[3]


def test_driver_sees_counts_only(spark):
    """However many values a bracket holds, a round returns one row."""
    v = np.random.default_rng(5).normal(0, 1, 20_000)
    assert exact_percentiles(_frame(spark, v), "x", [0.25, 0.75], accuracy=60) == pytest.approx(list(np.percentile(v, [25, 75])), abs=1e-12)
