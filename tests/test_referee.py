import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import backtest, metrics, stats


def series(spark, x, key=None):
    return spark.createDataFrame([(i, float(v), key) for i, v in enumerate(x)], "t int, ret double, k string")


def long_run(x, y, lag):
    n = len(x)
    both = lambda a, b, k: (a[k:] * b[: n - k]).sum()
    return sum((1 if k == 0 else 1 - k / (lag + 1)) * (both(x, y, 0) if k == 0 else both(x, y, k) + both(y, x, k)) for k in range(lag + 1)) / n


def brute_se(x, lag, rf=0.0):
    mu, var = x.mean(), x.var()
    h1, h2 = x - mu, (x - mu) ** 2 - var
    g = np.array([1 / math.sqrt(var), -(mu - rf) / (2 * var**1.5)])
    omega = np.array([[long_run(a, b, lag) for b in (h1, h2)] for a in (h1, h2)])
    return math.sqrt(g @ omega @ g / len(x))


def test_default_lag_has_no_cap(spark):
    x = np.random.default_rng(0).normal(0.0005, 0.01, 25_000)
    x[1:] += 0.3 * x[:-1]
    row = stats.sharpe_se(series(spark, x)).first()
    want = int(4 * (25_000 / 100) ** (2 / 9))
    assert row.lag == want == 13 and row.se_hac == pytest.approx(brute_se(x, 13), rel=1e-9)
    given = stats.sharpe_se(series(spark, x[:300]), rf=0.001, lag=20).first()
    assert given.lag == 20 and given.se_hac == pytest.approx(brute_se(x[:300], 20, 0.001), rel=1e-9)


@pytest.mark.parametrize(
    "x, how, message",
    [([0.1, None, 0.2], {}, "non-finite"), ([0.1, float("nan"), 0.2], {}, "non-finite"), ([0.1, float("inf"), 0.2], {}, "non-finite"), ([0.1] * 5, {}, "zero variance"), ([0.1], {}, "at least 2"), ([0.1, 0.2, 0.3], {"lag": 3}, "lag")],
)
def test_sharpe_inputs_are_checked(spark, x, how, message):
    df = spark.createDataFrame(list(enumerate(x)), "t int, ret double")
    with pytest.raises(Exception, match=message):
        stats.sharpe_se(df, **how).collect()
    with pytest.raises(ValueError, match="lag"):
        stats.sharpe_se(df, lag=-1)


def errors(spark, a, b):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "t int, a double, b double")


def test_diebold_mariano_alternatives_and_errors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 0.5, 500), rng.normal(0, 1, 500)
    one = {k: stats.diebold_mariano(errors(spark, a, b), alternative=k).first() for k in ("two-sided", "a-better", "b-better")}
    assert one["two-sided"].better == "a" and one["two-sided"].p_value < 0.01 and one["a-better"].p_value < 0.01 < 0.99 < one["b-better"].p_value
    assert one["a-better"].p_value == pytest.approx(one["two-sided"].p_value / 2, abs=1e-12)
    d = a**2 - b**2
    assert one["two-sided"].statistic == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(500)))
    same = stats.diebold_mariano(errors(spark, a, a)).first()
    assert (same.statistic, same.p_value, same.better) == (0, 1, "tie")
    own = stats.diebold_mariano(errors(spark, a, b), loss=lambda x: F.abs(x) * F.abs(x)).first()
    assert own.statistic == pytest.approx(one["two-sided"].statistic)
    e = d - d.mean()
    v = stats.diebold_mariano(errors(spark, a, b), h=4).first().variance
    assert v == pytest.approx(sum((1 if k == 0 else 2) * (e[k:] * e[: 500 - k]).sum() / 500 for k in range(4)))
    up_down = [1.0, -1.0] * 20
    for bad, message in (({"alternative": "c"}, "alternative"), ({"loss": "cubic"}, "loss"), ({"weights": "flat"}, "weights"), ({"h": 0}, "horizon"), ({"h": 600}, "too few")):
        with pytest.raises(Exception, match=message):
            stats.diebold_mariano(errors(spark, a, b), **bad).collect()
    with pytest.raises(Exception, match="not positive"):
        stats.diebold_mariano(errors(spark, up_down, [0.0] * 40), loss="identity", h=2).collect()
    with pytest.raises(Exception, match="non-finite"):
        stats.diebold_mariano(errors(spark, [float("nan"), 1, 2, 3], [1, 2, 3, 4])).collect()


def test_bootstrap(spark):
    x = np.random.default_rng(5).normal(0.1, 1, 120)
    df = series(spark, x)
    exact = stats.bootstrap_variance(df, 6.0).first().variance
    reps = stats.resampled(df, 120, 6.0, 1500, 9).groupBy("b").agg(F.avg("ret").alias("m"), F.count("*").alias("n"))
    assert reps.where("n <> 120").isEmpty() and reps.agg(F.var_pop("m")).first()[0] == pytest.approx(exact, rel=0.12)
    p, n, d = 1 / 6, 120, x - x.mean()
    gamma = [(d[k:] * d[: n - k]).sum() / n for k in range(n)]
    assert exact == pytest.approx((gamma[0] + 2 * sum(((1 - k / n) * (1 - p) ** k + k / n * (1 - p) ** (n - k)) * gamma[k] for k in range(1, n))) / n)
    two = stats.bootstrap_variance(df.unionAll(df.withColumn("k", F.lit("b")).withColumn("ret", F.col("ret") * 2)), 6.0, "k").collect()
    assert sorted(r.variance for r in two) == pytest.approx([exact, 4 * exact])
    mean = lambda sample: sample["ret"].mean()
    a = stats.bootstrap_statistic(df, mean, 6, 200, 2).first()
    b = stats.bootstrap_statistic(df, mean, 6, 200, 2, method="basic").first()
    assert a.theta == pytest.approx(x.mean()) and (b.lower, b.upper) == pytest.approx((2 * a.theta - a.upper, 2 * a.theta - a.lower)) and a.lower < a.theta < a.upper
    with pytest.raises(Exception, match="non-finite"):
        stats.bootstrap_statistic(df, lambda sample: float("nan"), 6, 5).collect()
    for bad in ({"method": "other"}, {"alpha": 1.5}):
        with pytest.raises(ValueError):
            stats.bootstrap_statistic(df, mean, 6, 5, **bad)
    with pytest.raises(ValueError):
        stats.bootstrap_indices(spark, 10, 0.5, 3, 1)


def test_sharpe_difference_takes_every_row(spark):
    x = np.random.default_rng(8).normal(0.1, 1, (90, 2))
    x[29:, 0] += 5  # what lies beyond the 29th row counts
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "t int, a double, b double")
    row = stats.sharpe_difference_ci(df, 5, 200, 3).first()
    assert row.theta == pytest.approx(x[:, 0].mean() / x[:, 0].std() - x[:, 1].mean() / x[:, 1].std()) and row.lower > 0


def test_benjamini_hochberg_and_arbitrary_dependency(spark):
    p = [0.01, 0.02, 0.03, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
    got = stats.benjamini_hochberg(df).orderBy("rank").collect()
    assert [r.adjusted for r in got] == pytest.approx([0.04, 0.04, 0.04, 0.5]) and [r.rejected for r in got] == [True, True, True, False]
    c = sum(1 / k for k in range(1, 5))
    got = stats.benjamini_hochberg(df, dependency="arbitrary").orderBy("rank").collect()
    assert [r.adjusted for r in got] == pytest.approx([min(1, 0.04 * c)] * 3 + [min(1, 0.5 * c)]) and not any(r.rejected for r in got)


def test_bad_weights_are_errors(spark):
    good = [("2020-01-01", "A", 0.5), ("2020-01-01", "B", 0.5)]
    make = lambda rows: spark.createDataFrame(rows, "date string, ticker string, w double")
    assert backtest.checked(make(good)).count() == 2
    for bad in ([("2020-01-01", "A", 0.6), ("2020-01-01", "B", 0.5)], [("2020-01-01", "A", -0.1), ("2020-01-01", "B", 0.5)]):
        with pytest.raises(Exception, match="out of range"):
            backtest.checked(make(bad)).collect()


def test_summary_takes_rate_and_periods(spark):
    x = [0.02, -0.01] * 126
    df = spark.createDataFrame([(f"2020-01-01 {i}", v) for i, v in enumerate(x)], "date string, ret double")
    a, b = metrics.summary(df).first(), metrics.summary(df, rf=0.05, periods=12).first()
    sd = np.std(x, ddof=1)
    assert a.sharpe == pytest.approx(0.005 / sd * math.sqrt(252)) and b.sharpe == pytest.approx((0.005 - 0.05 / 12) / sd * math.sqrt(12))
