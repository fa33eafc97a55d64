"""The statistical referee: Sharpe inference, deflation, overfitting, forecast comparison, bootstrap, false discovery.

Nulls and non-finite values, series without variance, lags and horizons out of range are errors, never nulls.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_ppf, student_sf

EULER = 0.5772156649015329


def finite(rows: DataFrame, *cols: str) -> DataFrame:
    """The rows, or an error where one of ``cols`` is null, infinite or no number."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return rows.withColumns({c: F.when(ok(c), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} contains non-finite values")).cast("double")) for c in cols})


def unless(bad: Column, message: str, value: Column) -> Column:
    """The value, or an error where ``bad`` holds."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def hashed(seed: int, k: int, *cols) -> Column:
    """A number in (0, 1) from the MD5 of seed, k and columns as text, the same in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long") + 0.5) / float(1 << 40)


def default_lag(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")


def _positions(rets: DataFrame, *keys: str) -> DataFrame:
    return rets.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("t")))


def lagged_products(rows: DataFrame, x: str, y: str, most: int, *keys: str) -> DataFrame:
    """keys, lag, s: the sum of x[i] * y[i - lag] for lags 0..most; one pass by windows, no self-join."""
    w = Window.partitionBy(*keys).orderBy("i")
    terms = rows.select(*keys, F.array(*[F.col(x) * F.lag(y, k).over(w) for k in range(most + 1)]).alias("v"))
    return terms.select(*keys, F.posexplode("v").alias("lag", "v")).groupBy(*keys, "lag").agg(F.sum("v").alias("s"))


def sharpe_se(rets: DataFrame, *keys: str, rf: float = 0.0, q: int = 1, lag: int | None = None) -> DataFrame:
    """keys, n, sharpe, lag, se_iid, se_hac: Lo's standard errors, times the root of q.

    The HAC one uses Bartlett weights on the moments (r - mu, (r - mu)**2 - var); lag None is the default by n, as far as the longest series needs.
    """
    rets = finite(rets, "ret")
    if lag is not None and lag < 0:
        raise ValueError("a lag is 0 or more")
    base = rets.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("ret").alias("mu"), F.var_pop("ret").alias("var"))
    base = base.withColumn("var", unless(F.col("n") < 2, "at least 2 returns are needed", unless(F.col("var") == 0, "returns have zero variance", F.col("var"))))
    if lag is not None:
        base = base.withColumn("mu", unless(F.col("n") <= lag, "the lag is at most the number of returns less one", F.col("mu")))
    rows = _positions(rets, *keys).join(base, list(keys)) if keys else _positions(rets).crossJoin(base)
    rows = rows.withColumn("h1", F.col("ret") - F.col("mu")).withColumn("h2", F.pow(F.col("ret") - F.col("mu"), F.lit(2.0)) - F.col("var"))
    pairs = [("h1", "h1"), ("h1", "h2"), ("h2", "h1"), ("h2", "h2")]
    depth = lag if lag is not None else base.agg(F.max(default_lag(F.col("n")))).first()[0] or 0
    w = Window.partitionBy(*keys).orderBy("i")
    used = F.lit(lag) if lag is not None else default_lag(F.col("n"))
    rows = rows.withColumn("L", used)
    weight = lambda k: F.when(F.lit(k) <= F.col("L"), 1 - k / (F.col("L") + 1)).otherwise(0.0)
    omega = {}
    for x, y in pairs:
        terms = F.col(x) * F.col(y)
        for k in range(1, depth + 1):
            both = F.coalesce(F.col(x) * F.lag(y, k).over(w), F.lit(0.0)) + F.coalesce(F.col(y) * F.lag(x, k).over(w), F.lit(0.0))
            terms = terms + weight(k) * both
        omega[x + y] = terms
    rows = rows.withColumns(omega)
    s = rows.groupBy(*keys, "n", "mu", "var", "L").agg(*[(F.sum(c) / F.first("n")).alias(c) for c in omega])
    sd = F.sqrt("var")
    g1, g2 = 1 / sd, -(F.col("mu") - rf) / (2 * F.pow(sd, F.lit(3.0)))
    quad = g1 * g1 * F.col("h1h1") + g1 * g2 * (F.col("h1h2") + F.col("h2h1")) + g2 * g2 * F.col("h2h2")
    sr = (F.col("mu") - rf) / sd
    root = math.sqrt(q)
    return s.select(*keys, "n", sr.alias("sharpe"), F.col("L").alias("lag"), (F.sqrt((1 + sr * sr / 2) / F.col("n")) * root).alias("se_iid"), (F.sqrt(quad / F.col("n")) * root).alias("se_hac"))


def sharpe_ci(se: DataFrame, level: float = 0.95, which: str = "se_hac") -> DataFrame:
    z = norm_ppf(F.lit(0.5 + level / 2))
    return se.withColumn("lower", F.col("sharpe") - z * F.col(which)).withColumn("upper", F.col("sharpe") + z * F.col(which))


def annualisation(rets: DataFrame, q: int, *keys: str) -> DataFrame:
    """keys, eta: Lo's factor q / sqrt(q + 2 sum (q - k) rho_k) from sample autocorrelations."""
    base = rets.groupBy(*keys).agg(F.avg("ret").alias("mu"), F.var_pop("ret").alias("var"), F.count("*").alias("n"))
    rows = (_positions(rets, *keys).join(base, list(keys)) if keys else _positions(rets).crossJoin(base)).withColumn("d", F.col("ret") - F.col("mu"))
    s = lagged_products(rows, "d", "d", q - 1, *keys)
    total = s.join(base, list(keys)) if keys else s.crossJoin(base)
    rho = F.coalesce(F.col("s"), F.lit(0.0)) / (F.col("n") * F.col("var"))
    whole = total.groupBy(*keys).agg((q + 2 * F.sum(F.when(F.col("lag") > 0, (q - F.col("lag")) * rho).otherwise(0.0))).alias("a"))
    return whole.select(*keys, F.when(F.col("a") > 0, q / F.sqrt("a")).alias("eta"))


def eta_from_rho(rho: Column, q: Column) -> Column:
    """The factor for an AR(1) process whose lag-k autocorrelation is rho**k."""
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(q - 1, F.lit(1))), F.lit(0.0), lambda a, k: a + F.when(k < q, (q - k) * F.pow(rho, k.cast("double"))).otherwise(0.0))
    return q / F.sqrt(q + 2 * s)


def psr(sr: Column, n: Column, skew: Column, kurt: Column, benchmark: Column | float = 0.0) -> Column:
    """Probabilistic Sharpe ratio; kurt is not the excess. Null where the variance term isn't positive or kurt < 1."""
    v = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when((v > 0) & (kurt >= 1), norm_cdf((sr - benchmark) * F.sqrt(n - 1.0) / F.sqrt(F.greatest(v, F.lit(1e-300)))))


def expected_max_sharpe(n: Column, std: Column) -> Column:
    n = n.cast("double")
    z = (1 - EULER) * norm_ppf(1 - 1 / F.greatest(n, F.lit(2.0))) + EULER * norm_ppf(1 - 1 / (F.greatest(n, F.lit(2.0)) * math.e))
    return F.when(n <= 1, 0.0).otherwise(std * z)


def dsr(sr: Column, n: Column, skew: Column, kurt: Column, trials: Column, trial_std: Column | None = None, periods: float = 1.0) -> Column:
    """Deflated Sharpe ratio of an annual ratio (periods a year); without a deviation of trials' ratios, 1 / sqrt(n)."""
    root = math.sqrt(periods)
    std = 1 / F.sqrt(n.cast("double")) if trial_std is None else trial_std / root
    return psr(sr / root, n, skew, kurt, expected_max_sharpe(trials, std))


def block_sums(rets: DataFrame, blocks: int) -> DataFrame:
    """block, trial, n, s, ss: counts, sums and squares of a trial matrix (t, trial, ret); trailing rows are dropped."""
    if blocks % 2 or blocks < 4:
        raise ValueError("the number of blocks is even and at least 4")
    times = rets.select("t").distinct()
    size = F.floor(F.count("*").over(Window.partitionBy(F.lit(0))) / blocks)
    placed = times.withColumn("i", F.row_number().over(Window.orderBy("t")) - 1).withColumn("size", size)
    placed = placed.where((F.col("size") > 0) & (F.col("i") < F.col("size") * blocks)).select("t", F.floor(F.col("i") / F.col("size")).cast("int").alias("block"))
    return rets.join(placed, "t").groupBy("block", "trial").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("ss"))


def cscv(rets: DataFrame, blocks: int = 16) -> DataFrame:
    """One row a split into halves: best in-sample trial, its relative rank out of sample, its logit, both Sharpe ratios."""
    sums = block_sums(rets, blocks)
    spark = rets.sparkSession
    splits = spark.range(1 << blocks).where(F.bit_count("id") == blocks // 2).select(F.col("id").alias("split"))
    inside = F.expr("(split >> block) & 1") == 1
    halves = splits.crossJoin(F.broadcast(sums)).groupBy("split", "trial")  # blocks * trials rows, whatever the length

    def ratio(cond: Column) -> Column:
        n, s, ss = (F.sum(F.when(cond, F.col(c))) for c in ("n", "s", "ss"))
        return (s / n) / F.sqrt(F.nullif(F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0)), F.lit(0.0)))

    perf = halves.agg(ratio(inside).alias("is_sr"), ratio(~inside).alias("oos_sr"))
    w = Window.partitionBy("split")
    r = F.rank().over(w.orderBy("oos_sr")) + 0.5 * (F.count("*").over(Window.partitionBy("split", "oos_sr")) - 1)
    ranked = perf.withColumn("r", r).withColumn("n_trials", F.count("*").over(w)).withColumn("first", F.row_number().over(w.orderBy(F.desc("is_sr"), "trial")))
    omega = F.col("r") / (F.col("n_trials") + 1)
    return ranked.where("first = 1").select("split", F.col("trial").alias("best"), omega.alias("omega"), F.ln(omega / (1 - omega)).alias("logit"), "is_sr", "oos_sr")


def pbo(splits: DataFrame) -> DataFrame:
    """Probability of backtest overfitting; an exact median is not overfit."""
    return splits.agg(
        F.count("*").alias("n_splits"),
        F.avg(F.when(F.col("omega") < 0.5, 1.0).otherwise(0.0)).alias("pbo"),
        F.regr_slope("oos_sr", "is_sr").alias("slope"),
        F.avg(F.when(F.col("oos_sr") <= 0, 1.0).otherwise(0.0)).alias("prob_oos_loss"),
    )


def diebold_mariano(errors: DataFrame, *keys: str, h: int = 1, loss="squared", weights: str = "uniform", lag: int | None = None, alternative: str = "two-sided") -> DataFrame:
    """keys, n, mean_diff, variance, statistic, p_value, better, from (keys, t, a, b) errors of two forecasts.

    loss: squared, absolute, identity, or a function of a column.  alternative: two-sided, a-better or b-better.  variance
    is the long-run one of the loss differences.  Equal losses throughout give statistic 0, p 1 and a tie.
    """
    if weights not in ("uniform", "bartlett"):
        raise ValueError(f"unknown weights {weights}")
    if alternative not in ("two-sided", "a-better", "b-better"):
        raise ValueError(f"unknown alternative {alternative}")
    losses = {"squared": lambda x: x * x, "absolute": F.abs, "identity": lambda x: x}
    if not callable(loss) and loss not in losses:
        raise ValueError(f"unknown loss {loss}")
    of = loss if callable(loss) else losses[loss]
    lag = h - 1 if lag is None else lag
    if h < 1 or lag < 0:
        raise ValueError("a horizon is 1 or more, a lag 0 or more")
    d = finite(errors, "a", "b").withColumn("d", of(F.col("a")) - of(F.col("b")))
    base = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.max(F.abs("d")).alias("most"))
    base = base.withColumn("mean_diff", unless(F.col("n") < max(3, h, lag + 1), "too few errors for the horizon or lag", F.col("mean_diff")))
    rows = (_positions(d, *keys).join(base, list(keys)) if keys else _positions(d).crossJoin(base)).withColumn("e", F.col("d") - F.col("mean_diff"))
    s = lagged_products(rows, "e", "e", lag, *keys)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2.0 * (1.0 if weights == "uniform" else (1 - F.col("lag") / (lag + 1))))
    v = s.groupBy(*keys).agg(F.sum(weight * F.coalesce("s", F.lit(0.0))).alias("v"))
    out = v.join(base, list(keys)) if keys else v.crossJoin(base)
    n, same = F.col("n").cast("double"), F.col("most") == 0
    out = out.withColumn("variance", F.when(same, 0.0).otherwise(unless(F.col("v") <= 0, "the long-run variance is not positive: take bartlett weights", F.col("v") / n)))
    hln = n + 1 - 2 * h + h * (h - 1) / n
    root = unless(hln <= 0, "the horizon is too long for the number of errors", F.sqrt(hln / n))
    out = out.withColumn("statistic", F.when(same, 0.0).otherwise(F.col("mean_diff") / F.sqrt(F.nullif(F.col("variance") / n, F.lit(0.0))) * root))
    x = {"two-sided": F.abs("statistic"), "a-better": -F.col("statistic"), "b-better": F.col("statistic")}[alternative]
    p = F.when(same, 1.0).otherwise((2 if alternative == "two-sided" else 1) * student_sf(x, n - 1))
    better = F.when(F.col("mean_diff") < 0, "a").when(F.col("mean_diff") > 0, "b").otherwise("tie")
    return out.select(*keys, "n", "mean_diff", "variance", "statistic", p.alias("p_value"), better.alias("better"))


def bootstrap_indices(spark: SparkSession, n: int, block: float, replicates: int, seed: int) -> DataFrame:
    """b, t, i: indices of the stationary bootstrap. At a jump a fresh index, then consecutive ones, modulo n."""
    if n < 2 or block < 1 or replicates < 1:
        raise ValueError("at least 2 observations, a mean block of 1 and one replicate are needed")
    grid = spark.range(replicates).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    w = Window.partitionBy("b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    jump = (F.col("t") == 0) | (hashed(seed, 1, "b", "t") < 1.0 / block)
    fresh = F.when(jump, F.struct(F.col("t").alias("at"), F.floor(hashed(seed, 2, "b", "t") * n).cast("int").alias("i")))
    return grid.withColumn("j", F.last(fresh, ignorenulls=True).over(w)).select("b", "t", ((F.col("j.i") + F.col("t") - F.col("j.at")) % n).alias("i"))


def bootstrap_variance(rets: DataFrame, block: float, *keys: str) -> DataFrame:
    """keys, variance: that of the mean under the stationary bootstrap, exactly.

    gamma_0 + 2 sum (1 - k/n) (1-p)**k + (k/n) (1-p)**(n-k) terms of lag k, over n; all lags of a series come from one
    Fourier transform.  A series is one task's, and series run in parallel.
    """
    if block < 1:
        raise ValueError("a mean block is 1 or more")
    p = 1.0 / block

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("t")["ret"].to_numpy(float)
        n = len(x)
        f = np.fft.rfft(x - x.mean(), 2 * n)
        gamma = np.fft.irfft(f * np.conj(f), 2 * n)[:n] / n
        k = np.arange(n)
        weight = (1 - k / n) * (1 - p) ** k + k / n * (1 - p) ** (n - k)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), (gamma[0] + 2 * (weight * gamma)[1:].sum()) / n]], columns=[*keys, "variance"])

    kinds = dict(rets.dtypes)
    rows = finite(rets, "ret").select(*keys, "t", "ret")
    return rows.groupBy(*keys).applyInPandas(one, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "variance double"]))


def resampled(rets: DataFrame, n: int, block: float, replicates: int, seed: int) -> DataFrame:
    """b, place and all columns of ``rets`` (t from 0 to n - 1) for each resampled place; rows stay whole, so pairs stay paired."""
    i = bootstrap_indices(rets.sparkSession, n, block, replicates, seed)
    return i.select("b", F.col("t").alias("place"), F.col("i").alias("t")).join(rets, "t")


def bootstrap_ci(stats: DataFrame, theta: DataFrame, alpha: float = 0.05, method: str = "percentile") -> DataFrame:
    """theta, lower, upper, p_value from replicates' statistics (stat) and the sample's own, a table of one row (theta)."""
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    if method not in ("percentile", "basic"):
        raise ValueError(f"unknown method {method}")
    stats = finite(stats, "stat")
    lo, hi = F.percentile("stat", F.lit(alpha / 2)), F.percentile("stat", F.lit(1 - alpha / 2))
    tails = F.least(F.avg(F.when(F.col("stat") <= 0, 1.0).otherwise(0.0)), F.avg(F.when(F.col("stat") >= 0, 1.0).otherwise(0.0)))
    ends = theta.select("theta").crossJoin(stats.agg(lo.alias("lo"), hi.alias("hi"), F.least(F.lit(1.0), 2 * tails).alias("p_value")))
    low, high = ("lo", "hi") if method == "percentile" else (2 * F.col("theta") - F.col("hi"), 2 * F.col("theta") - F.col("lo"))
    of = lambda x: F.col(x) if isinstance(x, str) else x
    return ends.select("theta", of(low).alias("lower"), of(high).alias("upper"), "p_value")


def bootstrap_statistic(rets: DataFrame, statistic: Callable[[pd.DataFrame], float], block: float, replicates: int = 500, seed: int = 1, alpha: float = 0.05, method: str = "percentile") -> DataFrame:
    """As ``bootstrap_ci``, of any function of a sample's rows in their order (t and the other columns); replicates in parallel."""
    placed = rets.withColumn("t", F.row_number().over(Window.orderBy("t")) - 1)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stat": [float(statistic(pdf.sort_values("place")))]})

    reps = resampled(placed, rets.count(), block, replicates, seed).groupBy("b").applyInPandas(one, "stat double")
    own = placed.withColumns({"place": F.col("t"), "b": F.lit(0)}).groupBy("b").applyInPandas(one, "stat double").withColumnRenamed("stat", "theta")
    return bootstrap_ci(reps, own, alpha, method)


def sharpe_difference_ci(pairs: DataFrame, block: float = 20, replicates: int = 500, seed: int = 1, alpha: float = 0.05, method: str = "percentile") -> DataFrame:
    """From (t, a, b): the difference of population Sharpe ratios with a jointly resampled interval, over all rows."""
    sr = lambda c: F.avg(c) / F.nullif(F.stddev_pop(c), F.lit(0.0))
    pairs = finite(pairs, "a", "b").withColumn("t", F.row_number().over(Window.orderBy("t")) - 1)
    theta = pairs.agg((sr("a") - sr("b")).alias("theta"))
    stats = resampled(pairs.withColumnRenamed("b", "other"), pairs.count(), block, replicates, seed).groupBy("b").agg((sr("a") - sr("other")).alias("stat"))
    return bootstrap_ci(stats, theta, alpha, method)


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05, dependency: str = "independent") -> DataFrame:
    """Adds rank, adjusted and rejected to (id, p); "arbitrary" dependency takes the harmonic factor. Ties go by id."""
    if dependency not in ("independent", "arbitrary"):
        raise ValueError(f"unknown dependency {dependency}")
    whole = Window.partitionBy(F.lit(0))
    m = F.count("*").over(whole)
    r = tests.withColumn("m", m).withColumn("rank", F.row_number().over(Window.orderBy("p", "id")))
    c = F.lit(1.0) if dependency == "independent" else F.sum(1 / F.col("rank")).over(whole)
    r = r.withColumn("c", c)
    # from the last rank down, as a frame that ends behind the current row would be summed anew for each row
    up = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.min(F.col("m") * F.col("c") / F.col("rank") * F.col("p")).over(up), F.lit(1.0))
    k = F.coalesce(F.max(F.when(F.col("p") <= F.col("rank") * alpha / (F.col("m") * F.col("c")), F.col("rank"))).over(whole), F.lit(0))
    return r.withColumn("adjusted", adjusted).withColumn("rejected", F.col("rank") <= k).drop("m", "c")


def three_gates(row: DataFrame, alpha: float = 0.05, least_dsr: float = 0.95) -> DataFrame:
    """Adds gate_dm, gate_dsr, gate_seeds and verdict to (dm_p, dm_better, dsr, lower_bound); null fails."""
    gates = {
        "gate_dm": F.coalesce((F.col("dm_p") < alpha) & (F.col("dm_better") == "a"), F.lit(False)),
        "gate_dsr": F.coalesce(F.col("dsr") > least_dsr, F.lit(False)),
        "gate_seeds": F.coalesce(F.col("lower_bound") > 0, F.lit(False)),
    }
    return row.withColumns(gates).withColumn("verdict", F.col("gate_dm") & F.col("gate_dsr") & F.col("gate_seeds"))
