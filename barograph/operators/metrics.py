"""Performance metrics as aggregates over long return streams (keys, date, ret)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import panel

# Passive Sharpe ratios published for one sample, of baskets and of single names, and their tolerance.
PASSIVE_BAR = {"SPY_buy_and_hold": 0.823, "EW5_buy_and_hold": 1.201, "EW5_daily_rebalanced": 1.234, "EW5_monthly_rebalanced": 1.238}
SINGLE_NAME = {"NVDA": 1.328, "TSLA": 0.768, "AAPL": 0.925, "META": 0.671, "XOM": 0.472}
TOLERANCE = 0.005


def against_bar(sharpes: DataFrame, bar: dict[str, float] = PASSIVE_BAR, tolerance: float = TOLERANCE) -> DataFrame:
    """series, bar, sharpe, agrees: recomputed ratios (series, sharpe) beside a bar; a series that is absent doesn't agree."""
    wanted = sharpes.sparkSession.createDataFrame(sorted(bar.items()), "series string, bar double")
    agrees = F.coalesce(F.abs(F.col("sharpe") - F.col("bar")) <= tolerance, F.lit(False))
    return wanted.join(sharpes.select("series", "sharpe"), "series", "left").withColumn("agrees", agrees)


def sharpe(ret: str, rf: float = 0.0, periods: int = 252) -> Column:
    """Annual Sharpe ratio, sample deviation, annual risk-free rate; null for fewer than 2 values or no variation."""
    r = F.col(ret)
    return F.avg(r - rf / periods) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def population_sharpe(ret: str, rf: float = 0.0, periods: int = 1) -> Column:
    """Sharpe ratio by population deviation and a risk-free rate per period."""
    return (F.avg(ret) - rf) / F.nullif(F.stddev_pop(ret), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))


def sortino(ret: str, rf: float = 0.0, periods: int = 252) -> Column:
    x = F.col(ret) - rf / periods
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    return F.when(F.count_if(x < 0) >= 2, F.avg(x) / F.nullif(down, F.lit(0.0)) * F.sqrt(F.lit(float(periods))))


def summary(rets: DataFrame, *keys: str, rf: float = 0.0, periods: int = 252, **more: Column) -> DataFrame:
    """n, sharpe, sortino, cagr, mdd, calmar, total_return, vol_annual, rf, periods of each key's stream; ``more`` aggregates by name."""
    w = panel.by(*keys) if keys else Window.partitionBy(F.lit(0)).orderBy("date")
    e = rets.where("ret is not null").withColumn("equity", panel.equity("ret", w))
    e = e.withColumn("dd", F.col("equity") / panel.running_max("equity", w) - 1)
    first, last, years = F.min_by("equity", "date"), F.max_by("equity", "date"), (F.count("*") - 1) / periods
    s = e.groupBy(*keys).agg(
        F.count("*").alias("n"),
        sharpe("ret", rf, periods).alias("sharpe"),
        sortino("ret", rf, periods).alias("sortino"),
        F.when((years > 0) & (first > 0), F.pow(last / first, 1 / F.nullif(years, F.lit(0.0))) - 1).alias("cagr"),
        F.min("dd").alias("mdd"),
        (last - 1).alias("total_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))).alias("vol_annual"),
        F.lit(float(rf)).alias("rf"),
        F.lit(periods).alias("periods"),
        *(c.alias(n) for n, c in more.items()),
    )
    return s.withColumn("calmar", F.when(F.col("mdd") < 0, F.col("cagr") / F.abs("mdd")))


def turnover(weights: DataFrame, *keys: str) -> DataFrame:
    """Mean over dates of half the absolute weight changes; null for fewer than two dates."""
    d = weights.withColumn("dw", F.abs(F.col("w") - F.lag("w").over(panel.by(*keys, "ticker"))))
    day = d.where("dw is not null").groupBy(*keys, "date").agg((F.sum("dw") / 2).alias("t"))
    return day.groupBy(*keys).agg(F.avg("t").alias("turnover"))


def adjusted_moments(ret: str) -> tuple[Column, Column]:
    """Bias-adjusted skewness and excess kurtosis."""
    n = F.count(ret).cast("double")
    skew = F.when(n > 2, F.skewness(ret) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when(n > 3, ((n + 1) * F.kurtosis(ret) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)))
    return skew, kurt
