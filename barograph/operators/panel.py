"""Time-series columns over long panels (date, ticker, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(*keys: str, order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def simple_return(x: str, w, lag: int = 1) -> Column:
    return F.col(x) / F.nullif(F.lag(x, lag).over(w), F.lit(0.0)) - 1


def log_return(x: str, w) -> Column:
    return F.ln(x) - F.lag(F.ln(x)).over(w)


def rolling(agg: Column, x: str, w, n: int, least: int) -> Column:
    """An aggregate over the n rows before the current one, null with fewer than ``least`` values."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def liquidity(panel: DataFrame, n: int = 20, least: int = 5) -> DataFrame:
    """Adds ret, adv (median traded value) and vol (deviation of returns), both of the rows before."""
    w = by("ticker")
    out = panel.withColumn("ret", simple_return("adj_close", w)).withColumn("value", F.col("traded_close") * F.col("traded_volume"))
    return out.withColumn("adv", rolling(F.percentile("value", F.lit(0.5)), "value", w, n, least)).withColumn("vol", rolling(F.stddev_samp("ret"), "ret", w, n, least))


def complete_dates(panel: DataFrame, tickers: int, *cols: str) -> DataFrame:
    """Dates on which all tickers have all columns."""
    ok = F.count_if(F.expr(" and ".join(f"{c} is not null" for c in cols)))
    return panel.groupBy("date").agg(ok.alias("n")).where(F.col("n") == tickers).select("date")


def total_return_panel(tape: DataFrame, tickers: DataFrame, start, end) -> DataFrame:
    """date, ticker, open, close, traded_close, traded_volume of a tape: prices times their dividend factor, from start to end.

    Every date that one ticker has all must have; a wanted ticker without rows, or a date without a ticker, is an error.
    """
    day = F.col("date")
    rows = tape.join(F.broadcast(tickers), "ticker", "left_semi").where((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))
    rows = rows.select("date", "ticker", F.col("adj_open").alias("open"), F.col("adj_close").alias("close"), "traded_close", "traded_volume")
    wanted = tickers.agg(F.count_distinct("ticker").alias("wanted"))
    checked = rows.crossJoin(F.broadcast(wanted)).withColumn("n", F.count("close").over(Window.partitionBy("date")))
    bad = F.raise_error(F.concat(F.lit("a ticker is missing on "), day.cast("string"))).cast("double")
    return checked.withColumn("close", F.when(F.col("n") != F.col("wanted"), bad).otherwise(F.col("close"))).drop("n", "wanted")


def reindexed(rows: DataFrame, index: DataFrame, tickers: DataFrame) -> DataFrame:
    """One row a date of ``index`` and ticker; null where ``rows`` (date, ticker, ..) have none."""
    names = tickers.agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    grid = index.select("date").distinct().crossJoin(F.broadcast(names)).select("date", F.explode("names").alias("ticker"))
    return grid.join(rows, ["date", "ticker"], "left")


def split(rows: DataFrame, train_end, test_start) -> tuple[DataFrame, DataFrame]:
    """Rows up to the end of training, and from the start of the test on."""
    return rows.where(F.col("date") <= F.lit(train_end).cast("date")), rows.where(F.col("date") >= F.lit(test_start).cast("date"))


def aligned(panel: DataFrame, tickers: int, *cols: str) -> DataFrame:
    """The panel, or an error if a date lacks a ticker's value: an outer alignment in long form."""
    n = F.count(F.struct(*cols)).over(Window.partitionBy("date"))
    return panel.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == tickers)).where("_ok is null").drop("_n", "_ok")


def equity(ret: str, w, start: float = 1.0) -> Column:
    return F.lit(start) * F.product(1 + F.col(ret)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def normalised(x: str, w) -> Column:
    """A value over the first of its window."""
    return F.col(x) / F.nullif(F.first(x).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def running_max(x: str, w) -> Column:
    return F.max(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def feature_windows(panel: DataFrame, n: int) -> DataFrame:
    """date, features: the last n dates' returns, flattened in the order of (date, ticker)."""
    day = panel.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(F.struct("ticker", "ret"))), lambda s: s["ret"]).alias("rets"))
    # one row a date: the frame is over dates, not over the panel
    frame = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-n, -1)
    return day.withColumn("features", F.flatten(F.collect_list("rets").over(frame))).withColumn("n", F.count("*").over(frame)).where(F.col("n") == n).select("date", "features")
