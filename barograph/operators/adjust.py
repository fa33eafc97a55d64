"""Corporate actions: split and dividend factors, as-traded and adjusted prices, the tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RAW
from . import temporal

PRICES = ("open", "high", "low", "close")


def known(acts: DataFrame, as_of=None, kind: str | None = None) -> DataFrame:
    """Actions public by ``as_of``, one a (ticker, day, kind): the smallest value of what sources report."""
    acts = temporal.visible(acts, as_of)
    if kind:
        acts = acts.where(F.col("kind") == kind)
    return acts.groupBy("ticker", "ex_date", "kind").agg(F.min("value").alias("value"))


def _reverse_product(days: DataFrame, steps: DataFrame, name: str) -> DataFrame:
    """ticker, date, name: the product of a ticker's steps (ticker, ex_date, factor) with ex_date after the date.

    Days and steps are merged into one ordered sequence and multiplied from the end; no join by range.
    """
    events = days.select("ticker", "date", F.lit(1.0).alias("f"), F.lit(1).alias("is_day")).unionAll(steps.select("ticker", F.col("ex_date").alias("date"), F.col("factor").alias("f"), F.lit(0).alias("is_day")))
    # a step of the same day comes before the day, so that it doesn't count for it
    w = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("is_day")).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(name, F.product("f").over(w)).where("is_day = 1").select("ticker", "date", name)


def split_factors(bars: DataFrame, acts: DataFrame) -> DataFrame:
    """ticker, date, unadjust_factor: ratios of all later splits; the clock has no part in it."""
    steps = known(acts, kind="split").where("value > 0").withColumnRenamed("value", "factor")
    return _reverse_product(bars.select("ticker", "date").distinct(), steps, "unadjust_factor")


def dividend_steps(bars: DataFrame, acts: DataFrame, as_of=None) -> DataFrame:
    """ticker, ex_date, value, prev_close, factor: 1 - value / last close before the day; none without such a close above 0."""
    divs = known(acts, as_of, "dividend")
    events = bars.select("ticker", F.col("date").alias("d"), F.col("close").alias("c"), F.lit(None).cast("double").alias("value")).unionAll(divs.select("ticker", F.col("ex_date").alias("d"), F.lit(None).cast("double").alias("c"), "value"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(Window.unboundedPreceding, -1)
    prev = events.withColumn("prev_close", F.last("c", ignorenulls=True).over(w)).where("value is not null and prev_close > 0")
    return prev.select("ticker", F.col("d").alias("ex_date"), "value", "prev_close", (1 - F.col("value") / F.col("prev_close")).alias("factor"))


def dividend_factors(bars: DataFrame, acts: DataFrame, as_of=None) -> DataFrame:
    """ticker, date, adj_factor: product of later dividends' steps over its value at the last bar (unless that is 0 or 1)."""
    f = _reverse_product(bars.select("ticker", "date").distinct(), dividend_steps(bars, acts, as_of), "f")
    last = f.groupBy("ticker").agg(F.max_by("f", "date").alias("last"))
    return f.join(last, "ticker").select("ticker", "date", F.when(F.col("last").isin(0.0, 1.0), F.col("f")).otherwise(F.col("f") / F.nullif("last", F.lit(0.0))).alias("adj_factor"))


def as_traded(bars: DataFrame, acts: DataFrame) -> DataFrame:
    """Adds unadjust_factor and traded_ prices and volume; rows of raw basis are as traded already."""
    out = bars.join(split_factors(bars, acts), ["ticker", "date"])
    if "price_basis" in bars.columns:
        out = out.withColumn("unadjust_factor", F.when(F.col("price_basis") == RAW, 1.0).otherwise(F.col("unadjust_factor")))
    f = F.col("unadjust_factor")
    return out.withColumns({f"traded_{c}": F.col(c) * f for c in PRICES} | {"traded_volume": F.when(f > 0, F.col("volume") / f)})


def adjusted(bars: DataFrame, acts: DataFrame, as_of=None, dividends: bool = True) -> DataFrame:
    """Adds adj_factor and adj_ prices; splits are in the stored prices already.  A row of raw basis is an error."""
    if "price_basis" in bars.columns:
        bars = bars.withColumn("close", F.when(F.col("price_basis") == RAW, F.raise_error("prices of raw basis can't be adjusted").cast("double")).otherwise(F.col("close")))
    out = bars.join(dividend_factors(bars, acts, as_of), ["ticker", "date"]) if dividends else bars.withColumn("adj_factor", F.lit(1.0))
    return out.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in PRICES})


def both_factors(bars: DataFrame, acts: DataFrame, as_of=None) -> DataFrame:
    """The bars with unadjust_factor (all splits) and adj_factor (dividends public by ``as_of``), in one pass.

    Bars and actions are one sequence a ticker: a forward window finds the close before each dividend, a backward one
    multiplies what comes later.  Nothing is joined, so bars are read and shuffled once.  ``bars`` has one row a
    (ticker, date).
    """
    names = bars.columns
    if as_of is not None:
        acts = acts.where((F.col("kind") == "split") | (F.col("first_public_at") <= F.lit(as_of).cast("timestamp")))
    steps = known(acts).where("kind = 'dividend' or kind = 'split' and value > 0").select("ticker", F.col("ex_date").alias("date"), F.struct("kind", "value").alias("_act"))
    rows = bars.withColumn("_act", F.lit(None).cast("struct<kind:string,value:double>")).unionByName(steps, allowMissingColumns=True)
    day = Window.partitionBy("ticker").orderBy(F.unix_date("date"))
    rows = rows.withColumn("_prev", F.last("close", ignorenulls=True).over(day.rangeBetween(Window.unboundedPreceding, -1)))
    value = F.col("_act.value")
    split = F.when(F.col("_act.kind") == "split", value).otherwise(1.0)
    dividend = F.when((F.col("_act.kind") == "dividend") & (F.col("_prev") > 0), 1 - value / F.col("_prev")).otherwise(1.0)
    # backwards a day's bar comes before its actions, so that only later ones count for it
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.col("_act").isNotNull())
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_split": split, "_div": dividend})
    rows = rows.withColumns({"unadjust_factor": F.product("_split").over(upto), "_f": F.product("_div").over(upto)})
    rows = rows.withColumn("_last", F.first(F.when(F.col("_act").isNull(), F.col("_f")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    adj = F.when(F.col("_last").isin(0.0, 1.0), F.col("_f")).otherwise(F.col("_f") / F.nullif("_last", F.lit(0.0)))
    return rows.where("_act is null").select(*names, "unadjust_factor", adj.alias("adj_factor"))


def taped(bars: DataFrame, acts: DataFrame, as_of=None) -> DataFrame:
    """Bars of one provider with as-traded prices (all splits) and dividend-adjusted ones (dividends known at ``as_of``)."""
    if "price_basis" in bars.columns:
        bars = bars.withColumn("close", F.when(F.col("price_basis") == RAW, F.raise_error("prices of raw basis can't be adjusted").cast("double")).otherwise(F.col("close")))
    f = F.col("unadjust_factor")
    traded = {f"traded_{c}": F.col(c) * f for c in PRICES} | {"traded_volume": F.when(f > 0, F.col("volume") / f)}
    return both_factors(bars, acts, as_of).withColumns(traded | {f"adj_{c}": F.col(c) * F.col("adj_factor") for c in PRICES})


def tape(bars_store: DataFrame, acts_store: DataFrame, ticker=None, as_of=None, provider: str | None = None) -> DataFrame:
    """The tape of the bars that are public at ``as_of``."""
    return taped(temporal.bars(bars_store, ticker, provider, as_of), temporal.actions(acts_store, ticker), as_of)
