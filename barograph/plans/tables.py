"""Market tables derived from the driver's tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..schema import SPLIT_ADJUSTED
from ..session import table

PRICES = ("open", "high", "low", "close")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, open .. volume: daily bars of each event type; a dense panel of five tickers."""
    e = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"))


EVENT_BARS = """bars AS (
  SELECT event_type AS ticker, CAST(ts AS DATE) AS date, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
    last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: two tickers' providers, two vintages (a partial one a day later, a whole one 30 days later)."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.col("l_linestatus").alias("provider"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    both = li.withColumn("v", F.explode(F.when(F.col("l_linenumber") <= 4, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "price")
    b = both.groupBy("ticker", "provider", "date", "v").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("l_quantity").alias("volume"))
    late = F.when(F.col("v") == 1, 1).otherwise(30)
    return b.select("ticker", "date", *PRICES, "volume", "provider", temporal.bar_public_at(F.col("date")).alias("first_public_at"), F.date_add("date", late).cast("timestamp").alias("recorded_at"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("ingest_id"), F.lit(SPLIT_ADJUSTED).alias("price_basis"))


LINE_BARS = """lines AS (
  SELECT l_returnflag AS ticker, l_linestatus AS provider, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity,
    l_orderkey, l_linenumber, l_partkey FROM lineitem),
vintages AS (SELECT *, 1 AS v FROM lines WHERE l_linenumber <= 4 UNION ALL SELECT *, 2 AS v FROM lines),
store AS (
  SELECT ticker, date, provider, v, date + CASE WHEN v = 1 THEN 1 ELSE 30 END AS recorded,
    first(price ORDER BY l_orderkey, l_linenumber, l_partkey, price) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY l_orderkey, l_linenumber, l_partkey, price) AS close, sum(l_quantity) AS volume
  FROM vintages GROUP BY ticker, date, provider, v)"""


def one_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last vintage of each ticker's first provider by name, one bar a (ticker, date)."""
    b = temporal.bars(line_bars(spark, sf_dir))
    return b.groupBy("ticker", "date").agg(F.min_by(F.struct(*[c for c in b.columns if c not in ("ticker", "date")]), "provider").alias("r")).select("ticker", "date", "r.*")


ONE_BAR = LINE_BARS + """,
last_store AS (SELECT * FROM store QUALIFY row_number() OVER (PARTITION BY ticker, date, provider ORDER BY recorded DESC, v DESC) = 1),
one AS (SELECT * FROM last_store QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY provider) = 1)"""


def line_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On each ticker's first bar of a year: a split of 2 in years divisible by 3, else a dividend of 1 % of the low."""
    b = one_bar(spark, sf_dir)
    f = b.groupBy("ticker", F.year("date").alias("y")).agg(F.min("date").alias("ex_date"), F.min_by("low", "date").alias("low"))
    split = F.col("y") % 3 == 0
    day = F.col("ex_date")
    return f.select("ticker", "ex_date", F.when(split, "split").otherwise("dividend").alias("kind"), F.when(split, 2.0).otherwise(F.col("low") / 100).alias("value"), F.lit("derived").alias("provider"), temporal.action_public_at(day).alias("first_public_at"), F.date_add(day, 1).cast("timestamp").alias("recorded_at"), F.lit("a1").alias("ingest_id"))


ACTIONS = ONE_BAR + """,
firsts AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY ticker, year(date) ORDER BY date) = 1),
acts AS (SELECT ticker, date AS ex_date, CASE WHEN year(date) % 3 = 0 THEN 'split' ELSE 'dividend' END AS kind,
  CASE WHEN year(date) % 3 = 0 THEN 2.0 ELSE low / 100 END AS value FROM firsts)"""


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, ret of the event bars, without each ticker's first date."""
    from ..operators import panel

    return event_bars(spark, sf_dir).select("ticker", "date", panel.simple_return("close", panel.by("ticker")).alias("ret")).where("ret is not null")


RETURNS = EVENT_BARS + """,
rets AS (SELECT * FROM (SELECT ticker, date, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret FROM bars) WHERE ret IS NOT NULL)"""
