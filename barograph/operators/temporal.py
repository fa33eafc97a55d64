"""Public-time stamps, two-clock visibility, latest-wins reads and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ACTION_TIME, BAR_TIME, ZONE


def public_at(day: Column, clock: str) -> Column:
    """A New York wall-clock time on a day, as an instant."""
    return F.to_utc_timestamp(F.concat_ws(" ", day.cast("date").cast("string"), F.lit(clock)).cast("timestamp"), ZONE)


def bar_public_at(day: Column) -> Column:
    return public_at(day, BAR_TIME)


def action_public_at(day: Column) -> Column:
    return public_at(day, ACTION_TIME)


def visible(df: DataFrame, as_of=None, recorded_before=None, strict: bool = False) -> DataFrame:
    """Rows public by ``as_of`` and recorded by ``recorded_before``; strict: recorded by ``as_of`` too."""
    if as_of is not None:
        df = df.where(F.col("first_public_at") <= F.lit(as_of).cast("timestamp"))
        if strict and recorded_before is None:
            recorded_before = as_of
    if recorded_before is not None:
        df = df.where(F.col("recorded_at") <= F.lit(recorded_before).cast("timestamp"))
    return df


def latest(df: DataFrame, *key: str) -> DataFrame:
    """The last recorded row of each key; of equal times the larger ingest id.

    A partial max_by runs before the shuffle, so that one row a key and task is moved.
    """
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("recorded_at", "ingest_id")).alias("r"))
    return picked.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in df.columns])


def bars(store: DataFrame, ticker=None, provider=None, as_of=None, recorded_before=None, strict: bool = False) -> DataFrame:
    if ticker is not None:
        store = store.where(F.col("ticker") == ticker)
    if provider is not None:
        store = store.where(F.col("provider") == provider)
    return latest(visible(store, as_of, recorded_before, strict), "ticker", "date", "provider")


def actions(store: DataFrame, ticker=None, provider=None, as_of=None, recorded_before=None) -> DataFrame:
    if ticker is not None:
        store = store.where(F.col("ticker") == ticker)
    if provider is not None:
        store = store.where(F.col("provider") == provider)
    return latest(visible(store, as_of, recorded_before), "ticker", "ex_date", "kind", "provider")


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous algorithm."""
    div = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = year % 19, div(year, F.lit(100)), year % 100
    h = (19 * a + b - div(b, F.lit(4)) - div(b - div(b + 8, F.lit(25)) + 1, F.lit(3)) + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * div(c, F.lit(4)) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * k, F.lit(451))
    n = h + k - 7 * m + 114
    return F.make_date(year, div(n, F.lit(31)), n % 31 + 1)


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """New York exchange holidays by rule: fixed days moved off weekends, nth weekdays, Good Friday; special closures as listed."""
    y = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))

    def nth(month: int, weekday: int, n: int) -> Column:
        d = F.make_date(F.col("y"), F.lit(month), F.lit(1))
        return F.date_add(d, ((F.lit(weekday) - F.weekday(d) + 7) % 7 + 7 * (n - 1)).cast("int"))

    def fixed(month: int, day: int) -> Column:
        d = F.make_date(F.col("y"), F.lit(month), F.lit(day))
        return F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)

    new_year = F.make_date(F.col("y"), F.lit(1), F.lit(1))
    may = F.make_date(F.col("y"), F.lit(5), F.lit(31))
    days = [
        F.when(F.weekday(new_year) == 6, F.date_add(new_year, 1)).when(F.weekday(new_year) < 5, new_year),
        F.when(F.col("y") >= 1998, nth(1, 0, 3)),
        nth(2, 0, 3),
        F.date_sub(easter(F.col("y")), 2),
        F.date_sub(may, F.weekday(may)),
        F.when(F.col("y") >= 2022, fixed(6, 19)),
        fixed(7, 4),
        nth(9, 0, 1),
        nth(11, 3, 4),
        fixed(12, 25),
    ]
    ruled = y.select(F.explode(F.array(*days)).alias("date")).where("date is not null")
    # Closures that no rule gives.
    special = ["2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09"]
    return ruled.unionAll(spark.createDataFrame([(d,) for d in special], "d string").select(F.col("d").cast("date").alias("date"))).distinct()


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Exchange sessions from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    off = holidays(spark, int(start[:4]), int(end[:4]))
    return days.where(F.weekday("date") < 5).join(off, "date", "left_anti")


def last_complete_session(calendar: DataFrame, now) -> DataFrame:
    """One row: the newest session whose close is not after ``now``."""
    return calendar.where(bar_public_at(F.col("date")) <= F.lit(now).cast("timestamp")).agg(F.max("date").alias("date"))


def missing_sessions(data: DataFrame, calendar: DataFrame, *keys: str, wanted: DataFrame | None = None) -> DataFrame:
    """Sessions of the calendar that a key's data lacks; ``wanted`` keys without any row lack all of them.

    Sessions are numbered; a gap lies between neighbouring numbers of a key, and before the end, so nothing is put
    out but what is missing.
    """
    numbered = calendar.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    after = numbered.agg((F.count("*") + 1).cast("int").alias("i"))
    known = data.select(*keys).distinct() if keys else after.select()
    if wanted is not None:
        known = known.unionByName(wanted.select(*keys)).distinct()
    there = data.select(*keys, "date").distinct().join(numbered, "date").select(*keys, "i")
    w = Window.partitionBy(*keys).orderBy("i")
    gaps = there.unionByName(known.crossJoin(after)).withColumn("before", F.lag("i", 1, 0).over(w)).where("i - before > 1")
    return gaps.select(*keys, F.explode(F.sequence(F.col("before") + 1, F.col("i") - 1)).alias("i")).join(numbered, "i").select(*keys, "date")


def unexpected_sessions(data: DataFrame, calendar: DataFrame, *keys: str) -> DataFrame:
    return data.select(*keys, "date").distinct().join(calendar, "date", "left_anti")


def fill_back(col: str, *by: str, order: str) -> Column:
    """The next value where there is none; it looks into the future, so it is for comparison only."""
    return F.last(col, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
