import datetime as dt
import time

from pyspark.sql import functions as F

from barograph.sources.store import Store
from barograph.streaming import pump


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_and_dedup(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    whole = spark.read.parquet(src)
    path = f"{tmp_path}/events"
    whole.repartition(1).write.parquet(path)
    assert run(spark, pump.once(pump.events(spark, path)), "once").count() == whole.select("event_id").distinct().count()
    assert run(spark, pump.tumbling(pump.events(spark, path)), "tumbling", "complete").groupBy().sum("n").first()[0] == whole.count()


def test_running_book(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", "ab"[i % 2], 0.01) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, ret double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "ret")
    df.repartition(1).write.parquet(f"{tmp_path}/r")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/r")
    got = {r.event_type: (r.n, round(r.value, 6)) for r in run(spark, pump.running_book(s), "book", "update").collect()}
    assert got == {"a": (3, 1.030301), "b": (3, 1.030301)}


def test_frames_sliding_and_sessions_equal_batches(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = f"{tmp_path}/events"
    whole.write.parquet(path)
    kept = lambda df: sorted(map(str, df.collect()))
    frame = run(spark, pump.frames(pump.events(spark, path, 100), "1 hour"), "frames", "complete")
    want = whole.groupBy(F.window("ts", "1 hour").alias("frame"), "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))
    assert kept(frame) == kept(want)
    slide = run(spark, pump.sliding(pump.events(spark, path, 100)), "sliding", "complete")
    assert slide.groupBy().sum("n").first()[0] == 4 * whole.count()
    sessions = run(spark, pump.per_session(pump.events(spark, path, 100), "12 hours"), "sessions", "complete")
    assert kept(sessions) == kept(whole.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")))


def test_late_rows_are_left_out(spark, tmp_path):
    for i, (day, n) in enumerate((("2024-01-01", 3), ("2024-01-20", 2), ("2024-01-21", 1), ("2024-01-02", 5), ("2024-02-20", 1), ("2024-02-20", 1))):
        rows = spark.range(n).selectExpr(f"id + {i * 10} as event_id", f"timestamp_ntz'{day} 00:00:00' as ts", "id as user_id", "'a' as event_type", "1.0 as value", "'' as props")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
        time.sleep(1.1)  # files come in the order of their times
    got = run(spark, pump.tumbling(pump.events(spark, f"{tmp_path}/late")), "late").collect()
    # what is two days behind the newest row of the batches before comes too late; the last window is still open
    assert sorted((str(r.w.start.date()), r.n) for r in got) == [("2024-01-01", 3), ("2024-01-20", 2), ("2024-01-21", 1)]


def test_stream_appends_to_the_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    bar = lambda close: spark.createDataFrame([("X", dt.date(2024, 1, 2), 1.0, 1.0, 1.0, close, 5.0)], "ticker string, date date, open double, high double, low double, close double, volume double")
    for close in (2.0, 3.0):
        bar(close).coalesce(1).write.mode("append").parquet(f"{tmp_path}/bars")
        stream = spark.readStream.schema(bar(0.0).schema).parquet(f"{tmp_path}/bars")
        pump.append_bars(stream, store, "live", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert store.raw_bars().count() == 2 and [r.close for r in store.bars(ticker="X").collect()] == [3.0]
