"""Streams: windowed aggregates with watermarks, latest-value frames, deduplication, stateful folds, store appends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of the events table's files."""
    ddl = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def frames(stream: DataFrame, every: str = "50 milliseconds", late: str = "10 minutes") -> DataFrame:
    """The latest value of each node in each frame: conflation, latest wins."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("frame"), "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))


def tumbling(stream: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def per_session(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def once(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_book(stream: DataFrame, start: float = 1.0) -> DataFrame:
    """event_type, n, value: a book per key that compounds returns in event order over batches."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, start)
        for pdf in pdfs:
            pdf = pdf.sort_values(["ts", "event_id"])
            n += len(pdf)
            value *= float((1 + pdf["ret"].fillna(0.0)).prod())
        state.update((n, value))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "value": [value]})

    return stream.groupBy("event_type").applyInPandasWithState(fold, "event_type string, n long, value double", "n long, value double", "update", "NoTimeout")


def append_bars(stream: DataFrame, store: Store, provider: str, checkpoint: str):
    """Write each batch of bars (ticker, date, open .. volume) as an ingest of its own; reads see revisions by latest-wins."""

    def write(batch: DataFrame, n: int) -> None:
        store.write_bars(batch, provider, f"stream-{n:08d}", pd.Timestamp.now("UTC").to_pydatetime())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
