"""Session settings and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "barograph", **conf: str) -> SparkSession:
    """A session with the settings that all operators assume: UTC, ANSI arithmetic, adaptive execution."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table; columns without a time zone are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df
