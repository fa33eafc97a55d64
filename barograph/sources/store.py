"""The append-only bitemporal store, its manifest, and provider connectors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..schema import ACTIONS, BARS, RAW, SPLIT_ADJUSTED


def new_ingest_id() -> str:
    return uuid.uuid4().hex[:12]


class Store:
    """Bars by ticker and year, actions by ticker; a re-ingest adds files and overwrites none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write_bars(self, df: DataFrame, provider: str, ingest_id: str, recorded_at, price_basis: str = SPLIT_ADJUSTED) -> None:
        """df: ticker, date, open, high, low, close, volume."""
        out = df.select(
            "ticker", F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
            F.lit(provider).alias("provider"), temporal.bar_public_at(F.col("date")).alias("first_public_at"), F.lit(recorded_at).cast("timestamp").alias("recorded_at"),
            F.lit(ingest_id).alias("ingest_id"), F.lit(price_basis).alias("price_basis"), F.year("date").alias("year"),
        )
        # one file a (ticker, year) and write
        out.repartition("ticker", "year").write.mode("append").partitionBy("ticker", "year").parquet(f"{self.root}/bars")

    def write_actions(self, df: DataFrame, provider: str, ingest_id: str, recorded_at) -> None:
        """df: ticker, ex_date, kind, value."""
        out = df.select(
            "ticker", F.col("ex_date").cast("date").alias("ex_date"), "kind", F.col("value").cast("double").alias("value"), F.lit(provider).alias("provider"),
            temporal.action_public_at(F.col("ex_date")).alias("first_public_at"), F.lit(recorded_at).cast("timestamp").alias("recorded_at"), F.lit(ingest_id).alias("ingest_id"),
        )
        out.repartition("ticker").write.mode("append").partitionBy("ticker").parquet(f"{self.root}/actions")

    def _read(self, kind: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.root}/{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ddl)

    def raw_bars(self) -> DataFrame:
        return self._read("bars", BARS)

    def raw_actions(self) -> DataFrame:
        return self._read("actions", ACTIONS)

    def bars(self, start=None, end=None, **how) -> DataFrame:
        """Bitemporal read; a date range also prunes the years' folders."""
        df = self.raw_bars()
        if start is not None:
            df = df.where((F.col("year") >= F.year(F.lit(start).cast("date"))) & (F.col("date") >= F.lit(start).cast("date")))
        if end is not None:
            df = df.where((F.col("year") <= F.year(F.lit(end).cast("date"))) & (F.col("date") <= F.lit(end).cast("date")))
        return temporal.bars(df.drop("year"), **how)

    def actions(self, **how) -> DataFrame:
        return temporal.actions(self.raw_actions(), **how)

    def views(self) -> None:
        """The raw tables, without deduplication or clocks, for SQL."""
        self.raw_bars().createOrReplaceTempView("bars")
        self.raw_actions().createOrReplaceTempView("actions")

    def checksums(self) -> DataFrame:
        """path, bytes, sha256 of every file."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.root)
        return files.select(F.regexp_extract("path", "((?:bars|actions)/.*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def manifest(self, gates: DataFrame | None = None) -> dict:
        """Checksums and counts by file, and the gates' rows; its size is that of the list of files."""
        files = {r["path"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in self.checksums().orderBy("path").toLocalIterator()}
        return {"files": files, "n_files": len(files), "total_bytes": sum(f["bytes"] for f in files.values()), "gates": [r.asDict() for r in gates.collect()] if gates is not None else []}

    def payload_digest(self) -> DataFrame:
        """One row: the SHA-256 of all files' paths and checksums in the order of the paths."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["path"], x["sha256"]))
        return self.checksums().agg(F.sha2(F.concat_ws("", parts), 256).alias("digest"))

    def write_manifest(self, path: str, gates: DataFrame | None = None) -> dict:
        """The manifest as one JSON file with sorted keys, wherever Spark can write."""
        found = self.manifest(gates)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        out = place.getFileSystem(conf).create(place, True)
        try:
            out.write(json.dumps(found, sort_keys=True, indent=1, default=str).encode())
        finally:
            out.close()
        return found


def unpivot_actions(raw: DataFrame) -> DataFrame:
    """ticker, ex_date, kind, value from a provider's wide rows (ticker, date, dividend, split); zeros are no actions."""
    long = raw.unpivot(["ticker", "date"], ["dividend", "split"], "kind", "value")
    return long.where("value is not null and value <> 0").withColumnRenamed("date", "ex_date")


class Registry:
    """Providers in the order of their priority."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[Callable[[], bool], type]] = {}

    def add(self, name: str, source: type, available: Callable[[], bool] = lambda: True) -> None:
        self.known[name] = (available, source)

    def available(self) -> list[str]:
        return [n for n, (ok, _) in self.known.items() if ok()]

    def get(self, name: str) -> type:
        return self.known[name][1]


def ingest(store: Store, scans: dict[str, tuple[DataFrame, DataFrame]], tickers: list[str], ingest_id: str, recorded_at, raw: tuple[str, ...] = ()) -> DataFrame:
    """Store what each provider's scans of bars and actions (with an ``error`` column, see ``connectors``) give for all tickers.

    One scan a provider and table, a partition a ticker.  The ledger has a row for each (provider, ticker), also where
    nothing came or it failed: provider, ticker, ok, n_bars, n_actions, error.  raw: providers whose prices are as traded.
    """
    spark, ledger = store.spark, None
    wanted = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    for provider, (bars, acts) in scans.items():
        bars, acts = bars.persist(), acts.persist()
        try:
            store.write_bars(bars.where("error is null").drop("error"), provider, ingest_id, recorded_at, RAW if provider in raw else SPLIT_ADJUSTED)
            store.write_actions(acts.where("error is null").drop("error"), provider, ingest_id, recorded_at)
            b = bars.groupBy("ticker").agg(F.count("date").alias("n_bars"), F.max("error").alias("e"))
            a = acts.groupBy("ticker").agg(F.count("ex_date").alias("n_actions"), F.max("error").alias("f"))
            rows = wanted.join(b, "ticker", "left").join(a, "ticker", "left")
            error = F.coalesce("e", "f", F.when(F.col("n_bars").isNull(), F.lit("no rows")), F.lit(""))
            rows = rows.select(F.lit(provider).alias("provider"), "ticker", (error == "").alias("ok"), F.coalesce("n_bars", F.lit(0)).alias("n_bars"), F.coalesce("n_actions", F.lit(0)).alias("n_actions"), error.alias("error")).collect()
        finally:
            bars.unpersist()
            acts.unpersist()
        ledger = (ledger or []) + rows
    return spark.createDataFrame(ledger or [], "provider string, ticker string, ok boolean, n_bars long, n_actions long, error string")
