"""Comparison of two sources, printed prices, digests of content; the gates themselves are in ``gates``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ceilings of a reconciliation in basis points, and of the share beyond one of them.
CEILINGS = {"median_bps": 1.0, "p95_bps": 5.0, "max_bps": 25.0, "frac_over_1bp": 0.15}
# Closes that were printed before and on the ex-dates of three splits.
PRINTED = [
    ("NVDA", "2024-06-07", 1208.88),
    ("TSLA", "2022-08-24", 891.29),
    ("AAPL", "2020-08-28", 499.23),
    ("NVDA", "2024-06-10", 121.79),
    ("TSLA", "2022-08-25", 296.07),
    ("AAPL", "2020-08-31", 129.04),
]
# Shares of identical values from which sources count as dependent.
MIRROR, PARTIAL = 0.999, 0.9


def compare(a: DataFrame, b: DataFrame, col: str = "close", *keys: str) -> DataFrame:
    """keys, date, both values and their divergence in basis points; null where the second is 0."""
    x = a.select(*keys, "date", F.col(col).alias("value_a"))
    y = b.select(*keys, "date", F.col(col).alias("value_b"))
    return x.join(y, [*keys, "date"]).withColumn("bps", (F.col("value_a") - F.col("value_b")) / F.nullif(F.abs("value_b"), F.lit(0.0)) * 10000)


def divergence(pairs: DataFrame, *keys: str) -> DataFrame:
    d = F.abs("bps")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.percentile(d, F.lit(0.5)).alias("median_bps"),
        F.percentile(d, F.lit(0.95)).alias("p95_bps"),
        F.max(d).alias("max_bps"),
        F.count_if(d > 1).alias("n_over_1bp"),
        (F.count_if(d == 0) / F.count("*")).alias("frac_identical"),
        F.max_by("date", F.struct(d, -F.unix_date("date"))).alias("worst_date"),
        F.count_if(F.col("bps").isNull()).alias("n_null"),
    )


def independence(share: Column) -> Column:
    return F.when(share.isNull(), "UNKNOWN").when(share > MIRROR, "MIRROR_SUSPECTED").when(share > PARTIAL, "PARTIALLY_DEPENDENT").otherwise("INDEPENDENT_LIKELY")


def scored(stats: DataFrame) -> DataFrame:
    """Adds breaches (names) and passed; a row at a ceiling passes, and one without usable values doesn't."""
    s = stats.withColumn("frac_over_1bp", F.col("n_over_1bp") / F.nullif("n", F.lit(0)))
    breach = F.array_compact(F.array(*[F.when(F.col(c) > v, F.lit(c)) for c, v in CEILINGS.items()], F.when(F.col("median_bps").isNull(), F.lit("no usable rows"))))
    return s.withColumn("breaches", breach).withColumn("passed", F.size("breaches") == 0)


def printed_prices(traded: DataFrame, anchors: DataFrame, most_bps: float = 25.0) -> DataFrame:
    """anchors (ticker, date, printed) with the as-traded close and whether it agrees; an absent bar doesn't."""
    out = F.broadcast(anchors).join(traded.select("ticker", "date", "traded_close"), ["ticker", "date"], "left")
    bps = F.abs(F.col("traded_close") / F.col("printed") - 1) * 10000
    return out.withColumn("bps", bps).withColumn("passed", F.coalesce(bps <= most_bps, F.lit(False)))


def content_digest(df: DataFrame, *cols: str) -> DataFrame:
    """One row: number of rows, and a sum and an exclusive-or of their digests, whatever the order and the files.

    A row's digest is the first 60 bits of the MD5 of its values as text: doubles as whole millionths, null as \\N.
    """
    kinds = dict(df.dtypes)
    shown = [F.floor(F.col(c) * 1e6 + 0.5).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in cols]
    text = F.concat_ws("|", *[F.coalesce(x, F.lit("\\N")) for x in shown])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("xor"))
