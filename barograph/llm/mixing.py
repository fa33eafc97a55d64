"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most ``epochs`` times.  The total of all sizes is shared by
weight; a source whose share is above its cap is clamped there, and what it leaves is shared by weight among the
others, until none is above.  Sorted by cap over weight, clamped sources come first, so running sums give the
level at which that process stops.  A source is taken whole as often as its target goes into its size; the rest
of the target is met by a seeded sample: documents below a threshold of a hash, which is found in a histogram of
hash buckets a source, so that a hot source is never sorted or gathered.

Only DataFrame functions run.  What is one row a source (levels and thresholds) is sent to the scan when it has at
most ``most`` rows; beyond that large sources are, of which there are few, and the others are joined by a shuffle.

Nulls and edges: null text has size 0; null is a source of its own, last; null or repeated doc_id gives a row
each, and rows equal in id and text are taken or left together.  A source of size 0 has target 0 and its rows
take 0.  An empty table gives no rows.  Columns other than doc_id, text and source are not touched; ``keep`` passes
some of them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_rows, even_join, saved, word_count

#: Hash buckets of each source's histogram.
BUCKETS = 1024


def cyclic_weights(n: int = 3):
    """Weights 1..n, repeating over sources by code point, null last."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    return lambda sources: sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("double"))


def water_fill(sources: DataFrame, epochs: float) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size, weight)."""
    caps = sources.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        caps.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("spent", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        # the level if exactly the sources before this one are clamped
        .withColumn("level", F.greatest(F.col("total") - F.col("clamped"), F.lit(0.0)) / (F.col("weights") - F.col("spent")))
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(whole))
    )
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _uniform(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def mix(docs: DataFrame, weigh, epochs: float = 3, seed: int = 20261126, most: int = 10_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    weigh: adds ``weight`` to a table of one row a source.  keep: columns of ``docs`` that come before ``size`` as they
    are, instead of doc_id and source.
    """
    sized = docs.select(
        *([F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)] or [F.col("doc_id").cast("long").alias("doc_id")]),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.pmod(_uniform(seed, "doc_id", "text"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    whole = sized
    sized = saved(sized.select("source", "size", "bucket") if keep else sized, "sized")
    histogram = saved(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "histogram")
    plan = water_fill(weigh(histogram.groupBy("source").agg(F.sum("words").alias("source_size"))), epochs)
    rows_of = histogram.groupBy(F.col("source").alias("s")).agg(F.sum("rows").alias("many"))
    plan = plan.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    plan = saved(plan.withColumn("whole", F.floor("ratio")).withColumn("rest", (F.col("ratio") - F.col("whole")) * F.col("source_size")), "plan")
    # buckets in turn until the rest is met; the bucket that crosses it is taken if that comes nearer
    by = Window.partitionBy("source").orderBy("bucket")
    upto = F.sum("words").over(by)
    cut = histogram.withColumn("upto", upto).join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
    cut = cut.where(F.col("upto") - F.col("words") / 2 <= F.col("rest")).groupBy("source").agg(F.max("bucket").alias("last"))
    plan = plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit(-1)).alias("last"))
    rows = bounded_rows(plan, most)
    out = whole if keep else sized
    if rows is not None:
        plan = F.broadcast(docs.sparkSession.createDataFrame(rows, plan.schema)).withColumnRenamed("source", "s")
        out = out.join(plan, F.col("source").eqNullSafe(F.col("s")))
    else:
        plan = plan.join(rows_of, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # a null source gets a name of its own for the join
        named = lambda df: df.withColumns({"null": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
        plan = saved(named(plan).drop("source"), "sources")
        out = even_join(named(out), plan, ["null", "name"], plan.agg(F.sum("many")).first()[0] or 0)
    copies = F.col("whole") + F.when((F.col("bucket") <= F.col("last")) & (F.col("whole") < F.lit(epochs)), 1).otherwise(0)
    first = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)] or [F.col("doc_id"), F.col("source")]
    return out.select(*first, "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"))
