"""Walk-forward backtests without row loops: folds, target weights, gross returns, drift and trades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import costs, metrics, panel, stats


def folds(spark: SparkSession, start: str, end: str, train_years: float = 4, test_years: float = 1, step_years: float = 1, embargo_days: int = 0) -> DataFrame:
    """fold, train_start, train_end, test_start, test_end; tests begin ``embargo_days`` after training ends."""
    train, test, step = (int(y * 365.25) for y in (train_years, test_years, step_years))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    ids = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.datediff(e, s) - train - 1) / step).cast("int"), F.lit(-1)) + 1)).alias("fold"))
    f = ids.select("fold", F.date_add(s, F.col("fold") * step).alias("train_start"), F.date_add(s, F.col("fold") * step + train).alias("train_end"))
    f = f.where(F.col("train_end") < e)
    return f.withColumn("test_start", F.date_add("train_end", embargo_days)).withColumn("test_end", F.least(F.date_add("train_end", test), e))


def assign_folds(rows: DataFrame, folds_: DataFrame) -> DataFrame:
    """Rows with the folds whose test interval [start, end) holds their date."""
    return rows.join(F.broadcast(folds_), (F.col("date") >= F.col("test_start")) & (F.col("date") < F.col("test_end")))


def equal_weight(n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda p: p.withColumn("w", F.lit(1.0 / n))


def top_k(p: DataFrame, score: str, k: int) -> DataFrame:
    """w = 1/k for the k best positive scores of a date, ties to the smaller ticker; the rest is cash."""
    r = F.row_number().over(Window.partitionBy("date").orderBy(F.desc_nulls_last(score), "ticker"))
    return p.withColumn("w", F.when((r <= k) & (F.col(score) > 0), 1.0 / k).otherwise(0.0))


def momentum(n: int, lookback: int = 60, k: int = 2) -> Callable[[DataFrame], DataFrame]:
    """Best past returns; equal weights as long as the history is too short."""

    def weigh(p: DataFrame) -> DataFrame:
        q = p.withColumn("score", panel.simple_return("close", panel.by("ticker"), lookback))
        return top_k(q, "score", k).withColumn("w", F.when(F.col("t") < lookback, 1.0 / n).otherwise(F.col("w"))).drop("score")

    return weigh


def oracle(k: int = 1) -> Callable[[DataFrame], DataFrame]:
    """Sees the next open-to-open return: a planted leak that any honest walk must reward."""

    def weigh(p: DataFrame) -> DataFrame:
        w = panel.by("ticker")
        return top_k(p.withColumn("score", F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1), "score", k).drop("score")

    return weigh


def random_softmax(seed: int, max_gross: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """Softmax of hashed normals with a cash slot; the same (date, ticker) has the same draw anywhere."""

    def normal(*cols: str) -> Column:
        return F.sqrt(-2 * F.ln(stats.hashed(seed, 1, *cols))) * F.cos(stats.hashed(seed, 2, *cols) * 6.283185307179586)

    def weigh(p: DataFrame) -> DataFrame:
        e = p.withColumn("_e", F.exp(normal("date", "ticker")))
        return e.withColumn("w", max_gross * F.col("_e") / (F.sum("_e").over(Window.partitionBy("date")) + F.exp(normal("date")))).drop("_e")

    return weigh


def softmax_with_cash(logit: Column, *keys: str) -> Column:
    """Weights of a date's logits beside a cash slot of logit 0, shifted by the largest."""
    w = Window.partitionBy(*keys)
    top = F.greatest(F.max(logit).over(w), F.lit(0.0))
    return F.exp(logit - top) / (F.sum(F.exp(logit - top)).over(w) + F.exp(-top))


def indexed(p: DataFrame) -> DataFrame:
    """Adds t: each date's place, from 0, by a ticker's own rows."""
    return p.withColumn("t", F.row_number().over(panel.by("ticker")) - 1)


def walk(p: DataFrame, weigh: Callable[[DataFrame], DataFrame], warmup: int = 20) -> DataFrame:
    """date, ticker, t, w, r, held, dw of a strategy whose targets don't depend on what is held.

    Decision at t, entry at open t+1, exit at open t+2; held is the drifted weight of the bar before, so dw needs
    one lag instead of a loop.
    """
    w = panel.by("ticker")
    q = weigh(indexed(p)).withColumn("r", F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1).withColumn("exit_date", F.lead("date", 2).over(w))
    q = q.where((F.col("t") >= warmup) & F.col("r").isNotNull())
    q = q.withColumn("g", F.col("w") * (1 + F.col("r")))
    day = Window.partitionBy("date")
    whole = F.sum("g").over(day) + 1 - F.sum("w").over(day)
    q = q.withColumn("drifted", F.when(whole > 0, F.col("g") / whole).otherwise(F.col("g")))
    q = q.withColumn("held", F.coalesce(F.lag("drifted").over(w), F.lit(0.0)))
    return q.withColumn("dw", F.col("w") - F.col("held")).drop("g", "drifted")


def buy_and_hold_walk(p: DataFrame, n: int, warmup: int = 20) -> DataFrame:
    """As walk, for 1/n bought once: weights are shares of the running products of 1 + r."""
    w = panel.by("ticker")
    q = indexed(p).withColumn("r", F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1).withColumn("exit_date", F.lead("date", 2).over(w))
    q = q.where((F.col("t") >= warmup) & F.col("r").isNotNull())
    q = q.withColumn("c", F.coalesce(F.product(1 + F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    q = q.withColumn("w", F.col("c") / F.sum("c").over(Window.partitionBy("date")))
    return q.withColumn("held", F.when(F.col("t") == warmup, 0.0).otherwise(F.col("w"))).withColumn("dw", F.col("w") - F.col("held")).drop("c")


def buy_and_hold(warmup: int = 20) -> Callable[[DataFrame], DataFrame]:
    """1/n bought once, at the first decision: weights are shares of the running products of 1 + r; for ``walks``."""

    def weigh(p: DataFrame) -> DataFrame:
        w = panel.by("ticker")
        r = F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1
        back = w.rowsBetween(Window.unboundedPreceding, -1)
        q = p.withColumn("_r", F.when(F.col("t") >= warmup, r)).withColumn("_c", F.coalesce(F.product(1 + F.col("_r")).over(back), F.lit(1.0)))
        return q.withColumn("w", F.col("_c") / F.sum("_c").over(Window.partitionBy("date"))).drop("_r", "_c")

    return weigh


def walks(p: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], warmup: int = 20, *carry: str) -> DataFrame:
    """strategy, date, exit_date, ticker, w, r, held, dw and ``carry`` of several strategies in one pass over the panel.

    Every strategy adds its weights as a column; rows are stacked then, so the panel is read and sorted once.  As in
    ``walk``, targets don't depend on what is held, but for those that never trade again.
    """
    w = panel.by("ticker")
    q = indexed(p)
    for name, weigh in strategies.items():
        q = weigh(q).withColumnRenamed("w", f"w_{name}")
    q = q.withColumn("r", F.lead("open", 2).over(w) / F.lead("open", 1).over(w) - 1).withColumn("exit_date", F.lead("date", 2).over(w))
    q = q.where((F.col("t") >= warmup) & F.col("r").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"w_{n}").alias("w")) for n in strategies]))
    q = q.select(each.alias("s"), "date", "exit_date", "ticker", "r", *carry).select("s.*", "date", "exit_date", "ticker", "r", *carry)
    day = Window.partitionBy("strategy", "date")
    whole = F.sum(F.col("w") * (1 + F.col("r"))).over(day) + 1 - F.sum("w").over(day)
    q = q.withColumn("_after", F.when(whole > 0, F.col("w") * (1 + F.col("r")) / whole).otherwise(F.col("w") * (1 + F.col("r"))))
    own = panel.by("strategy", "ticker")
    return q.withColumn("held", F.coalesce(F.lag("_after").over(own), F.lit(0.0))).withColumn("dw", F.col("w") - F.col("held")).drop("_after")


def evaluate(legs: DataFrame, start: float = 1e6) -> DataFrame:
    """strategy, level and the summary of its net returns, with turnover and total_cost_bps, at every cost level.

    legs: strategy, exit_date, ticker, w, r, dw, adv, vol.  turnover: mean over dates of half the absolute trades.
    """
    rets = costs.books(legs, start, "strategy").withColumnRenamed("net", "ret")
    return metrics.summary(rets, "strategy", "level", turnover=F.avg("half"), total_cost_bps=F.sum(F.col("gross") - F.col("ret")) * 1e4)


def record(ledger, table: DataFrame, warmup: int, note: str = "") -> list[dict]:
    """One trial of each strategy of ``evaluate`` (their number is the caller's) appended to a ledger, with its Sharpe ratios by level."""
    out: dict[str, dict] = {}
    for r in table.select("strategy", "level", "sharpe").orderBy("strategy", "level").collect():
        out.setdefault(r.strategy, {})[r.level] = r.sharpe
    return [ledger.append("evaluation", {"strategy": s, "warmup": warmup, "levels": sorted(v)}, v, note) for s, v in out.items()]


def gross(walked: DataFrame, *keys: str) -> DataFrame:
    return walked.groupBy(*keys, F.col("exit_date").alias("date")).agg(F.sum(F.col("w") * F.col("r")).alias("gross"))


def checked(weights: DataFrame, *keys: str) -> DataFrame:
    """The weights, or an error where one is below 0 or a date's sum above 1 (by more than 1e-9)."""
    s = F.sum("w").over(Window.partitionBy(*keys, "date"))
    return weights.withColumn("w", F.when((F.col("w") < -1e-9) | (s > 1 + 1e-9), F.raise_error("weights out of range").cast("double")).otherwise(F.col("w")))


def equal_weight_index(px: DataFrame, rebalance: str | None = None) -> DataFrame:
    """date, ret of an equally weighted basket: None (bought once), "D" (daily), "ME"/"QE" (after a period's last session).

    A basket drifts by running products within an epoch; a mark takes effect on the next bar, so the epoch of a bar is
    the number of marks before it.
    """
    w = panel.by("ticker")
    q = px.withColumn("r", panel.simple_return("close", w)).where("r is not null")
    if rebalance == "D":
        return q.groupBy("date").agg(F.avg("r").alias("ret"))
    if rebalance is None:
        q = q.withColumn("epoch", F.lit(0))
    else:
        period = F.date_trunc("month" if rebalance == "ME" else "quarter", "date")
        q = q.withColumn("epoch", F.dense_rank().over(Window.partitionBy("ticker").orderBy(period)))
    e = Window.partitionBy("ticker", "epoch").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    q = q.withColumn("c", F.coalesce(F.product(1 + F.col("r")).over(e), F.lit(1.0)))
    return q.groupBy("date").agg((F.sum(F.col("c") * F.col("r")) / F.sum("c")).alias("ret"))


def weight_path(px: DataFrame) -> DataFrame:
    """date, ticker, w before each return of a basket bought once."""
    w = panel.by("ticker")
    q = px.withColumn("r", panel.simple_return("close", w)).where("r is not null")
    q = q.withColumn("c", F.coalesce(F.product(1 + F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0)))
    return q.select("date", "ticker", (F.col("c") / F.sum("c").over(Window.partitionBy("date"))).alias("w"))
