"""Extensions: bitemporal edges, lessons, decay, retrieval, sentiment features, robustness of seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import hashed

# Half-lives in days by class of edge.
HALF_LIVES = {"regime": 90, "feature": 20, "event": 3, "lesson": 250}


def visible_edges(edges: DataFrame, at) -> DataFrame:
    t = F.lit(at).cast("timestamp")
    return edges.where((F.col("first_public_at") <= t) & (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t)))


def superseded(edges: DataFrame, *key: str) -> DataFrame:
    """Adds superseded_at: when the key's next record came; nothing is deleted."""
    return edges.withColumn("superseded_at", F.lead("recorded_at").over(Window.partitionBy(*key).orderBy("recorded_at", "edge_id")))


def lessons(rows: DataFrame, *key: str, k: float = 20.0, least: int = 10) -> DataFrame:
    """Mean, variance and count of outcomes by key, shrunk to the overall mean; rare keys are left out."""
    prior = rows.agg(F.avg("outcome").alias("mu0"))
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.avg("outcome").alias("mu"), F.var_samp("outcome").alias("var")).where(F.col("n") >= least)
    return g.crossJoin(F.broadcast(prior)).withColumn("shrunk", (F.col("n") * F.col("mu") + k * F.col("mu0")) / (F.col("n") + k)).drop("mu0")


def lessons_by_fold(episodes: DataFrame, folds: DataFrame, *key: str, k: float = 20.0, least: int = 10) -> DataFrame:
    """fold and its lessons, rebuilt from the episodes (key, exit_at, outcome) that had ended by the end of its training.

    Folds are few; each episode is counted once a fold in one aggregation, and the means over a fold shrink it.
    """
    seen = episodes.join(F.broadcast(folds.select("fold", "train_end")), F.col("exit_at") <= F.col("train_end"))
    prior = seen.groupBy("fold").agg(F.avg("outcome").alias("mu0"))
    g = seen.groupBy("fold", *key).agg(F.count("*").alias("n"), F.avg("outcome").alias("mu"), F.var_samp("outcome").alias("var")).where(F.col("n") >= least)
    return g.join(F.broadcast(prior), "fold").withColumn("shrunk", (F.col("n") * F.col("mu") + k * F.col("mu0")) / (F.col("n") + k)).drop("mu0")


#: Queries that one search sends to all rows.
MOST_QUERIES = 4096


def similar(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """src_id, rank, dst_id, cosine: the k nearest rows of ``vectors`` (id, v) to each of a stated set of queries, themselves left out.

    The queries go to the scan, at most ``MOST_QUERIES`` at once; each task keeps k rows a query, so that all scores
    are never shuffled.  Vectors that are null or of length 0 take part in nothing.  Ties go to the smaller id.
    """
    parts = []
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = lambda df: df.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("l", length(F.col("v"))).where("l > 0").select("id", F.transform("v", lambda x: x / F.col("l")).alias("v"))
    blocks = max(1, -(-queries.count() // MOST_QUERIES))
    for b in range(blocks):
        q = unit(queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select(F.col("id").alias("src_id"), F.col("v").alias("q"))
        cos = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        scored = unit(vectors).crossJoin(F.broadcast(q)).where("id <> src_id").select("src_id", F.col("id").alias("dst_id"), cos.alias("cosine"))
        best = F.row_number().over(Window.partitionBy("src_id").orderBy(F.desc("cosine"), "dst_id"))
        parts.append(scored.withColumn("rank", best).where(F.col("rank") <= k).select("src_id", "rank", "dst_id", "cosine"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def decayed(conf: Column, days: Column, half_life: Column | float) -> Column:
    h = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return conf * F.exp(-F.ln(F.lit(2.0)) / h * days)


def pruned(index: DataFrame, at, cap: int = 50_000, least_conf: float = 0.15, least_n: int = 10, unread_days: int = 60) -> DataFrame:
    """The entries worth keeping, at most ``cap`` by confidence, recency and reads."""
    age = F.datediff(F.lit(at).cast("date"), F.col("last_read"))
    ok = index.where((F.col("conf") >= least_conf) & (F.col("n") >= least_n) & (age <= unread_days))
    return ok.withColumn("score", F.col("conf") * F.exp(-age / 30.0) * F.log1p("reads")).orderBy(F.desc("score"), "id").limit(cap)


def claim_quarantine(claims: DataFrame, most_conf: float = 0.3, most_share: float = 0.2) -> DataFrame:
    """Adds weight: confidence of unverified claims is capped, and so is their share of a subject's mass."""
    c = F.when(F.col("verified"), F.col("conf")).otherwise(F.least("conf", F.lit(most_conf)))
    q = claims.withColumn("_c", c)
    w = Window.partitionBy("subject")
    sure, loose = F.sum(F.when(F.col("verified"), F.col("_c")).otherwise(0.0)).over(w), F.sum(F.when(~F.col("verified"), F.col("_c")).otherwise(0.0)).over(w)
    scale = F.when(loose > 0, F.least(F.lit(1.0), most_share / (1 - most_share) * sure / F.nullif(loose, F.lit(0.0)))).otherwise(1.0)
    return q.withColumn("weight", F.when(F.col("verified"), F.col("_c")).otherwise(F.col("_c") * scale)).drop("_c")


def pooled(outcomes: DataFrame, *key: str, k: int = 50) -> DataFrame:
    """Mean, deviation, count, win rate and quartiles of each key's k most similar past cases."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("similarity"), "case_id"))
    g = outcomes.withColumn("_r", r).where(F.col("_r") <= k).groupBy(*key)
    return g.agg(F.avg("outcome").alias("mu"), F.stddev_samp("outcome").alias("sigma"), F.count("*").alias("n"), F.avg((F.col("outcome") > 0).cast("double")).alias("win_rate"), F.percentile("outcome", F.lit(0.25)).alias("q25"), F.percentile("outcome", F.lit(0.75)).alias("q75"))


def rolling_correlation(pairs: DataFrame, n: int, least: float) -> DataFrame:
    """date, a, b, corr over the last n rows of each pair, where it is above ``least`` in size."""
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(1 - n, 0)
    out = pairs.withColumn("corr", F.when(F.count("*").over(w) == n, F.corr("ret_a", "ret_b").over(w)))
    return out.where(F.abs("corr") > least).select("date", "a", "b", "corr")


def sentiment(daily: DataFrame, n: int = 20) -> DataFrame:
    """Adds dlog_volume, z, spike and entropy to (ticker, date, mentions, bull, bear)."""
    w = Window.partitionBy("ticker").orderBy("date")
    back = w.rowsBetween(-n, -1)
    p = F.col("bull") / F.nullif(F.col("bull") + F.col("bear"), F.lit(0))
    h = lambda x: F.when((x > 0) & (x < 1), -x * F.ln(x) - (1 - x) * F.ln(1 - x)).otherwise(F.when(x.isNotNull(), 0.0))
    z = (F.col("mentions") - F.avg("mentions").over(back)) / F.nullif(F.stddev_samp("mentions").over(back), F.lit(0.0))
    return daily.withColumn("dlog_volume", F.log1p("mentions") - F.lag(F.log1p("mentions")).over(w)).withColumn("z", z).withColumn("spike", F.coalesce(F.round("z", 9) > 2, F.lit(False))).withColumn("disagreement", h(p))


def event_flags(daily: DataFrame, events: DataFrame, before: int = 3, after: int = 1) -> DataFrame:
    """Adds event: whether the ticker has an event (ticker, day) from ``before`` days ahead to ``after`` days back.

    Each event is put on its few days, so that the join is by ticker and date.
    """
    days = F.explode(F.sequence(F.date_sub("day", before), F.date_add("day", after)))
    flags = events.select("ticker", days.alias("date")).distinct().withColumn("event", F.lit(True))
    return daily.join(flags, ["ticker", "date"], "left").withColumn("event", F.coalesce("event", F.lit(False)))


def novelty(daily: DataFrame) -> DataFrame:
    """Adds novelty: days since the ticker was last mentioned, null for the first time."""
    w = Window.partitionBy("ticker").orderBy("date")
    return daily.withColumn("novelty", F.datediff("date", F.lag("date").over(w)))


def tagged(texts: DataFrame, master: DataFrame) -> DataFrame:
    """tag, n, known: how often each cashtag stands in ``texts`` (text), and whether the master table has it as a ticker."""
    counts = texts.select(F.explode(cashtags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    names = master.select(F.col("ticker").alias("tag")).distinct().withColumn("known", F.lit(True))
    return counts.join(names, "tag", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\$([A-Z]{1,5})\\b"), F.lit(1))


def interquartile_mean(scores: DataFrame, *key: str) -> DataFrame:
    """Mean of the middle half of each key's scores, the cut rows weighed by their share."""
    w = Window.partitionBy(*key)
    s = scores.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("score", "seed")))
    weight = F.greatest(F.lit(0.0), F.least(F.col("r"), 0.75 * F.col("n")) - F.greatest(F.col("r") - 1, 0.25 * F.col("n")))
    return s.withColumn("wt", weight).groupBy(*key).agg((F.sum(F.col("score") * F.col("wt")) / F.sum("wt")).alias("iqm"))


def probability_of_improvement(scores: DataFrame, a: str, b: str, *key: str) -> DataFrame:
    """key, p: how likely a run of ``a`` scores above one of ``b`` (key, name, score), ties counting half; by mid-ranks."""
    both = scores.where(F.col("name").isin(a, b))
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    tie = Window.partitionBy(*key, "score")
    mid = F.rank().over(w.orderBy("score")) + (F.count("*").over(tie) - 1) / 2
    g = both.withColumn("mid", mid).groupBy(*key).agg(F.count_if(F.col("name") == a).alias("x"), F.count_if(F.col("name") == b).alias("y"), F.sum(F.when(F.col("name") == a, F.col("mid"))).alias("s"))
    return g.select(*key, ((F.col("s") - F.col("x") * (F.col("x") + 1) / 2) / F.nullif(F.col("x") * F.col("y"), F.lit(0))).alias("p"))


def stratified_interval(scores: DataFrame, replicates: int = 200, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """theta, lower, upper: the interquartile mean of (stratum, seed, score) and its bootstrap interval, resampled within strata.

    The scores of runs, so few; every replicate draws as many of a stratum as it has.
    """
    placed = scores.withColumn("i", F.row_number().over(Window.partitionBy("stratum").orderBy("seed")) - 1)
    n = placed.groupBy("stratum").agg(F.count("*").alias("n"))
    draw = F.floor(hashed(seed, 0, "b", "stratum", "i") * F.col("n")).cast("int")
    drawn = placed.select("stratum", F.col("i")).join(n, "stratum").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = drawn.select("b", "stratum", F.col("i").alias("seed"), draw.alias("i")).join(placed.select("stratum", "i", "score"), ["stratum", "i"])
    reps = interquartile_mean(drawn.withColumn("seed", F.concat_ws("|", "stratum", "seed")), "b").agg(F.percentile("iqm", F.lit(alpha / 2)).alias("lower"), F.percentile("iqm", F.lit(1 - alpha / 2)).alias("upper"))
    own = interquartile_mean(scores.withColumns({"b": F.lit(0), "seed": F.concat_ws("|", "stratum", "seed")}), "b").select(F.col("iqm").alias("theta"))
    return own.crossJoin(reps)


def shuffled(rows: DataFrame, column: str, seed: int, *within: str) -> DataFrame:
    """A placebo: the column's values permuted by a seeded hash within groups of a bounded size."""
    by = [F.col(c) for c in within] or [F.lit(0)]
    a = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("id")))
    b = rows.select(*within, F.col(column).alias("_v"), F.row_number().over(Window.partitionBy(*by).orderBy(hashed(seed, 0, "id"), "id")).alias("_i"))
    return a.join(b, [*within, "_i"]).withColumn(column, F.col("_v")).drop("_v", "_i")
