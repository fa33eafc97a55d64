"""The gates of a data build: each gives one row (gate, passed, n_problems, detail), and none passes without data.

detail: the first three problems in order.  ``tickers`` is a table of the tickers that must be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import adjust, quality, temporal

ORDER = ("coverage", "phantom_sessions", "reconcile", "point_in_time", "corporate_actions", "printed_prices")


def verdict(name: str, problems: DataFrame) -> DataFrame:
    """From a table of problems (d): one row; only the first three are ever gathered."""
    count = problems.agg(F.count("*").alias("n_problems"))
    first = problems.select("d").orderBy("d").limit(3).agg(F.array_join(F.array_sort(F.collect_list("d")), "; ").alias("detail"))
    return count.crossJoin(first).select(F.lit(name).alias("gate"), (F.col("n_problems") == 0).alias("passed"), "n_problems", "detail")


def _d(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).alias("d")


def _absent(data: DataFrame, tickers: DataFrame) -> DataFrame:
    return tickers.join(data.select("ticker").distinct(), "ticker", "left_anti").select(_d(F.col("ticker"), ": no data"))


def coverage(bars: DataFrame, tickers: DataFrame, calendar: DataFrame, end=None, now=None) -> DataFrame:
    """Every provider of every ticker has each session up to ``end`` and the last one that is complete at ``now``.

    The data's own end is no bound, so that a truncated series fails.
    """
    if end is not None:
        calendar = calendar.where(F.col("date") <= F.lit(end).cast("date"))
    if now is not None:
        calendar = calendar.where(temporal.bar_public_at(F.col("date")) <= F.lit(now).cast("timestamp"))
    bars = bars.join(tickers, "ticker", "left_semi")
    gaps = temporal.missing_sessions(bars, calendar, "ticker", "provider").groupBy("ticker", "provider")
    lacking = gaps.agg(F.count("*").alias("k"), F.min("date").alias("a"), F.max("date").alias("b"))
    return verdict("coverage", lacking.select(_d(F.col("ticker"), "/", F.col("provider"), ": ", F.col("k"), " missing, ", F.col("a"), " to ", F.col("b"))).unionAll(_absent(bars, tickers)))


def phantom_sessions(bars: DataFrame, tickers: DataFrame, calendar: DataFrame) -> DataFrame:
    """No bar on a day that is no session."""
    bars = bars.join(tickers, "ticker", "left_semi")
    extra = temporal.unexpected_sessions(bars, calendar, "ticker", "provider").groupBy("ticker", "provider").agg(F.count("*").alias("k"), F.min("date").alias("a"))
    return verdict("phantom_sessions", extra.select(_d(F.col("ticker"), "/", F.col("provider"), ": ", F.col("k"), " from ", F.col("a"))))


def _breaches(stats: DataFrame, tickers: DataFrame) -> DataFrame:
    """One problem a ticker and ceiling; a ticker without a usable row is a problem too."""
    scored = quality.scored(tickers.join(stats, "ticker", "left").withColumn("n_over_1bp", F.coalesce("n_over_1bp", F.lit(0))))
    return scored.select("ticker", F.explode("breaches").alias("what")).select(_d(F.col("ticker"), ": ", F.col("what")))


def reconcile(a: DataFrame, b: DataFrame, tickers: DataFrame) -> DataFrame:
    """Two sources' closes differ by no more than the ceilings, and are no copies of each other."""
    stats = quality.divergence(quality.compare(a, b, "close", "ticker").join(tickers, "ticker", "left_semi"), "ticker")
    kind = stats.where("n > 0").agg(quality.independence(F.avg("frac_identical")).alias("kind"))
    suspect = kind.where(F.col("kind").isin("MIRROR_SUSPECTED", "UNKNOWN")).select(_d("independence: ", F.col("kind")))
    return verdict("reconcile", _breaches(stats, tickers).unionAll(suspect))


def point_in_time(bars: DataFrame, acts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Every bar becomes public at its session's close, never by its opening; every action at its day's opening."""
    bars, acts = bars.join(tickers, "ticker", "left_semi"), acts.join(tickers, "ticker", "left_semi")
    at, day = F.col("first_public_at"), F.col("date")
    wrong = bars.where(~at.eqNullSafe(temporal.bar_public_at(day))).select(_d(F.col("ticker"), " ", day, ": not public at its close"))
    early = bars.where(at <= temporal.public_at(day, "09:29:00")).select(_d(F.col("ticker"), " ", day, ": public before its opening"))
    action = acts.where(~at.eqNullSafe(temporal.action_public_at(F.col("ex_date")))).select(_d(F.col("ticker"), " ", F.col("ex_date"), " ", F.col("kind"), ": not public at its opening"))
    return verdict("point_in_time", wrong.unionAll(early).unionAll(action).unionAll(_absent(bars, tickers)))


def corporate_actions(bars: DataFrame, acts: DataFrame, reference: DataFrame, tickers: DataFrame) -> DataFrame:
    """Returns of the dividend-adjusted closes agree with those of a reference (ticker, date, close).

    Returns, since levels have a base of their own; a ticker without a reference fails.
    """
    ours = adjust.adjusted(bars, acts).select("ticker", "date", F.col("adj_close").alias("ours"))
    w = Window.partitionBy("ticker").orderBy("date")
    change = lambda c: F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1
    both = ours.join(reference.select("ticker", "date", F.col("close").alias("theirs")), ["ticker", "date"]).join(tickers, "ticker", "left_semi")
    both = both.withColumn("bps", (change("ours") - change("theirs")) * 10000).where("bps is not null")
    return verdict("corporate_actions", _breaches(quality.divergence(both, "ticker"), tickers))


def reproducible(a: DataFrame, b: DataFrame, *cols: str) -> DataFrame:
    """Two builds have the same rows, by their digests of content."""
    x, y = quality.content_digest(a, *cols), quality.content_digest(b, *cols)
    both = x.select(F.struct("*").alias("x")).crossJoin(y.select(F.struct("*").alias("y")))
    return verdict("reproducible", both.where("x <> y").select(_d("digests differ: ", F.col("x.n_rows"), " and ", F.col("y.n_rows"), " rows")))


def printed_prices(bars: DataFrame, acts: DataFrame, anchors: DataFrame, most_bps: float = 25.0) -> DataFrame:
    """Un-adjusted closes are those that were printed (ticker, date, printed); an absent bar fails, and no anchor at all."""
    found = quality.printed_prices(adjust.as_traded(bars, acts), anchors, most_bps)
    off = found.where("not passed").select(_d(F.col("ticker"), " ", F.col("date"), F.when(F.col("traded_close").isNull(), ": no bar").otherwise(": not as printed")))
    none = anchors.agg(F.count("*").alias("k")).where("k = 0").select(_d("no anchors"))
    return verdict("printed_prices", off.unionAll(none))


def run(bars: DataFrame, acts: DataFrame, tickers: DataFrame, calendar: DataFrame, reference: DataFrame, anchors: DataFrame, end=None, now=None) -> DataFrame:
    """i, gate, passed, n_problems, detail: all gates in their order; none is left out for want of data.

    bars: the latest of each (ticker, date, provider).  The first two providers by name are reconciled, and the first
    one's bars are held against reference and anchors.
    """
    names = [r[0] for r in bars.join(tickers, "ticker", "left_semi").select("provider").distinct().orderBy("provider").limit(2).collect()]
    of = [bars.where(F.col("provider") == p) for p in names]
    one = of[0] if of else bars
    found = {
        "coverage": coverage(bars, tickers, calendar, end, now),
        "phantom_sessions": phantom_sessions(bars, tickers, calendar),
        "reconcile": reconcile(*of, tickers) if len(of) == 2 else verdict("reconcile", tickers.agg(_d(f"only {len(of)} providers"))),
        "point_in_time": point_in_time(bars, acts, tickers),
        "corporate_actions": corporate_actions(one, acts, reference, tickers),
        "printed_prices": printed_prices(one, acts, anchors),
    }
    rows = None
    for i, name in enumerate(ORDER):
        row = found[name].select(F.lit(i).alias("i"), "gate", "passed", "n_problems", "detail")
        rows = row if rows is None else rows.unionAll(row)
    return rows
