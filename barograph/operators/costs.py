"""Trade costs at three levels, and their recursion over a book's value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (level, commission bps, half spread bps, impact coefficient, cap as a share of daily value traded).
LEVELS = [("free", 0.0, 0.0, 0.0, 1.0), ("realistic", 0.0, 1.0, 0.1, 0.01), ("pessimistic", 0.0, 2.0, 0.3, 0.005)]


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level string, commission_bps double, half_spread_bps double, impact_eta double, adv_cap double")


def leg(dw: Column, value: Column, adv: Column, vol: Column, commission: Column, spread: Column, eta: Column, cap: Column) -> dict[str, Column]:
    """filled, cost (money), capped and unfilled of one trade of weight ``dw`` in a book of ``value``."""
    notional = F.abs(dw) * value
    limit = cap * adv
    filled = F.when(limit.isNull(), notional).otherwise(F.least(notional, limit))
    linear = filled * (spread + commission) * 1e-4
    impact = F.when((eta > 0) & (adv > 0) & (vol > 0), filled * eta * vol * F.sqrt(filled / F.nullif(adv, F.lit(0.0)))).otherwise(0.0)
    capped = F.coalesce(notional > limit + 1e-9, F.lit(False))
    return {"filled": filled, "cost": linear + impact, "capped": capped, "unfilled": F.when(capped, notional - limit).otherwise(0.0)}


def trade_costs(trades: DataFrame, *keys: str) -> DataFrame:
    """Per key: cost as a fraction of the book, capped legs and unfilled money, from legs with value and a level's columns."""
    c = leg(*(F.col(x) for x in ("dw", "value", "adv", "vol", "commission_bps", "half_spread_bps", "impact_eta", "adv_cap")))
    legs = trades.withColumns({f"_{k}": v for k, v in c.items()})
    return legs.groupBy(*keys).agg(F.coalesce(F.sum("_cost") / F.nullif(F.first("value"), F.lit(0.0)), F.lit(0.0)).alias("cost"), F.count_if("_capped").alias("n_capped"), F.sum("_unfilled").alias("unfilled"))


def apply_costs(path: DataFrame, legs: DataFrame, start: float, *keys: str) -> DataFrame:
    """keys, level, date, gross, net, value: r = gross - cost(V), V <- V (1 + r), an ordered fold for each key and cost level.

    path: keys, date, gross.  legs: keys, date, dw, adv, vol.  A key's dates and legs are one task's, since each value
    needs the one before; keys run in parallel.  A null adv has no cap.
    """
    none = [F.lit(None).cast("double").alias(c) for c in ("dw", "adv", "vol")]
    rows = legs.select(*keys, "date", F.lit(None).cast("double").alias("gross"), *(F.col(c).cast("double") for c in ("dw", "adv", "vol")))
    rows = rows.unionAll(path.select(*keys, "date", F.col("gross").cast("double"), *none))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf[pdf.dw.isna() & pdf.gross.notna()].sort_values("date")
        trades = pdf[pdf.dw.notna()].sort_values("date")
        out = _levels_of(days.date.to_numpy(), days.gross.to_numpy(float), trades, start)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "level string, date date, gross double, net double, value double"])
    return rows.groupBy(*keys).applyInPandas(fold, schema)


def books(legs: DataFrame, start: float, key: str) -> DataFrame:
    """key, level, date, gross, net, value, half from legs (key, exit_date, ticker, w, r, dw, adv, vol), which are read once.

    half: half the absolute trades of a date.  One task a key, as in ``apply_costs``.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        trades = pdf.sort_values(["exit_date", "ticker"]).rename(columns={"exit_date": "date"})
        by = trades.assign(g=trades.w * trades.r, h=trades.dw.abs() / 2).groupby("date")[["g", "h"]].sum()
        out = _levels_of(by.index.to_numpy(), by.g.to_numpy(float), trades, start)
        out["half"] = np.tile(by.h.to_numpy(float), len(LEVELS))
        out.insert(0, key, pdf[key].iloc[0])
        return out

    schema = f"{key} {dict(legs.dtypes)[key]}, level string, date date, gross double, net double, value double, half double"
    return legs.select(key, "exit_date", "ticker", "w", "r", "dw", "adv", "vol").groupBy(key).applyInPandas(fold, schema)


def _levels_of(days: np.ndarray, gross: np.ndarray, trades: pd.DataFrame, start: float) -> pd.DataFrame:
    """level, date, gross, net, value: the fold over ordered dates at each level; trades are ordered by date."""
    at = trades.date.to_numpy()
    first, last = np.searchsorted(at, days, "left"), np.searchsorted(at, days, "right")
    dw, adv, vol = (trades[c].to_numpy(float) for c in ("dw", "adv", "vol"))
    dw, whole, vol = np.abs(dw), np.where(np.isnan(adv), np.inf, adv), np.nan_to_num(vol)
    out = []
    for name, commission, spread, eta, cap in LEVELS:
        value = start
        for day, g, a, b in zip(days, gross, first, last, strict=True):
            filled = np.minimum(dw[a:b] * value, cap * whole[a:b])
            share = np.sqrt(np.divide(filled, adv[a:b], out=np.zeros_like(filled), where=adv[a:b] > 0))
            money = (filled * ((spread + commission) * 1e-4 + (eta * vol[a:b] * share if eta > 0 else 0.0))).sum()
            net = g - (money / value if value > 0 else 0.0)
            value *= 1 + net
            out.append((name, day, g, net, value))
    return pd.DataFrame(out, columns=["level", "date", "gross", "net", "value"])
