"""Books that depend on what is held: walks of stateful strategies, the trading simulator, scoring of policies.

A strategy is a function (history, held) -> weights: closes up to the decision's date (dates by tickers in their
order), and the weights that are held after drift; what they leave of 1 is cash.  A policy is a function of an
observation: the returns of the last ``lookback`` dates, flattened by date and ticker, the held weights, and cash.
Its actions are scaled to logits, and a softmax beside a cash logit of 0 gives the target.

Each key (strategy, episode, portfolio) is one ordered sequence, so one task; keys run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: an action of 1 as a logit.
ACTION_SCALE = 5.0
STEP = "t int, date date, gross double, cost double, net double, value double, reward double, n_capped int, turnover double, turbulent boolean, cash double"
LEG = "t int, date date, exit_date date, ticker string, w double, held double, dw double, r double"


def softmax_with_cash(z: np.ndarray) -> np.ndarray:
    top = max(float(z.max(initial=0.0)), 0.0)
    e = np.exp(z - top)
    return e / (e.sum() + np.exp(-top))


def observation(window: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The one feature function of simulator and adapter: returns (dates by tickers), held weights, cash."""
    return np.r_[window.ravel(), held, max(0.0, 1.0 - held.sum())].astype(np.float32)


def drifted(w: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Held weights after returns of ``move``; cash earns nothing."""
    grown = w * (1 + move)
    whole = grown.sum() + 1 - w.sum()
    return np.zeros_like(grown) if whole <= 0 else grown / whole


def turbulence(history: np.ndarray, now: np.ndarray) -> float:
    """Mahalanobis distance of a date's returns from the trailing ones."""
    d = now - history.mean(0)
    return float(d @ np.linalg.pinv(np.cov(history, rowvar=False).reshape(len(now), len(now))) @ d)


def _wide(pdf: pd.DataFrame, *cols: str) -> tuple[pd.Index, list[str], list[np.ndarray]]:
    """Dates, tickers, and each column as dates by tickers, both in their order."""
    frames = [pdf.pivot(index="date", columns="ticker", values=c).sort_index() for c in cols]
    return frames[0].index, list(frames[0].columns), [f.to_numpy(float) for f in frames]


def walk(rows: DataFrame, key: str, strategy: Callable[[np.ndarray, np.ndarray], np.ndarray], warmup: int = 20) -> DataFrame:
    """key and a leg a date and ticker over (key, date, ticker, open, close): decision at t, entry at open t+1, exit at open t+2.

    Weights below 0, sums above 1 or another number of weights than of tickers are errors.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dates, tickers, (o, close) = _wide(pdf, "open", "close")
        held, out = np.zeros(len(tickers)), []
        for t in range(warmup, len(dates) - 2):
            w = np.asarray(strategy(close[: t + 1], held.copy()), float)
            if w.shape != held.shape:
                raise ValueError(f"{len(tickers)} weights are expected, not {w.shape}")
            if not (w >= -1e-9).all() or w.sum() > 1 + 1e-9:
                raise ValueError("weights out of range")
            move = o[t + 2] / o[t + 1] - 1
            out.append(pd.DataFrame({"t": t, "date": dates[t], "exit_date": dates[t + 2], "ticker": tickers, "w": w, "held": held, "dw": w - held, "r": move}))
            held = drifted(w, move)
        legs = pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in LEG.split(", ")])
        legs.insert(0, key, pdf[key].iloc[0])
        return legs

    return rows.select(key, "date", "ticker", "open", "close").groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {LEG}")


def policy_strategy(model: Callable[[np.ndarray], np.ndarray], lookback: int = 20) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A policy (observation -> actions) as a strategy; all cash until there are ``lookback`` returns."""

    def weights(history: np.ndarray, held: np.ndarray) -> np.ndarray:
        if len(history) <= lookback:
            return np.zeros(history.shape[1])
        returns = history[-lookback:] / history[-lookback - 1 : -1] - 1
        return softmax_with_cash(np.asarray(model(observation(returns, held)), float) * ACTION_SCALE)

    return weights


def simulate(rows: DataFrame, key: str, policy: Callable[[np.ndarray], np.ndarray] | None = None, start: float = 1e6, lookback: int = 10, commission: float = 0.0, spread: float = 1.0, eta: float = 0.1, cap: float = 0.01, penalty: float = 0.0, threshold: float | None = None, trailing: int = 60, solvent: bool = True) -> DataFrame:
    """One episode a key over (key, date, ticker, open, ret, adv, vol, action): fills up to the cap, costs, drift, reward.

    policy gives the actions, of [-1, 1], from the observation; without it those of the rows are taken.  With a
    threshold, a date whose turbulence is above it has all cash as its target.  A book that is worth nothing is all cash.

    A loss of more than all has NaN as its reward.  ``solvent``: a book of 0 or less no longer trades and has no costs,
    as in the reference.  Without it such a book trades on; impact is a root of what is traded, which is negative then,
    so costs are NaN, and from there on all that depends on them.  A trade of NaN counts as capped.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["open", "ret", "adv", "vol", *([] if policy else ["action"])]
        dates, tickers, (o, r, adv, vol, *given) = _wide(pdf, *names)
        r, adv, vol = np.nan_to_num(r), np.nan_to_num(adv), np.nan_to_num(vol)
        held, value, out = np.zeros(len(tickers)), start, []
        for t in range(lookback, len(dates) - 2):
            action = policy(observation(r[t - lookback : t], held)) if policy else given[0][t]
            hot = threshold is not None and t > trailing and turbulence(r[t - trailing : t], r[t]) > threshold
            target = np.zeros(len(held)) if hot else softmax_with_cash(np.asarray(action, float) * ACTION_SCALE)
            want, limit = np.abs(target - held) * value, cap * adv[t]
            trades = value > 0 or not solvent
            filled = np.fmin(want, limit) if trades else np.zeros_like(want)
            with np.errstate(invalid="ignore", divide="ignore"):
                w = held + np.sign(target - held) * filled / value if trades else held
                move = o[t + 2] / o[t + 1] - 1
                part = np.sqrt(np.divide(filled, adv[t], out=np.zeros_like(filled), where=adv[t] > 0))
                cost = float((filled * ((spread + commission) * 1e-4 + eta * vol[t] * part)).sum() / np.float64(value)) if trades else 0.0
                gross, turn = float(w @ move), float(filled.sum() / np.float64(value)) if trades else 0.0
                net = gross - cost
                value *= 1 + net
                reward = float(np.log1p(net)) - penalty * turn
                held = drifted(w, move)
            out.append((pdf[key].iloc[0], t, dates[t + 2], gross, cost, net, value, reward, int((~(want <= limit + 1e-9)).sum()), turn, hot, 1 - held.sum()))
        return pd.DataFrame(out, columns=[key, *(c.split()[0] for c in STEP.split(", "))])

    steps = rows.groupBy(key).applyInPandas(run, f"{key} {dict(rows.dtypes)[key]}, {STEP}")
    # pandas has NaN and null as one; no figure of a step is null
    return steps.select(*[F.coalesce(c, F.lit(math.nan)).alias(c) if k == "double" and c != key else F.col(c) for c, k in steps.dtypes])
