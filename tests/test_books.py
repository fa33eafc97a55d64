import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.operators import backtest, costs, environment, panel
from barograph.sources import ledger

DAYS = [d.date() for d in pd.bdate_range("2020-01-01", periods=120)]
NAMES = ["A", "B", "C"]


@pytest.fixture(scope="module")
def market(spark):
    """A random panel: closes, opens at the close before, liquidity and returns."""
    rng = np.random.default_rng(7)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (len(DAYS), 3)), 0))
    open_ = np.vstack([close[:1], close[:-1]])
    ret = np.vstack([np.zeros((1, 3)), close[1:] / close[:-1] - 1])
    rows = [(k, DAYS[i], float(open_[i, j]), float(close[i, j]), float(ret[i, j]), 1e9, 0.02) for i in range(len(DAYS)) for j, k in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, close double, ret double, adv double, vol double").withColumn("adj_close", F.col("close"))
    return df.persist(), close, open_


def test_walk_of_a_held_strategy_differs_from_daily_rebalancing(spark, market):
    df, _, open_ = market
    p = df.withColumn("k", F.lit("x"))
    hold = environment.walk(p, "k", lambda history, held: np.full(3, 1 / 3) if held.sum() == 0 else held, 20)
    daily = environment.walk(p, "k", lambda history, held: np.full(3, 1 / 3), 20)
    n = len(DAYS) - 22
    turned = lambda legs: legs.groupBy("t").agg(F.sum(F.abs("dw")).alias("x")).agg(F.avg(F.col("x") / 2)).first()[0]
    assert turned(hold) * n == pytest.approx(0.5) and turned(daily) > turned(hold)
    # the closed forms give the same legs
    forms = backtest.walks(df, {"daily": backtest.equal_weight(3), "hold": backtest.buy_and_hold(20)}, 20)
    for name, legs in (("daily", daily), ("hold", hold)):
        both = legs.select("date", "ticker", F.col("w").alias("w0"), F.col("dw").alias("dw0"), F.col("r").alias("r0")).join(forms.where(F.col("strategy") == name), ["date", "ticker"])
        assert both.count() == 3 * n
        assert both.agg(F.max(F.abs(F.col("w") - F.col("w0")) + F.abs(F.col("dw") - F.col("dw0")) + F.abs(F.col("r") - F.col("r0")))).first()[0] < 1e-12


def test_walk_sees_no_future_and_checks_weights(spark, market):
    df, close, _ = market
    p = df.withColumn("k", F.lit("x"))
    last = environment.walk(p, "k", lambda history, held: np.array([len(history) / 1000, 0, float(history[-1, 0] / 1e6)]), 20)
    got = last.where("ticker = 'A'").orderBy("t").collect()
    assert [round(r.w * 1000) for r in got] == [r.t + 1 for r in got] and got[0].exit_date == DAYS[22]
    for bad in ([0.6, 0.6, 0.0], [-0.1, 0.0, 0.0], [1.0], [float("nan"), 0, 0]):
        with pytest.raises(Exception, match="weights"):
            environment.walk(p, "k", lambda history, held, bad=bad: np.array(bad), 20).count()
    assert environment.walk(p.where(F.col("date") < F.lit(DAYS[21])), "k", lambda h, held: np.zeros(3), 20).count() == 0


def test_oracle_is_rewarded_and_costs_are_ordered(spark, market, tmp_path):
    df, *_ = market
    legs = backtest.walks(df, {"oracle": backtest.oracle(1), "daily": backtest.equal_weight(3)}, 20, "adv", "vol")
    table = backtest.evaluate(legs, 1e6).collect()
    got = {(r.strategy, r.level): r for r in table}
    assert got["oracle", "free"].sharpe > 5
    for s in ("oracle", "daily"):
        a, b, c = (got[s, level] for level in ("free", "realistic", "pessimistic"))
        assert a.sharpe >= b.sharpe >= c.sharpe and a.total_cost_bps == 0 < b.total_cost_bps < c.total_cost_bps and a.turnover == c.turnover
    log = ledger.Ledger(f"{tmp_path}/trials.jsonl")
    backtest.record(log, spark.createDataFrame(table), 20, "test")
    rows = ledger.records(spark, f"file://{tmp_path}/trials.jsonl")
    assert ledger.n_trials(rows, "evaluation").first()[0] == 2 and ledger.verdict(ledger.verify(rows)).first().ok


def test_cost_fold_equals_loop(spark):
    rng = np.random.default_rng(2)
    gross = rng.normal(0, 0.01, 30)
    dw, adv, vol = rng.normal(0, 0.3, (30, 2)), rng.uniform(1e4, 1e6, (30, 2)), rng.uniform(0, 0.05, (30, 2))
    adv[3, 0] = np.nan
    path = spark.createDataFrame([("s", DAYS[i], float(g)) for i, g in enumerate(gross)], "k string, date date, gross double")
    legs = spark.createDataFrame([("s", DAYS[i], float(dw[i, j]), None if np.isnan(adv[i, j]) else float(adv[i, j]), float(vol[i, j])) for i in range(30) for j in range(2)], "k string, date date, dw double, adv double, vol double")
    got = {(r.level, r.date): r for r in costs.apply_costs(path, legs, 1e6, "k").collect()}
    for level, commission, spread, eta, cap in costs.LEVELS:
        value = 1e6
        for i in range(30):
            money = 0.0
            for j in range(2):
                n = abs(dw[i, j]) * value
                f = n if np.isnan(adv[i, j]) else min(n, cap * adv[i, j])
                money += f * (commission + spread) * 1e-4 + (0 if np.isnan(adv[i, j]) else f * eta * vol[i, j] * (f / adv[i, j]) ** 0.5)
            net = gross[i] - money / value
            value *= 1 + net
            r = got[level, DAYS[i]]
            assert r.net == pytest.approx(net, abs=1e-12) and r.value == pytest.approx(value)


def test_simulator(spark, market):
    df, *_ = market
    p = df.withColumn("k", F.lit("x")).withColumn("action", F.lit(1.0))
    free = environment.simulate(p, "k", lookback=20).orderBy("t").collect()
    assert len(free) == len(DAYS) - 22 and free[0].n_capped == 0 and free[0].cash == pytest.approx(1 / (1 + 3 * np.exp(5)), rel=0.2)
    tight = environment.simulate(p.withColumn("adv", F.lit(1e6)), "k", lookback=20).orderBy("t").first()
    assert tight.n_capped == 3 and 0 < 1 - tight.cash < 0.1  # filled in part
    out = environment.simulate(p.withColumn("action", F.lit(-1.0)), "k", lookback=20).agg(F.min("cash")).first()[0]
    assert out > 0.95
    gate = environment.simulate(p, "k", lookback=20, threshold=-1.0, trailing=30).orderBy("t").collect()
    assert [r.turbulent for r in gate] == [r.t > 30 for r in gate] and gate[-1].cash == 1
    lost = environment.simulate(p.withColumn("open", F.when(F.col("date") == F.lit(DAYS[40]), 0.0).otherwise(F.col("open"))), "k", lookback=20).where("value <= 0")
    assert lost.where("cash <> 1").count() == 0  # a book that is worth nothing is all cash


def test_turbulence_equals_definition():
    rng = np.random.default_rng(1)
    h = rng.normal(size=(60, 4))
    h[:, 3] = h[:, 0]  # singular
    x = rng.normal(size=4)
    mean = h.mean(0)
    cov = sum(np.outer(r - mean, r - mean) for r in h) / 59
    assert environment.turbulence(h, x) == pytest.approx((x - mean) @ np.linalg.pinv(cov) @ (x - mean))


def test_simulator_and_adapter_see_the_same_observation(spark, market, tmp_path):
    """What a policy is given at each date, in both: returns, held weights, cash."""
    df, close, _ = market
    seen: list[np.ndarray] = []
    held = np.array([0.2, 0.3, 0.1])
    policy = environment.policy_strategy(lambda x: seen.append(x) or np.zeros(3), 20)
    w = policy(close[:40], held)
    returns = close[20:40] / close[19:39] - 1
    want = environment.observation(returns, held)
    assert len(want) == 3 * 20 + 3 + 1 and want.dtype == np.float32 and np.allclose(seen[0], want) and want[-1] == np.float32(0.4)
    assert np.allclose(w, 0.25) and policy(close[:20], held).tolist() == [0, 0, 0]
    p = df.withColumn("k", F.lit("x"))
    alone = environment.simulate(p, "k", policy=lambda x: np.full(3, x[-1]), lookback=20).orderBy("t").first()
    same = environment.simulate(p.withColumn("action", F.lit(1.0)), "k", lookback=20).orderBy("t").first()
    assert alone.net == pytest.approx(same.net)  # all cash at first: an action of 1


def test_panels(spark, market):
    df, *_ = market
    tape = df.withColumns({"adj_open": F.col("open"), "traded_close": F.col("close"), "traded_volume": F.lit(1.0)})
    t = lambda *n: spark.createDataFrame([(x,) for x in n], "ticker string")
    assert panel.total_return_panel(tape, t("A", "B"), DAYS[5], DAYS[9]).count() == 10
    with pytest.raises(Exception, match="missing on"):
        panel.total_return_panel(tape, t("A", "Z"), DAYS[5], DAYS[9]).collect()
    holed = tape.where((F.col("ticker") != "B") | (F.col("date") != F.lit(DAYS[7])))
    with pytest.raises(Exception, match="missing on 2020"):
        panel.total_return_panel(holed, t("A", "B"), DAYS[5], DAYS[9]).collect()
    assert panel.reindexed(holed, df.select("date"), t("A", "B")).where("close is null").count() == 1
    train, test = panel.split(df, DAYS[50], DAYS[60])
    assert (train.count(), test.count()) == (3 * 51, 3 * (len(DAYS) - 60)) and isinstance(DAYS[0], dt.date)
