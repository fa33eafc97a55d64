import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.functions.normal import norm_cdf, norm_ppf, student_sf
from barograph.operators import adjust, costs, evidence, gates, quality, stats, temporal
from barograph.sources import ledger
from barograph.sources.store import Store, new_ingest_id, unpivot_actions

D = dt.date


def bars(spark, days, close=50.0, ticker="T"):
    rows = [(ticker, d, *(close,) * 4, 1e6) for d in days]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def acts(spark, *rows):
    return spark.createDataFrame([("T", d, k, v, dt.datetime(d.year, d.month, d.day)) for d, k, v in rows], "ticker string, ex_date date, kind string, value double, first_public_at timestamp")


DAYS = [D(2020, 6, 12), D(2020, 6, 13), D(2020, 6, 15), D(2020, 6, 16)]


def test_split_counts_once_and_only_before_its_day(spark):
    a = acts(spark, (D(2020, 6, 15), "split", 2.0), (D(2020, 6, 15), "split", 2.0))
    got = [tuple(r) for r in adjust.as_traded(bars(spark, DAYS), a).orderBy("date").select("traded_close", "traded_volume").collect()]
    assert got == [(100.0, 5e5)] * 2 + [(50.0, 1e6)] * 2


@pytest.mark.parametrize("day,as_of,want", [(D(2020, 6, 15), None, [0.99, 0.99, 1, 1]), (D(2020, 6, 15), "2020-06-14", [1] * 4), (D(2020, 7, 1), None, [1] * 4)])
def test_dividend_factor(spark, day, as_of, want):
    f = adjust.dividend_factors(bars(spark, DAYS), acts(spark, (day, "dividend", 0.5)), as_of)
    assert [r.adj_factor for r in f.orderBy("date").collect()] == pytest.approx(want)


def test_raw_basis_is_refused(spark):
    b = bars(spark, DAYS).withColumn("price_basis", F.lit("raw"))
    with pytest.raises(Exception, match="raw basis"):
        adjust.adjusted(b, acts(spark, (D(2020, 6, 15), "dividend", 0.5))).collect()
    assert {r.unadjust_factor for r in adjust.as_traded(b, acts(spark, (D(2020, 6, 15), "split", 2.0))).collect()} == {1.0}


def test_store_reads_both_clocks(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.bars().count() == 0
    days = [D(2024, 1, 2), D(2024, 1, 3), D(2024, 1, 4)]
    s.write_bars(bars(spark, days, 1.0), "yahoo", new_ingest_id(), dt.datetime(2024, 1, 5))
    s.write_bars(bars(spark, days[:1], 9.0), "yahoo", new_ingest_id(), dt.datetime(2024, 2, 1))
    assert [r.date for r in s.bars(as_of="2024-01-03 14:29:00").collect()] == days[:1]
    assert s.bars(recorded_before="2024-01-04 23:00:00").count() == 0
    assert {r.date: r.close for r in s.bars().collect()}[days[0]] == 9.0
    assert {r.date: r.close for r in s.bars(recorded_before="2024-01-10").collect()}[days[0]] == 1.0
    assert s.bars(as_of="2024-01-10", strict=True).where("close = 9").count() == 0
    assert s.raw_bars().where("date = '2024-01-02'").first().first_public_at == dt.datetime(2024, 1, 2, 21)
    m = s.manifest()
    assert m["n_files"] == 2 and all(len(f["sha256"]) == 64 for f in m["files"].values())


def test_calendar(spark):
    days = {r.date for r in temporal.sessions(spark, "2024-01-01", "2024-12-31").collect()}
    assert not days & {D(2024, 1, 1), D(2024, 3, 29), D(2024, 6, 19), D(2024, 7, 4), D(2024, 11, 28), D(2024, 12, 25)}
    assert {D(2024, 1, 2), D(2024, 12, 24)} <= days and len(days) == 252


def test_gates_can_fail(spark):
    cal = spark.createDataFrame([(d,) for d in DAYS], "date date")
    b = bars(spark, DAYS[:-1])
    assert temporal.missing_sessions(b, cal, "ticker").count() == 1
    assert temporal.unexpected_sessions(bars(spark, [D(2024, 7, 4)]), cal, "ticker").count() == 1
    twice = quality.divergence(quality.compare(b, b, "close", "ticker"), "ticker").withColumn("verdict", quality.independence(F.col("frac_identical"))).first()
    assert twice.verdict == "MIRROR_SUSPECTED" and twice.n == 3
    off = quality.scored(quality.divergence(quality.compare(b, bars(spark, DAYS[:-1], 500.0), "close", "ticker"), "ticker")).first()
    assert not off.passed
    anchors = spark.createDataFrame([("T", DAYS[0], 100.0), ("X", DAYS[0], 1.0)], "ticker string, date date, printed double")
    traded = adjust.as_traded(bars(spark, DAYS), acts(spark, (D(2020, 6, 15), "split", 2.0)))
    assert {r.ticker: r.passed for r in quality.printed_prices(traded, anchors).collect()} == {"T": True, "X": False}
    stamped = b.withColumn("first_public_at", F.col("date").cast("timestamp"))
    row = gates.point_in_time(stamped, acts(spark, (D(2020, 6, 15), "split", 2.0)), spark.createDataFrame([("T",)], "ticker string")).first()
    assert row.n_problems >= 4 and not row.passed


def test_ledger_shows_edits_and_deletions(spark, tmp_path):
    log = ledger.Ledger(f"{tmp_path}/t.jsonl")
    for i in range(4):
        log.append("ab"[i % 2], {"k": i}, {"sharpe": 0.1 * i})
    check = lambda: ledger.verdict(ledger.verify(ledger.records(spark, f"file://{tmp_path}/t.jsonl"))).first()
    assert check().ok and check().n == 4
    assert ledger.n_trials(ledger.records(spark, f"file://{tmp_path}/t.jsonl"), "a").first().n_trials == 2
    lines = log.path.read_text().splitlines()
    log.path.write_text("\n".join([lines[0], lines[1].replace('"k": 1', '"k": 7'), *lines[2:]]) + "\n")
    assert not check().ok
    log.path.write_text("\n".join([lines[0], *lines[2:]]) + "\n")
    assert not check().ok


def test_costs(spark):
    legs = spark.createDataFrame([(0.5, 1e6, 1e12, 0.0), (-0.5, 1e6, 1e12, 0.0)], "dw double, value double, adv double, vol double").crossJoin(costs.levels(spark))
    got = {r.level: r.cost for r in costs.trade_costs(legs, "level").collect()}
    assert got["free"] == 0 and got["realistic"] == pytest.approx(1e-4)
    one = spark.createDataFrame([(1.0, 1e6, 1e6, 0.0)], "dw double, value double, adv double, vol double").crossJoin(costs.levels(spark))
    r = {r.level: r for r in costs.trade_costs(one, "level").collect()}["realistic"]
    assert r.n_capped == 1 and r.unfilled == pytest.approx(990_000)


def test_distributions(spark):
    x = spark.createDataFrame([(v,) for v in (-6.0, -2.0, -0.5, 0.0, 1.0, 3.9, 4.1, 8.0)], "x double")
    for r in x.select("x", norm_cdf(F.col("x")).alias("c"), norm_ppf(norm_cdf(F.col("x"))).alias("b"), student_sf(F.col("x"), F.lit(1)).alias("t1"), student_sf(F.col("x"), F.lit(2)).alias("t2")).collect():
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), rel=1e-9, abs=1e-15)
        assert r.b == pytest.approx(r.x, abs=1e-6 if r.x > 7 else 1e-8) or r.x > 7
        assert r.t1 == pytest.approx(0.5 - math.atan(r.x) / math.pi, abs=1e-12)
        assert r.t2 == pytest.approx(0.5 - r.x / (2 * math.sqrt(2 + r.x * r.x)), abs=1e-12)


def test_published_statistics(spark):
    row = spark.createDataFrame([(2.5, 1250.0, -3.0, 10.0)], "sr double, n double, k3 double, k4 double")
    got = row.select(*[stats.dsr(F.col("sr"), F.col("n"), F.col("k3"), F.col("k4"), F.lit(n), F.lit(0.5**0.5), 250).alias(f"d{n}") for n in (100, 46)], stats.expected_max_sharpe(F.lit(100), F.lit((0.5 / 250) ** 0.5)).alias("e")).first()
    assert (round(got.d100, 4), round(got.d46, 4), round(got.e, 4)) == (0.9004, 0.9505, 0.1132)
    eta = spark.createDataFrame([(0.2, 12, 2.88), (-0.2, 12, 4.17), (0.2, 250, 12.92)], "rho double, q int, want double")
    assert all(round(r.got, 2) == r.want for r in eta.select("want", stats.eta_from_rho(F.col("rho"), F.col("q")).alias("got")).collect())
    base = [-(3**0.5), 0, 0, 0, 0, 3**0.5]
    rets = spark.createDataFrame([(i, base[i % 6] + 1.0) for i in range(60)], "t int, ret double")
    r = stats.sharpe_se(rets, lag=0).first()
    assert round(r.se_iid, 3) == 0.158 and r.se_hac == pytest.approx(r.se_iid)
    p = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "id int, p double")
    b = stats.benjamini_hochberg(p).orderBy("id").collect()
    assert [x.rejected for x in b] == [True, True, True, False] and [x.adjusted for x in b] == pytest.approx([0.04, 0.04, 0.04, 0.5])


def test_pbo_of_noise_and_skill(spark):
    import random

    rng = random.Random(1)
    rows = [(t, k, rng.gauss(0.8 if k == 0 else 0, 1)) for t in range(240) for k in range(6)]
    s = stats.pbo(stats.cscv(spark.createDataFrame(rows, "t int, trial int, ret double"), 8)).first()
    assert s.n_splits == 70 and s.pbo < 0.1
    with pytest.raises(ValueError):
        stats.block_sums(spark.createDataFrame(rows, "t int, trial int, ret double"), 5)


def test_unpivot_and_cashtags(spark):
    w = spark.createDataFrame([("T", D(2020, 1, 1), 0.0, 2.0), ("T", D(2020, 1, 2), 0.5, 0.0)], "ticker string, date date, dividend double, split double")
    assert {(r.kind, r.value) for r in unpivot_actions(w).collect()} == {("split", 2.0), ("dividend", 0.5)}
    x = spark.createDataFrame([("buy $AAPL and $TSLA, not $toolong",)], "x string")
    assert x.select(evidence.cashtags(F.col("x")).alias("t")).first().t == ["AAPL", "TSLA"]


def test_sharpe_se_of_a_long_series_has_all_lags(spark):
    rng = np.random.default_rng(11)
    x = {"long": np.convolve(rng.normal(0.001, 0.01, 2950), np.ones(10), "valid"), "short": rng.normal(0, 0.01, 30)}
    rows = [(k, i, float(r)) for k, v in x.items() for i, r in enumerate(v)]
    got = {r.ticker: r for r in stats.sharpe_se(spark.createDataFrame(rows, "ticker string, t int, ret double"), "ticker").collect()}
    for k, lag in (("long", 8), ("short", 3)):
        r, n = x[k], len(x[k])
        h = np.stack([r - r.mean(), (r - r.mean()) ** 2 - r.var()])
        omega = h @ h.T / n
        for j in range(1, lag + 1):
            g = h[:, j:] @ h[:, :-j].T / n
            omega += (1 - j / (lag + 1)) * (g + g.T)
        grad = np.array([1 / r.std(), -r.mean() / (2 * r.std() ** 3)])
        assert got[k].lag == lag and got[k].se_hac == pytest.approx(np.sqrt(grad @ omega @ grad / n))


# ------------------------------------------------------------------ gates: each must be able to fail

SESSIONS = [D(2024, 1, 2) + dt.timedelta(i) for i in range(120) if (D(2024, 1, 2) + dt.timedelta(i)).weekday() < 5]


def gate_store(spark, days=None, tickers=("X",), stamp=None):
    """Two providers' bars of each ticker; the second is off by less than a thousandth of a basis point."""
    rows = []
    for k in tickers:
        for i, day in enumerate(days or SESSIONS):
            close = 100 + 0.1 * i
            for p, c in (("one", close), ("two", round(close * (1 + ((i % 5) - 2) * 1e-7), 6))):
                rows.append((k, day, 0.99 * c, 1.01 * c, 0.98 * c, c, 1e6 + i, p))
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double, provider string")
    return df.withColumn("first_public_at", temporal.bar_public_at(F.col("date")) if stamp is None else stamp)


def calendar(spark):
    return spark.createDataFrame([(d,) for d in SESSIONS], "date date")


def names(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "ticker string")


def no_actions(spark):
    return spark.createDataFrame([], "ticker string, ex_date date, kind string, value double, provider string, first_public_at timestamp")


def test_coverage_fails_for_truncated_and_broken_series(spark):
    whole = gates.coverage(gate_store(spark), names(spark, "X"), calendar(spark)).first()
    cut = gates.coverage(gate_store(spark, SESSIONS[:30]), names(spark, "X"), calendar(spark)).first()
    holes = [d for i, d in enumerate(SESSIONS) if i not in (10, 11, 40, 50, 60)]
    broken = gates.coverage(gate_store(spark, holes), names(spark, "X"), calendar(spark)).first()
    gone = gates.coverage(gate_store(spark), names(spark, "X", "Y"), calendar(spark)).first()
    assert whole.passed and not cut.passed and f"X/one: {len(SESSIONS) - 30} missing, {SESSIONS[30]}" in cut.detail
    assert "X/one: 5 missing" in broken.detail and gone.detail == "Y: no data"
    # a session that is not over yet is not missing
    now = f"{SESSIONS[29]} 23:00:00"
    assert gates.coverage(gate_store(spark, SESSIONS[:30]), names(spark, "X"), calendar(spark), now=now).first().passed


def test_phantom_and_reconcile_gates(spark):
    b = gate_store(spark, [*SESSIONS, D(2024, 1, 6)])
    assert not gates.phantom_sessions(b, names(spark, "X"), calendar(spark)).first().passed
    assert gates.phantom_sessions(gate_store(spark), names(spark, "X"), calendar(spark)).first().passed
    one, two = (gate_store(spark).where(F.col("provider") == p) for p in ("one", "two"))
    assert gates.reconcile(one, two, names(spark, "X")).first().passed
    ten = two.withColumn("close", F.col("close") * F.when(F.col("date") == F.lit(SESSIONS[9]), 10).otherwise(1))
    assert "max_bps" in gates.reconcile(one, ten, names(spark, "X")).first().detail
    assert "MIRROR" in gates.reconcile(one, one, names(spark, "X")).first().detail
    assert "no usable rows" in gates.reconcile(one, two, names(spark, "X", "Y")).first().detail


def test_stamps_before_the_opening_fail(spark):
    early = F.when(F.col("date") == F.lit(SESSIONS[3]), temporal.public_at(F.col("date"), "09:29:00")).otherwise(temporal.bar_public_at(F.col("date")))
    row = gates.point_in_time(gate_store(spark, stamp=early), no_actions(spark), names(spark, "X")).first()
    assert not row.passed and row.n_problems == 4 and "public before its opening" in row.detail
    assert gates.point_in_time(gate_store(spark), no_actions(spark), names(spark, "X")).first().passed
    acts = spark.createDataFrame([("X", SESSIONS[5], "split", 2.0)], "ticker string, ex_date date, kind string, value double").withColumn("first_public_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert "split" in gates.point_in_time(gate_store(spark), acts, names(spark, "X")).first().detail


def test_corporate_actions_need_a_reference(spark):
    b = gate_store(spark).where("provider = 'one'")
    ref = b.select("ticker", "date", (F.col("close") * 7).alias("close"))
    assert gates.corporate_actions(b, no_actions(spark), ref, names(spark, "X")).first().passed
    assert not gates.corporate_actions(b, no_actions(spark), ref.where("false"), names(spark, "X")).first().passed
    ten = ref.withColumn("close", F.col("close") * F.when(F.col("date") == F.lit(SESSIONS[9]), 10).otherwise(1))
    assert "max_bps" in gates.corporate_actions(b, no_actions(spark), ten, names(spark, "X")).first().detail


def test_printed_prices_around_splits(spark):
    """What the tape printed before and on three ex-dates, recovered from stored prices that are split-adjusted."""
    splits = {"NVDA": (D(2024, 6, 10), 10.0), "TSLA": (D(2022, 8, 25), 3.0), "AAPL": (D(2020, 8, 31), 4.0)}
    rows = [(k, dt.date.fromisoformat(d), p / (splits[k][1] if dt.date.fromisoformat(d) < splits[k][0] else 1)) for k, d, p in quality.PRINTED]
    b = spark.createDataFrame(rows, "ticker string, date date, close double")
    b = b.withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    acts = lambda shift: spark.createDataFrame([(k, d + dt.timedelta(shift), "split", v, None) for k, (d, v) in splits.items()], "ticker string, ex_date date, kind string, value double, first_public_at timestamp")
    anchors = spark.createDataFrame([(k, dt.date.fromisoformat(d), p) for k, d, p in quality.PRINTED], "ticker string, date date, printed double")
    assert gates.printed_prices(b, acts(0), anchors).first().passed
    assert gates.printed_prices(b, acts(1), anchors).first().n_problems == 3  # an ex-date one session late
    assert "NVDA 2024-06-07: no bar" in gates.printed_prices(b.where("ticker <> 'NVDA'"), acts(0), anchors).first().detail
    assert not gates.printed_prices(b, acts(0), anchors.where("false")).first().passed


def test_gates_run_in_order_and_need_two_providers(spark):
    got = gates.run(gate_store(spark).where("provider = 'one'"), no_actions(spark), names(spark, "X"), calendar(spark), gate_store(spark).where("false").select("ticker", "date", "close"), spark.createDataFrame([], "ticker string, date date, printed double")).orderBy("i").collect()
    assert [r.gate for r in got] == list(gates.ORDER)
    assert [r.passed for r in got] == [True, True, False, True, False, False] and got[2].detail == "only 1 providers"
