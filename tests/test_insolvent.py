"""A book that has lost more than all: with the reference's rule, and as the SQL of b17 has it."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from barograph import catalog
from barograph.operators import environment

DIR = "/root/testdata/sf0.001"


def test_query_with_an_insolvent_book_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{DIR}/events.parquet'")
    df = catalog.queries()["b17_environment"](spark, DIR)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.oracle_sql()['b17_environment']})").fetchall()
    assert any(r[cols.index("value")] < 0 for r in want)  # the case is there
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def ruin(spark):
    """A ticker that falls to almost nothing, with costs beyond what is left, and then rises."""
    opens = [10.0] * 5 + [0.01, 0.02, 0.04, 0.08]
    rows = [("k", f"2024-01-{i + 1:02d}", "a", x, 0.0, 1e9, 0.5, 1.0) for i, x in enumerate(opens)]
    return spark.createDataFrame(rows, "k string, date string, ticker string, open double, ret double, adv double, vol double, action double").withColumn("date", F.to_date("date"))


def test_solvent_books_stop_trading_and_others_have_undefined_costs(ruin):
    held = environment.simulate(ruin, "k", lookback=3, spread=500.0).orderBy("t").collect()
    assert held[0].value < 0 and math.isnan(held[0].reward)
    assert all(r.turnover == 0 and r.cost == 0 and r.net == r.gross for r in held[1:])
    free = environment.simulate(ruin, "k", lookback=3, spread=500.0, solvent=False).orderBy("t").collect()
    assert free[0].value == held[0].value
    assert free[1].turnover > 0 and all(math.isnan(r.cost) and math.isnan(r.value) for r in free[1:])
    assert all(r.n_capped == 1 for r in free[2:])
