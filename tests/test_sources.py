import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barograph.sources import connectors
from barograph.sources.store import Registry, Store, new_ingest_id

DAYS = ["2023-12-29", "2024-01-02", "2024-01-03"]


@pytest.fixture(scope="module")
def payloads(spark, tmp_path_factory):
    """Four shapes of the same three bars."""
    root = tmp_path_factory.mktemp("payloads")
    short = [dict(t=d, o=1.0, h=3.0, l=0.5, c=2.0 + i, v=10.0, a=1.5 + i) for i, d in enumerate(DAYS)]
    plain = [dict(date=f"{r['t']}T00:00:00Z", open=r["o"], high=r["h"], low=r["l"], close=r["c"], volume=r["v"]) for r in short]
    title = [{**{k.title(): v for k, v in r.items()}, "Dividends": 0.5 if i == 1 else 0, "Stock Splits": 2.0 if i == 2 else 0} for i, r in enumerate(plain)]
    for name, files in {
        "rows": {"X": {"data": short[::-1]}, "EMPTY": {"data": []}, "PART": {"data": [{"t": DAYS[0], "o": 1.0}]}},
        "list": {"X": plain},
        "paged": {"X.0": {"bars": {"X": short[:2]}, "next_page_token": "p2"}, "X.p2": {"bars": {"X": short[2:]}, "next_page_token": None}},
        "history": {"X": {"history": title}},
    }.items():
        (root / name).mkdir()
        for f, payload in files.items():
            (root / name / f"{f}.json").write_text(json.dumps(payload))
    (root / "rows" / "HTML.json").write_text("<html>too many requests</html>")
    connectors.register(spark)

    def read(shape, kind="recorded_bars", tickers="X", **options):
        r = spark.read.format(kind).option("path", str(root / shape)).option("shape", shape).option("tickers", tickers).option("pause", "0")
        for k, v in options.items():
            r = r.option(k, v)
        return r.load()

    return read


@pytest.mark.parametrize("shape", list(connectors.SHAPES))
def test_shapes_give_the_same_bars(payloads, shape):
    rows = payloads(shape).orderBy("date").collect()
    assert [(str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(d, 1.0, 3.0, 0.5, 2.0 + i, 10.0) for i, d in enumerate(DAYS)]
    assert payloads(shape, start="2024-01-01", end="2024-01-02").count() == 1


def test_actions_and_reference(payloads):
    got = [(str(r.ex_date), r.kind, r.value) for r in payloads("history", "recorded_actions").orderBy("ex_date").collect()]
    assert got == [(DAYS[1], "dividend", 0.5), (DAYS[2], "split", 2.0)]
    assert payloads("rows", "recorded_actions").count() == 0
    assert [r.close for r in payloads("rows", "recorded_reference").orderBy("date").collect()] == [1.5, 2.5, 3.5]


@pytest.mark.parametrize("ticker, message", [("EMPTY", "no rows"), ("PART", "KeyError"), ("HTML", "JSONDecodeError"), ("GONE", "FileNotFoundError")])
def test_partial_payloads_are_errors(payloads, ticker, message):
    with pytest.raises(Exception, match=message):
        payloads("rows", tickers=f"X,{ticker}").collect()
    rows = payloads("rows", tickers=f"X,{ticker}", on_error="record")
    assert rows.where("error is null").count() == 3 and message in rows.where(F.col("ticker") == ticker).first().error


def test_ingest_keeps_a_ledger_and_manifest(spark, payloads, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    scans = {"one": (payloads("rows", tickers="X,HTML", on_error="record"), payloads("rows", "recorded_actions", tickers="X,HTML", on_error="record")), "two": (payloads("history"), payloads("history", "recorded_actions"))}
    ledger = {(r.provider, r.ticker): r for r in store_rows(store, scans)}
    assert ledger["one", "X"].ok and ledger["one", "X"].n_bars == 3 and not ledger["one", "HTML"].ok and "JSON" in ledger["one", "HTML"].error
    assert ledger["two", "X"].n_actions == 2 and ledger["two", "HTML"].error == "no rows"
    assert store.bars(ticker="X").count() == 6 and store.actions(ticker="X").count() == 2
    store.views()
    assert spark.sql("select count(distinct provider) as n from bars where price_basis <> 'raw'").first().n == 1
    assert spark.sql("select count(*) as n from bars b join actions a on a.ticker = b.ticker and a.ex_date = b.date").first().n == 4
    gates = spark.createDataFrame([("coverage", True)], "gate string, passed boolean")
    written = store.write_manifest(f"file://{tmp_path}/manifest.json", gates)
    again = json.loads((tmp_path / "manifest.json").read_text())
    assert again == json.loads(json.dumps(written)) and again["n_files"] == len(again["files"]) > 0 and again["gates"] == [{"gate": "coverage", "passed": True}]
    before = store.payload_digest().first().digest
    assert before == store.payload_digest().first().digest and len(before) == 64
    store.write_bars(payloads("rows").drop("error"), "one", new_ingest_id(), dt.datetime(2024, 3, 1))
    assert store.payload_digest().first().digest != before and store.bars(ticker="X").count() == 6


def store_rows(store, scans):
    from barograph.sources.store import ingest

    return ingest(store, scans, ["X", "HTML"], "i1", dt.datetime(2024, 2, 1), raw=("two",)).collect()


def test_registry():
    r = Registry()
    r.add("first", connectors.RecordedBars)
    r.add("second", connectors.RecordedActions, lambda: False)
    assert r.available() == ["first"] and r.get("second") is connectors.RecordedActions
    with pytest.raises(KeyError):
        r.get("third")


def test_ledger_reads_only_its_end(spark, tmp_path, monkeypatch):
    from barograph.sources import ledger

    monkeypatch.setattr(ledger, "TAIL", 7)
    log = ledger.Ledger(f"{tmp_path}/trials.jsonl")
    assert log.last() == ledger.GENESIS
    seals = [log.append("a", {"k": i}, {"x": 0.5 * i}, "né")["hash"] for i in range(5)]
    assert log.last() == seals[-1] and set(json.loads(log.path.read_text().splitlines()[0])) == set(ledger.FIELDS)
    log.path.write_text(log.path.read_text() + "\n\n")
    log.append("b", {}, {})
    row = ledger.verdict(ledger.verify(ledger.records(spark, f"file://{log.path}"))).first()
    assert row.ok and row.n == 6


def test_entry_leaves_out_a_missing_package(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "barograph", tmp_path / "barograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()), len(e.oracle_sql()) > 80)"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "SPARK"))}, check=False)
    assert out.stdout.split()[1:] == ["False", "True"], out.stderr
