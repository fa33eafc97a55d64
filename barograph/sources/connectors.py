"""Market-data payloads as Python data sources: one partition a ticker, read from recorded JSON.

Formats: ``recorded_bars``, ``recorded_actions`` and ``recorded_reference`` (a provider's own adjusted closes).  Options:
tickers (by comma), path (a folder), shape, start, end, pause; allow_empty for tickers without rows, and on_error:
``record`` gives a failed ticker one row with its error instead of failing the scan.

A payload is the file TICKER.json, or pages TICKER.0.json and on.  It is fetched once a ticker and worker, and again
after pauses that double; an empty one is an error.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, error string"
ACTIONS = "ticker string, ex_date date, kind string, value double, error string"
REFERENCE = "ticker string, date date, close double, error string"

_SHORT = {"date": "t", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "adjusted": "a"}
_PLAIN = {c: c for c in _SHORT}
_TITLE = {c: c.title() for c in _SHORT}
# Where each shape of payload has its rows and how it calls their fields, and whether prices are raw.
SHAPES = {
    "rows": (("data",), _SHORT, False),
    "list": ((), _PLAIN, True),
    "paged": (("bars", "{ticker}"), _SHORT, True),
    "history": (("history",), _TITLE, False),
}
# Fields of a history that are actions.
ACTION_FIELDS = {"dividend": "Dividends", "split": "Stock Splits"}


@lru_cache(maxsize=64)
def fetch(path: str, attempts: int = 4, pause: float = 0.5):
    """A JSON payload, tried again after pauses that double."""
    for i in range(attempts):
        try:
            with open(path) as f:
                return json.load(f)
        except (OSError, ValueError):
            if i + 1 == attempts:
                raise
            time.sleep(pause * 2**i)
    raise AssertionError


class _Ticker(InputPartition):
    def __init__(self, ticker: str):
        self.ticker = ticker


class _Reader(DataSourceReader):
    """Rows of one ticker, between start and end, in the order of their dates."""

    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width
        self.place, self.names, _ = SHAPES[options.get("shape", "rows")]

    def partitions(self) -> list[InputPartition]:
        return [_Ticker(t.strip().upper()) for t in self.options["tickers"].split(",")]

    def _pages(self, ticker: str) -> Iterator[dict]:
        page: int | str | None = 0
        get = lambda name: fetch(f"{self.options['path']}/{name}.json", int(self.options.get("attempts", "4")), float(self.options.get("pause", "0.5")))
        if self.options.get("shape", "rows") != "paged":
            yield from self._rows(get(ticker), ticker)
            return
        while page is not None:
            payload = get(f"{ticker}.{page}")
            yield from self._rows(payload, ticker)
            page = payload.get("next_page_token")

    def _rows(self, payload, ticker: str) -> list[dict]:
        for step in self.place:
            payload = payload[step.format(ticker=ticker)]
        return payload

    def _inside(self, ticker: str) -> list[tuple[dt.date, dict]]:
        day = lambda x: dt.date.fromisoformat(x[:10])
        start, end = day(self.options.get("start", "1900-01-01")), day(self.options.get("end", "2999-12-31"))
        rows = sorted(((day(r[self.names["date"]]), i, r) for i, r in enumerate(self._pages(ticker))), key=lambda x: x[:2])
        if not rows and self.options.get("allow_empty") != "true":
            raise ValueError(f"no rows for {ticker}")
        return [(d, r) for d, _, r in rows if start <= d <= end]

    def read(self, partition: _Ticker) -> Iterator[tuple]:
        ticker = partition.ticker
        try:
            out = [(ticker, *row, None) for d, r in self._inside(ticker) for row in self.fields(d, r)]
        except Exception as e:
            if self.options.get("on_error") != "record":
                raise
            out = [(ticker, *(None,) * self.width, f"{type(e).__name__}: {e}"[:200])]
        yield from out

    def fields(self, day: dt.date, row: dict) -> Iterator[tuple]:
        raise NotImplementedError


class _Bars(_Reader):
    def fields(self, day, row):
        yield day, *(float(row[self.names[c]]) for c in ("open", "high", "low", "close", "volume"))


class _Actions(_Reader):
    def fields(self, day, row):
        for kind, name in ACTION_FIELDS.items():
            if row.get(name):  # zero is no action
                yield day, kind, float(row[name])


class _Reference(_Reader):
    def fields(self, day, row):
        if self.names["adjusted"] in row:
            yield day, float(row[self.names["adjusted"]])


def _source(label: str, ddl: str, reader_of: type) -> type:
    class Recorded(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ddl

        def reader(self, schema) -> _Reader:
            return reader_of(dict(self.options), ddl.count(",") - 1)

    return Recorded


RecordedBars = _source("recorded_bars", BARS, _Bars)
RecordedActions = _source("recorded_actions", ACTIONS, _Actions)
RecordedReference = _source("recorded_reference", REFERENCE, _Reference)


def register(spark: SparkSession) -> None:
    for source in (RecordedBars, RecordedActions, RecordedReference):
        spark.dataSource.register(source)
