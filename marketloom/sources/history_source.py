"""History responses as a Spark data source: one partition a symbol and request range, symbols and times pruned by pushed filters.

spark.dataSource.register(HistorySource); spark.read.format("history").options(path=..., symbols="A,B", resolution="5S", start=..., end=...).load()

A range is one request, as long as the resolution allows, and its response lies in a file of its own (`response_name`). Ranges are cut
from `start` on, whatever filters say, so a request stays the same; those that no filter leaves are not opened. Responses that are missing, not
JSON or not ok give no rows. Reading needs a store that pyarrow.fs opens by URI. Needs spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marketloom.functions.timebucket import chunk_days

SCHEMA = "timestamp BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, symbol STRING"


def response_name(symbol: str, resolution: str, start: int, end: int) -> str:
    return f"{quote(symbol, safe='')}-{resolution}-{start}-{end}.json"


def ranges(start: int, end: int, resolution: str) -> list[tuple[int, int]]:
    """Request ranges of [start, end]; none if it is empty."""
    step = chunk_days(resolution) * 86_400
    return [(lo, min(end, lo + step - 1)) for lo in range(start, end + 1, step)]


@dataclass
class Range(InputPartition):
    symbol: str
    start: int
    end: int
    low: int
    high: int


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.resolution = options["path"].rstrip("/"), options["resolution"]
        self.symbols = list(dict.fromkeys(s.strip() for s in options["symbols"].split(",") if s.strip()))
        self.start, self.end = int(options["start"]), int(options["end"])
        self.low, self.high = self.start, self.end

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, value = f.attribute if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if name == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == value]
            elif name == ("symbol",) and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in value]
            elif name == ("timestamp",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, value), min(self.high, value)
            elif name == ("timestamp",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            elif name == ("timestamp",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[Range]:
        met = [(lo, hi) for lo, hi in ranges(self.start, self.end, self.resolution) if lo <= self.high and hi >= self.low]
        return [Range(s, lo, hi, max(lo, self.low), min(hi, self.high)) for s in self.symbols for lo, hi in met]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if part is None:  # no range is left
            return

        store, base = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        try:
            with store.open_input_file(f"{base}/{response_name(part.symbol, self.resolution, part.start, part.end)}") as f:
                said = json.loads(f.read())
        except (FileNotFoundError, ValueError):
            return
        candles = said.get("candles") if isinstance(said, dict) and said.get("s") == "ok" else None
        rows = [c for c in candles or [] if len(c) >= 6 and c[0] is not None and part.low <= c[0] <= part.high]
        cols = list(zip(*(c[:6] for c in rows))) if rows else [[]] * 6
        kinds = [pa.int64(), *[pa.float64()] * 4, pa.int64()]
        number = [(lambda x: None if x is None else int(x)) if k == pa.int64() else (lambda x: None if x is None else float(x)) for k in kinds]
        arrays = [pa.array([f(x) for x in c], k) for c, k, f in zip(cols, kinds, number)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([part.symbol] * len(rows), pa.string())], names)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        missing = [k for k in ("path", "symbols", "resolution", "start", "end") if k not in self.options]
        if missing:
            raise ValueError(f"options lack {missing}")
        return HistoryReader(dict(self.options))
