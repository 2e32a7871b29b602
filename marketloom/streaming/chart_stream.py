"""Charts that go on: a chart's fold as a stateful operator, whose state a stored chart can begin with.

A chart's state is its open column and a few numbers, kept as JSON text. Columns are given when the next one begins; what is still
open is in the state. Bars of a chart come in order of seq, from micro-batch to micro-batch. Grid scales need the span of prices and
the box size that the chart will have, as its boxes can't change while it is drawn.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketloom.functions.folds import fold
from marketloom.operators.pnf import columns as P

FIXED = ("chart", "rules", "grid", "a", "d")


def new_chart(name: str, rules: P.PnfRules, span: tuple[float, float] | None) -> P.Chart:
    if rules.scaling == "log":
        return P.FrozenChart(name, rules)
    if span is None:
        raise ValueError(f"charts of scale {rules.scaling} need the span of their prices")
    return P.GridChart(name, rules, *span)


def saved(chart: P.Chart) -> str:
    kept = {k: v for k, v in vars(chart).items() if k not in FIXED}
    kept["column"] = vars(chart.column) if chart.column is not None else None
    return json.dumps(kept)


def restored(chart: P.Chart, state: str) -> P.Chart:
    kept = json.loads(state)
    column = kept.pop("column")
    vars(chart).update(kept)
    chart.column = P.Column(**column) if column is not None else None
    return chart


class _States:
    """What a chart's fold ends in."""

    def __init__(self, chart: P.Chart):
        self.chart = chart

    def step(self, rows: pd.DataFrame) -> list:
        self.chart.step(rows)
        return []

    def end(self) -> list[tuple]:
        return [(self.chart.chart, saved(self.chart))]


def chart_states(bars: DataFrame, rules: P.PnfRules, span: tuple[float, float] | None = None) -> DataFrame:
    """chart_id and state of stored bars (chart_id, seq, prices): what live_columns() can begin with."""
    return fold(bars, "chart_id", ["seq"], "chart_id string, state string", lambda chart: _States(new_chart(chart, rules, span)))


class ChartProcessor(StatefulProcessor):
    def __init__(self, rules: P.PnfRules, span: tuple[float, float] | None):
        self.rules, self.span = rules, span

    def init(self, handle) -> None:
        self.kept = handle.getValueState("chart", "state STRING")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.kept.update((str(initialState["state"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chart = new_chart(key[0], self.rules, self.span)
        if self.kept.exists():
            restored(chart, self.kept.get()[0])
        out = chart.step(pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable"))
        self.kept.update((saved(chart),))
        if out:
            frame = pd.DataFrame(out, columns=["chart_id", "column_index", "trend", "start_seq", "end_seq", "boxes", "trends", "actions", "series"])
            frame["series"] = [[dict(zip(("seq", "box_value", "trend", "filled"), x)) for x in s] for s in frame["series"]]
            yield frame

    def close(self) -> None:
        pass


def live_columns(bars: DataFrame, rules: P.PnfRules = P.PnfRules(), span: tuple[float, float] | None = None, states: DataFrame | None = None) -> DataFrame:
    """Columns of streaming bars (chart_id, seq, the method's prices) as they close. states: chart_states() of what came before. Needs the RocksDB state store."""
    names = [c for c in P.METHODS["ohlc"] if c in bars.columns and (c in P.METHODS[rules.method] or rules.scaling == "log")]
    rows = bars.select(F.col("chart_id").cast("string").alias("chart_id"), "seq", *names)
    start = states.groupBy("chart_id") if states is not None else None
    return rows.groupBy("chart_id").transformWithStateInPandas(ChartProcessor(rules, span), outputStructType=P.COLUMNS, outputMode="append", timeMode="none", initialState=start)
