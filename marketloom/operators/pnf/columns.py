"""Columns of X and O from price bars.

A chart is a fold over its bars, in order, whose state is its open column; charts run side by side and no task holds more of a chart
than one batch of bars. Prices of the step-frozen scale are whole ticks of 0.01 and its boxes are computed in integers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.folds import fold

METHODS = {"cl": ["close"], "h/l": ["high", "low"], "l/h": ["high", "low"], "hlc": ["high", "low", "close"], "ohlc": ["open", "high", "low", "close"]}
COLUMNS = "chart_id string, column_index int, trend int, start_seq bigint, end_seq bigint, boxes array<double>, trends array<int>, actions array<bigint>, series array<struct<seq:bigint,box_value:double,trend:int,filled:int>>"


@dataclass(frozen=True)
class PnfRules:
    """atr_bars: how many of a chart's last bars give the box size of `atr`; None for all."""

    method: str = "cl"
    reversal: int = 3
    boxsize: float = 1.0
    scaling: str = "log"
    atr_bars: int | None = None

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {sorted(METHODS)}")
        if self.scaling not in ("log", "abs", "log_compounding", "cla", "atr"):
            raise ValueError(f"unknown scaling: {self.scaling!r}")
        if self.reversal < 1 or int(self.reversal) != self.reversal:
            raise ValueError("reversal must be a whole number above 0")
        if self.boxsize <= 0:
            raise ValueError("boxsize must be above 0")


def title(rules: PnfRules, label: str | None = None) -> str:
    """How a chart of these rules is headed."""
    size = {"log": "%", "log_compounding": "%", "cla": "@50"}.get(rules.scaling, "")
    text = f"Point & Figure ({rules.scaling}|{rules.method}) {rules.boxsize}{size} x {rules.reversal}"
    return text if label is None else f"{text} | {label}"


def dated(bars: DataFrame, date: str = "date") -> DataFrame:
    """bars (chart_id, date) with `ts`, `seq` and `time_step`: dates as timestamps, the earliest first, and their rank from 0.

    Texts of a chart that are not all dates give no timestamps, and its rank is by the text's place in time order as far as known; the step is
    D if all neighbouring dates lie whole days apart, m if not, and null without dates.
    """
    w = Window.partitionBy("chart_id")
    df = bars.withColumn("ts", F.expr(f"try_to_timestamp(cast(`{date}` AS string))"))
    df = df.withColumn("ts", F.when(F.count_if(F.col("ts").isNull()).over(w) == 0, F.col("ts")))
    order = w.orderBy("ts", date)
    df = df.withColumns({"seq": (F.row_number().over(order) - 1).cast("bigint"), "_gap": F.col("ts").cast("bigint") - F.lag(F.col("ts").cast("bigint")).over(order)})
    part = F.count_if(F.pmod("_gap", F.lit(86_400)) != 0).over(w)
    return df.withColumn("time_step", F.when(F.col("ts").isNotNull(), F.when(part > 0, "m").otherwise("D"))).drop("_gap")


def mean_true_range(bars: DataFrame, last: int | None = None) -> DataFrame:
    """chart_id and `atr`: the mean true range of each chart's last bars, or of all; a chart's first bar has none."""
    w = Window.partitionBy("chart_id").orderBy("seq")
    before = F.lag("close").over(w)
    true = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = bars.withColumn("_t", F.when(before.isNotNull(), true)).filter("_t IS NOT NULL")
    if last is not None:
        df = df.withColumn("_k", F.row_number().over(Window.partitionBy("chart_id").orderBy(F.desc("seq")))).filter(F.col("_k") <= last)
    return df.groupBy("chart_id").agg(F.avg("_t").alias("atr"))


@dataclass
class Column:
    trend: int
    start: int
    end: int
    boxes: list = field(default_factory=list)
    trends: list = field(default_factory=list)
    actions: list = field(default_factory=list)
    series: list = field(default_factory=list)


class Chart:
    """What both folds share: columns are given when the next one begins."""

    def __init__(self, chart: str, rules: PnfRules):
        self.chart, self.rules, self.number, self.column = chart, rules, 0, None

    def done(self, value) -> tuple:
        c = self.column
        out = (self.chart, self.number, c.trend, c.start, c.end, [value(b) for b in c.boxes], c.trends, c.actions, [(s, value(b), t, n) for s, b, t, n in c.series])
        self.number, self.column = self.number + 1, None
        return out


def order_of_prices(bar: dict, method: str) -> list:
    """The prices of a bar in the order in which the step-frozen fold tries them."""
    names = {"cl": ["close"], "h/l": ["high", "low"], "l/h": ["low", "high"], "hlc": ["high", "low", "close"]}.get(method)
    if method == "ohlc":
        full = all(bar[k] is not None for k in METHODS["ohlc"])
        names = ["open", "low", "high", "close"] if full and bar["open"] <= bar["close"] else ["open", "high", "low", "close"]
    return [bar[k] for k in names if bar[k] is not None]


def ticks_of(values: np.ndarray) -> list:
    """Prices in hundredths, halves upwards as the number is written; None where one is missing."""
    values = np.asarray(values, float)
    if (values[np.isfinite(values)] <= 0).any():
        raise ValueError("prices must be above 0")
    known = np.isfinite(values)
    near = np.where(known, values, 1.0) * 100 + 0.5
    out = np.floor(near).astype(np.int64).tolist()
    for i in np.flatnonzero(np.abs(near - np.round(near)) < 1e-6).tolist():
        out[i] = int(Fraction(str(float(values[i]))) * 100 + Fraction(1, 2)) if known[i] else None
    return [x if k else None for x, k in zip(out, known.tolist())]


class FrozenChart(Chart):
    """Boxes of a percentage of the last box, which holds for a bar; a bar acts once at most."""

    def __init__(self, chart: str, rules: PnfRules):
        super().__init__(chart, rules)
        part = Fraction(str(rules.boxsize / 100))
        self.a, self.d, self.ref, self.began = part.numerator, part.denominator, None, None

    def count(self, price: int, ref: int) -> int:
        """Boxes from ref to price, signed."""
        n = abs(price - ref) * self.d // (ref * self.a)
        return n if price >= ref else -n

    def boxes(self, ref: int, n: int) -> list[int]:
        sign = 1 if n > 0 else -1
        return [(2 * ref * (self.d + sign * j * self.a) + self.d) // (2 * self.d) for j in range(1, abs(n) + 1)]

    def checked(self, bar: dict) -> dict:
        high, low = bar.get("high"), bar.get("low")
        if high is not None and low is not None and high < low:
            raise ValueError("high must be at least low")
        for name in {"hlc": ["close"], "ohlc": ["open", "close"]}.get(self.rules.method, []):
            price = bar[name]
            if price is not None and ((high is not None and price > high) or (low is not None and price < low)):
                raise ValueError(f"{name} must lie between low and high")
        return bar

    def prices(self, bar: dict) -> list:
        """What a bar tries while a column is open. For `hlc` the close decides and the extreme goes."""
        if self.rules.method != "hlc":
            return order_of_prices(bar, self.rules.method)
        if bar["close"] is None:
            return []
        trend = self.column.trend
        n = self.count(bar["close"], self.column.boxes[-1]) * trend
        ahead, back = ("high", "low") if trend > 0 else ("low", "high")
        side = ahead if n >= 1 and bar[ahead] is not None else back if -n >= self.rules.reversal and bar[back] is not None else None
        return [bar[side]] if side else []

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        names = [k for k in METHODS["ohlc"] if k in rows]
        seqs, columns = rows["seq"].to_numpy().tolist(), {k: ticks_of(rows[k].to_numpy(float)) for k in names}
        out, reversal = [], self.rules.reversal
        if self.rules.method == "cl":
            bars = (([p] if p is not None else []) for p in columns["close"])
        else:
            bars = (self.checked(dict(zip(names, values))) for values in zip(*columns.values()))
        for seq, bar in zip(seqs, bars):
            c = self.column
            if c is None:
                for price in bar if self.rules.method == "cl" else order_of_prices(bar, self.rules.method):
                    if self.ref is None:
                        self.ref, self.began = price, seq
                    elif abs(n := self.count(price, self.ref)) >= reversal:
                        self.column = Column(1 if n > 0 else -1, self.began, seq, self.boxes(self.ref, n))
                        break
                continue
            last, trend = c.boxes[-1], c.trend
            for price in bar if self.rules.method == "cl" else self.prices(bar):
                n = self.count(price, last)
                if n * trend >= 1:
                    c.boxes += self.boxes(last, n)
                    c.end = seq
                    break
                if -n * trend >= reversal:
                    out.append(self.end()[0])
                    self.column = Column(-trend, seq, seq, self.boxes(last, n))
                    break
        return out

    def end(self) -> list[tuple]:
        c = self.column
        if c is None:
            return []
        c.trends, c.actions = [c.trend] * len(c.boxes), [c.end] * len(c.boxes)
        c.series = [(c.end, c.boxes[-1], c.trend, len(c.boxes))]
        return [self.done(lambda ticks: ticks / 100)]


def scale(low: float, high: float, rules: PnfRules, over: int = 20) -> np.ndarray:
    """The grid of boxes that spans [low, high] with `over` boxes beyond either end."""
    b = rules.boxsize
    if rules.scaling in ("abs", "atr"):
        digits = len(str(b).split(".")[-1])
        b = round(b, digits)
        first = max(0, int(np.floor(low / b)) - over)
        return np.round(np.arange(first, int(np.floor(high / b)) + over + 1) * b, digits)
    if rules.scaling == "log_compounding":
        step = np.log(1 + b / 100)
        first = max(0, int(np.floor((np.log(low) - np.log(1e-4)) / step)) - over)
        last = int(np.floor((np.log(high) - np.log(1e-4)) / step)) + over
        values = np.exp(np.log(1e-4) + np.arange(first, last + 1) * step)
        if b < 0.1:
            return values
        digits = np.select([values < 0.1, values < 1, values < 10, values < 100], [17, 5, 4, 3], 2)
        return np.array([round(float(v), int(d)) for v, d in zip(values, digits)])
    # Classic: steps of 0.2, 0.5 and 1 between 6, 14, 29 and 60, times the box size, and so on by decades from 0.0006 on.
    unit = np.concatenate([np.arange(lo, hi - step * b, step * b) for lo, hi, step in ((6, 14, 0.2), (14, 29, 0.5), (29, 60, 1.0))]) / 10_000.0
    values, decade = np.concatenate([[0.0], unit]), 1
    while values[-over - 1] < high:
        decade *= 10
        values = np.concatenate([values, np.round(unit * decade, 5)])
    return values[max(0, int(np.flatnonzero(values <= low)[-1]) - over) : int(np.flatnonzero(values > high)[0]) + over]


class GridChart(Chart):
    """Columns on a fixed grid; a box is filled when its value is reached. With a reversal of one box, a turn after a single box stays in its column."""

    def __init__(self, chart: str, rules: PnfRules, low: float, high: float):
        super().__init__(chart, rules)
        self.grid = scale(low, high, rules).tolist()
        self.base, self.at, self.trend, self.filled, self.index = None, None, 0, 1, 0
        self.before, self.earlier, self.last = None, None, None  # closes of the two bars before, and the last bar's prices
        self.bars = 0

    def up(self, price: float) -> int:
        """The highest box at or below a price."""
        return bisect_right(self.grid, price) - 1

    def down(self, price: float) -> int:
        """The lowest box at or above a price."""
        return bisect_left(self.grid, price)

    def in_order(self, o: float, h: float, l: float, c: float) -> list[float]:
        """A bar's prices as `ohlc` takes them; of bars that close where they open, the side of the farther extreme comes first."""
        low_first, high_first = [o, l, h, c], [o, h, l, c]
        if c != o:
            out = low_first if c > o else high_first
        elif c == l or c == h:
            out = high_first if c == l else low_first
        elif (h + l) / 2 != c:
            out = high_first if (h + l) / 2 > c else low_first
        elif self.bars <= 1:
            out = high_first
        elif self.before != c:
            out = high_first if self.before < c else low_first
        else:
            out = self.last  # nothing tells the sides apart: the bar before is taken again
        self.before, self.last, self.bars = c, out, self.bars + 1
        return out

    def marked(self, seq: int, lo: int, hi: int, out: list) -> None:
        """Boxes lo to hi are filled by the bar; a new column gives the one before."""
        if self.column is not None and self.index != self.number:
            out.append(self.done(lambda i: self.grid[i]))
        if self.column is None:
            self.column = Column(self.trend, seq, seq)
        c = self.column
        place = {b: k for k, b in enumerate(c.boxes)}
        for b in range(lo, hi + 1) if self.trend > 0 else range(hi, lo - 1, -1):
            if b in place:
                c.trends[place[b]], c.actions[place[b]] = self.trend, seq
            else:
                c.boxes.append(b)
                c.trends.append(self.trend)
                c.actions.append(seq)
        c.trend, c.end = self.trend, seq
        c.series.append((seq, self.at, self.trend, self.filled))

    def extend(self, seq: int, to: int, out: list) -> None:
        old, self.at = self.at, to
        self.filled += abs(to - old)
        self.marked(seq, min(old, to), max(old, to), out)

    def turn(self, seq: int, to: int, out: list) -> None:
        old, single = self.at, self.rules.reversal == 1 and self.filled == 1
        self.at, self.trend, self.filled = to, -self.trend, abs(old - to) + single
        self.index += not single
        self.marked(seq, *((to, old - 1) if self.trend < 0 else (old + 1, to)), out)

    def act(self, seq: int, high: float, low: float, high_test: float, low_test: float, turn_first: bool, out: list) -> None:
        """high and low are how far a bar reaches, the tests decide whether it does."""
        g, r, top = self.grid, self.rules.reversal, len(self.grid)
        if self.trend > 0:
            extends = self.at + 1 < top and high_test >= g[self.at + 1]
            turns = low_test <= g[max(self.at, 1 + r) - r]
            if extends and not (turn_first and turns):
                self.extend(seq, self.up(high), out)
            elif turns:
                self.turn(seq, self.down(low), out)
        else:
            extends = low_test <= g[max(self.at, 2) - 1]
            turns = self.at + r < top and high_test >= g[self.at + r]
            if extends and not (turn_first and turns):
                self.extend(seq, self.down(low), out)
            elif turns:
                self.turn(seq, self.up(high), out)

    def first(self, seq: int, high: float, low: float) -> bool:
        """Whether the bar sets the first trend. The first bar gives the boxes on either side of it."""
        if self.base is None:
            above = self.down(high)
            self.base, self.began = (above if self.grid[above] == high else above - 1, self.up(low)), seq
            return False
        above, below = self.base
        if high >= self.grid[above + 1]:
            self.trend, self.at = 1, above
        elif below > 0 and low <= self.grid[below - 1]:
            self.trend, self.at = -1, below
        else:
            return False
        self.marked(self.began, self.at, self.at, [])
        return True

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out, method = [], self.rules.method
        seqs, prices = rows["seq"].to_numpy().tolist(), rows[METHODS[method]].to_numpy(float)
        for seq, bar in zip(seqs, prices[:, :].tolist()):
            if any(p != p for p in bar):
                continue
            if method == "cl":
                turns = [(bar[0], bar[0], bar[0], bar[0])]
            elif method == "ohlc":
                turns = [(p, p, p, p) for p in self.in_order(*bar)]
            elif method == "hlc":
                turns = [(bar[0], bar[1], bar[2], bar[2])]
            else:
                turns = [(bar[0], bar[1], bar[0], bar[1])]
            for high, low, high_test, low_test in turns:
                if self.trend or self.first(seq, high, low):
                    self.act(seq, high, low, high_test, low_test, method == "l/h", out)
        return out

    def end(self) -> list[tuple]:
        return [self.done(lambda i: self.grid[i])] if self.column else []


class Widths:
    """A grid chart whose box size and span come with its rows."""

    def __init__(self, chart: str, rules: PnfRules):
        self.name, self.rules, self.chart = chart, rules, None

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        if self.chart is None:
            low, high, size = (float(rows[c].iloc[0]) for c in ("_low", "_high", "_box"))
            if not (low == low and high == high):
                return []
            self.chart = GridChart(self.name, PnfRules(self.rules.method, self.rules.reversal, size, self.rules.scaling), low, high)
        return self.chart.step(rows)

    def end(self) -> list[tuple]:
        return self.chart.end() if self.chart else []


def columns(bars: DataFrame, rules: PnfRules = PnfRules(), run: int | None = None) -> DataFrame:
    """bars (chart_id, seq and the method's prices) as columns: trend 1 or -1, boxes in the order they were filled, with their marks and when,
    and the series of what each acting bar left behind. A chart without a trend has no columns. `atr`: boxes of the mean true range.

    run: a chart is folded in several tasks, of about so many bars each, with the same columns; None: one task a chart.
    """
    ranged = rules.scaling == "atr"
    missing = [c for c in ["chart_id", "seq", *METHODS[rules.method], *(["high", "low", "close"] if ranged else [])] if c not in bars.columns]
    if missing:
        raise ValueError(f"bars lack {missing}")
    wanted = ["seq", *[c for c in METHODS["ohlc"] if c in METHODS[rules.method] or ranged or (rules.scaling == "log" and c in bars.columns)]]
    wanted = [c for c in wanted if c in bars.columns]
    bars = bars.select(F.col("chart_id").cast("string").alias("chart_id"), *wanted)
    from marketloom.operators.pnf import parallel

    if rules.scaling == "log":
        bars = bars if run is None else parallel.without_quiet(bars, rules, run)
        return fold(bars, "chart_id", ["seq"], COLUMNS, lambda chart: FrozenChart(chart, rules))
    low, high = ("close", "close") if rules.method == "cl" else ("low", "high")
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    spans = bars.groupBy("chart_id").agg(F.min(known(low)).alias("_low"), F.max(known(high)).alias("_high"))
    spans = spans.join(mean_true_range(bars, rules.atr_bars).withColumnRenamed("atr", "_box"), "chart_id") if ranged else spans.withColumn("_box", F.lit(float(rules.boxsize)))
    if run is not None:
        return parallel.grid_columns(bars.join(spans, "chart_id"), rules, run)
    return fold(bars.join(spans, "chart_id"), "chart_id", ["seq"], COLUMNS, lambda chart: Widths(chart, rules))
