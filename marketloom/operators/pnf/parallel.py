"""Columns of X and O of long charts, by runs of bars that are folded in different tasks.

A chart's bars are cut into runs by `seq`. On a grid, what a run does depends on the state that the chart is in when it begins: the
box it stands on and the trend. A first bar leaves only a few states possible, as boxes above it are reached and those more than a reversal away
are turned from. So a run is a function from these few states to the state at its end and the number of columns it begins; it is
computed by letting all of them run side by side, and states that meet go on as one. Functions of following runs are composed in
order, a few numbers a run, which gives every run the state it begins in. Then all runs are drawn at once, and the pieces of columns
that lie in several runs are put together by chart and column.

Boxes of the step-frozen scale hang on all boxes before them, so their states are too many. There each run leaves out the
bars that can't act whatever the state is, and the fold goes over the others. A bar acts upwards only if it is above all earlier
bars of its run, or stands a reversal above the lowest price since a bar as high as itself; downwards likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.folds import fold
from marketloom.operators.pnf import columns as P

STATE = "at int, trend int, filled bigint"
KNOWN = "before double, last array<double>, bars bigint"


def runs(bars: DataFrame, size: int) -> DataFrame:
    """bars with `run`: the chart's span of seq in equal parts, as many as give `size` bars to a part."""
    spans = bars.groupBy("chart_id").agg(F.min("seq").alias("_lo"), F.ceil((F.max("seq") - F.min("seq") + 1) / F.ceil(F.count("*") / size)).alias("_w"))
    return bars.join(spans, "chart_id").withColumn("run", F.expr("(seq - _lo) div _w")).drop("_lo", "_w").withColumn("_key", F.concat("chart_id", F.lit("\n"), F.col("run").cast("string")))


class Turns:
    """What bars do to a grid chart, as box numbers: how far up and down each reaches, and by which box that is tested."""

    def __init__(self, rules: P.PnfRules, grid: np.ndarray):
        self.rules, self.grid, self.top, self.r = rules, grid, len(grid), rules.reversal

    def of(self, high: np.ndarray, low: np.ndarray, high_test: np.ndarray, low_test: np.ndarray) -> list[tuple[int, int, int, int]]:
        up = lambda x: (np.searchsorted(self.grid, x, "right") - 1).tolist()
        down = lambda x: np.searchsorted(self.grid, x, "left").tolist()
        return list(zip(up(high), down(low), up(high_test), down(low_test)))

    def base(self, high: float, low: float) -> tuple[int, int]:
        """The boxes on either side of a chart's first bar."""
        above, below = np.searchsorted(self.grid, [high, low], "right").tolist()
        return above - 1, below - 1

    def act(self, at: int, trend: int, turn: tuple) -> tuple[int, int]:
        """Where a chart stands after a turn, and its trend then."""
        reach_up, reach_down, high, low = turn
        first = self.rules.method == "l/h"
        if trend > 0:
            extends, turns = at + 1 < self.top and high > at, low <= max(at, 1 + self.r) - self.r
            if extends and not (first and turns):
                return reach_up, 1
            return (reach_down, -1) if turns else (at, 1)
        extends, turns = low <= max(at, 2) - 1, at + self.r < self.top and high >= at + self.r
        if extends and not (first and turns):
            return reach_down, -1
        return (reach_up, 1) if turns else (at, -1)

    def start(self, base: tuple[int, int], turn: tuple) -> tuple[int, int] | None:
        """Where a chart without trend stands, if the turn sets one, before it acts."""
        above, below = base
        reach_up, reach_down, _, _ = turn
        if reach_up > above:
            return above, 1
        return (below, -1) if below > 0 and reach_down < below else None

    def possible(self, turn: tuple) -> set[tuple[int, int]]:
        """The states in which a chart with a trend can be after a turn."""
        _, _, high, low = turn
        around = {*range(max(0, low - self.r - 2), min(self.top, high + self.r + 3)), *range(max(0, high - self.r - 2), min(self.top, low + self.r + 3)), *range(min(self.top, self.r + 3)), *range(max(0, self.top - self.r - 2), self.top)}
        return {self.act(at, trend, turn) for at in around for trend in (1, -1)}


class Lane:
    """States that have met, as one. members: where each began, with what it had more of columns and boxes filled when they met."""

    def __init__(self, at: int, trend: int, filled: int, members: list):
        self.at, self.trend, self.filled, self.columns, self.members = at, trend, filled, 0, members

    def act(self, turns: Turns, turn: tuple) -> bool:
        at, trend = turns.act(self.at, self.trend, turn)
        if trend != self.trend:
            single = turns.r == 1 and self.filled == 1
            self.columns += not single
            self.filled = abs(at - self.at) + single
            self.members = [(start, columns, 0, True) for start, columns, _, _ in self.members]
        elif at != self.at:
            self.filled += abs(at - self.at)
        else:
            return False
        self.at, self.trend = at, trend
        return True

    def state(self, r: int) -> tuple:
        return (self.at, self.trend, self.filled == 1 if r == 1 else None)

    def join(self, other: Lane) -> None:
        self.members += [(s, c + other.columns - self.columns, f + other.filled - self.filled, known) for s, c, f, known in other.members]


def function(turns: Turns, all_: list, base: tuple[int, int]) -> list[tuple]:
    """For each state that a chart can be in after the first of the turns, and for a chart without trend before it (at -1): what it is in after all of them.

    (at, trend, single, at, trend, filled, whether that counts from 0 and not from what was filled before, columns begun).
    """
    r, lanes = turns.r, {}
    for at, trend in turns.possible(all_[0]):
        for single in (False, True) if r == 1 else (None,):
            # Of what isn't single any number above 1 can be filled; only the difference is used.
            filled = 1 if single else 2
            lanes[at, trend, single] = Lane(at, trend, filled, [((at, trend, single), 0, 0 if single else -filled, bool(single))])
    waiting, out = True, []
    for k, turn in enumerate(all_):
        moved = [x for x in lanes.values() if k and x.act(turns, turn)]
        if waiting and (began := turns.start(base, turn)):
            waiting = False
            lane = Lane(*began, 1, [((-1, 0, None), 0, 0, True)])
            lane.columns = 1
            lane.act(turns, turn)
            lanes[None] = lane
            moved.append(lane)
        if moved:
            met: dict = {}
            for x in lanes.values():
                if (s := x.state(r)) in met:
                    met[s].join(x)
                else:
                    met[s] = x
            lanes = met
    if waiting:
        out.append((-1, 0, None, -1, 0, 0, True, 0))
    for x in lanes.values():
        out += [(*start, x.at, x.trend, x.filled + f, known, x.columns + columns) for start, columns, f, known in x.members]
    return out


class Order:
    """The order of the prices of `ohlc` bars, which can hang on bars of earlier runs.

    known: the close of the last bar before, the prices of the last one as they were taken, and how many there were. Without it, bars
    that nothing tells the sides of are left open until one is told.
    """

    def __init__(self, known: tuple | None):
        self.chart = P.GridChart.__new__(P.GridChart)
        self.chart.before, self.chart.last, self.chart.bars = known or (None, None, 2)

    def prices(self, bars: list[list[float]]) -> list[list[float] | None]:
        out = []
        for bar in bars:
            o, h, l, c = bar
            open_ = self.chart.before is None and self.chart.bars > 1 and c == o and c not in (h, l) and (h + l) / 2 == c
            if open_:
                self.chart.before, self.chart.last, self.chart.bars = c, None, self.chart.bars + 1
                out.append(None)
            else:
                out.append(self.chart.in_order(*bar))
        return out


def turned(turns: Turns, rows: pd.DataFrame, known: tuple | None) -> tuple[list, list[int]]:
    """The turns of a run's bars, and the bar's seq of each."""
    method = turns.rules.method
    prices = rows[P.METHODS[method]].to_numpy(float)
    full = ~np.isnan(prices).any(1)
    prices, seqs = prices[full], rows["seq"].to_numpy()[full]
    if not len(prices):
        return [], []
    if method == "ohlc":
        prices = np.array(Order(known).prices(prices.tolist()), float).ravel()
        return turns.of(*[prices] * 4), np.repeat(seqs, 4).tolist()
    high, low = (prices[:, 0], prices[:, 0]) if method == "cl" else (prices[:, 0], prices[:, 1])
    tests = (prices[:, 2], prices[:, 2]) if method == "hlc" else (high, low)
    return turns.of(high, low, *tests), seqs.tolist()


class Run:
    """A run's bars as they come; what is done with them is done at the end."""

    def __init__(self, rules: P.PnfRules):
        self.rules, self.frames = rules, []

    def step(self, rows: pd.DataFrame) -> list:
        self.frames.append(rows)
        return []

    def end(self) -> list[tuple]:
        rows = pd.concat(self.frames, ignore_index=True)
        first = rows.iloc[0]
        if not (first["_low"] == first["_low"] and first["_high"] == first["_high"]) or first["_first"] is None:
            return []
        grid = P.scale(float(first["_low"]), float(first["_high"]), P.PnfRules(self.rules.method, self.rules.reversal, float(first["_box"]), self.rules.scaling))
        return list(self.of(first["chart_id"], int(first["run"]), Turns(self.rules, grid), rows))

    def known(self, rows: pd.DataFrame) -> tuple | None:
        if self.rules.method != "ohlc" or rows["_known"].iloc[0] is None:
            return None
        x = rows["_known"].iloc[0]
        return (x["before"], None if x["last"] is None else list(x["last"]), int(x["bars"]))

    def base(self, turns: Turns, rows: pd.DataFrame) -> tuple[int, int]:
        x = list(rows["_first"].iloc[0])
        return turns.base(*((x[0], x[0]) if self.rules.method in ("cl", "ohlc") else x[:2]))


class Ends(Run):
    """For `ohlc`: how many bars a run has, its last close, its last bar's prices in order if the run tells them, and its first bar."""

    def of(self, chart, run, turns, rows) -> Iterator[tuple]:
        whole = rows.dropna(subset=P.METHODS["ohlc"])
        bars = whole[P.METHODS["ohlc"]].to_numpy(float).tolist()
        if bars:
            known = (None, None, 0) if whole["seq"].iloc[0] == rows["_began"].iloc[0] else None
            yield (chart, run, len(bars), bars[-1][3], Order(known).prices(bars)[-1], bars[0])


class Carried:
    """What each run of a chart needs to know of the bars before it."""

    def __init__(self, chart: str):
        self.chart, self.order = chart, Order((None, None, 0)).chart

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out, o = [], self.order
        for run, n, close, last, first in rows[["run", "n", "close", "last", "first"]].itertuples(index=False):
            before = (o.before, o.last, o.bars)
            out.append((self.chart, run, before))
            taken = o.in_order(*first)
            o.before, o.last, o.bars = close, list(last) if last is not None else taken, before[2] + n
        return out

    def end(self) -> list[tuple]:
        return []


class Functions(Run):
    def of(self, chart, run, turns, rows) -> Iterator[tuple]:
        all_, _ = turned(turns, rows, self.known(rows))
        if all_:
            for f in function(turns, all_, self.base(turns, rows)):
                yield (chart, run, *f, list(all_[0]), turns.top)


class States:
    """Composes the functions of a chart's runs: gives the state and the columns begun before each."""

    def __init__(self, chart: str, rules: P.PnfRules):
        self.chart, self.rules, self.state, self.columns = chart, rules, (-1, 0, 0), 0
        self.run, self.held = None, {}

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for x in rows.itertuples(index=False):
            if x.run != self.run:
                self.through()
                self.run, self.held, self.turn, self.top = x.run, {}, tuple(x.turn), x.top
                out.append((self.chart, x.run, *self.state, self.columns))
            self.held[int(x.at), int(x.trend), None if x.single is None or x.single != x.single else bool(x.single)] = (int(x.to), int(x.then), int(x.filled), bool(x.known), int(x.begun))
        return out

    def through(self) -> None:
        if self.run is None:
            return
        at, trend, filled = self.state
        begun = 0
        if at >= 0:
            turns = Turns(self.rules, np.zeros(0))
            turns.top = self.top
            lane = Lane(at, trend, filled, [])
            lane.act(turns, self.turn)
            at, trend, filled, begun = lane.at, lane.trend, lane.filled, lane.columns
            key = (at, trend, filled == 1 if self.rules.reversal == 1 else None)
        else:
            key = (-1, 0, None)
        to, then, more, known, columns = self.held[key]
        self.state, self.columns = (to, then, more if known else filled + more), self.columns + begun + columns

    def end(self) -> list[tuple]:
        return []


class Pieces(Run):
    """Draws a run from the state it begins in. What stands before its first turn to a new column belongs to the column that was open."""

    def of(self, chart, run, turns, rows) -> Iterator[tuple]:
        all_, seqs = turned(turns, rows, self.known(rows))
        x = rows.iloc[0]
        base, began, r = self.base(turns, rows), int(x["_began"]), self.rules.reversal
        at, trend, filled, number = int(x["at"]), int(x["trend"]), int(x["filled"]), int(x["begun"]) - 1
        column = None

        def marked(seq, lo, hi):
            nonlocal column
            if column is None:
                column = P.Column(trend, seq, seq, {}, None, None, [])
            for b in range(lo, hi + 1) if trend > 0 else range(hi, lo - 1, -1):
                column.boxes[b] = (trend, seq)
            column.trend, column.end = trend, seq
            column.series.append((seq, at, trend, filled))

        def done():
            g = turns.grid.tolist()
            boxes = list(column.boxes)
            return (chart, number, column.trend, column.start, column.end, [g[b] for b in boxes], [column.boxes[b][0] for b in boxes], [column.boxes[b][1] for b in boxes], [(s, g[b], t, n) for s, b, t, n in column.series])

        for turn, seq in zip(all_, seqs):
            if at < 0:
                if not (first := turns.start(base, turn)):
                    continue
                (at, trend), filled, number = first, 1, number + 1
                marked(began, at, at)
            to, then = turns.act(at, trend, turn)
            if then != trend:
                old, single = at, r == 1 and filled == 1
                if not single:
                    if column is not None:
                        yield done()
                    column, number = None, number + 1
                at, trend, filled = to, then, abs(old - to) + single
                marked(seq, *((to, old - 1) if trend < 0 else (old + 1, to)))
            elif to != at:
                old, at = at, to
                filled += abs(to - old)
                marked(seq, min(old, to), max(old, to))
        if column is not None:
            yield done()


def joined(pieces: DataFrame) -> DataFrame:
    """Columns from their pieces: boxes in the order in which they were first filled, with their last marks."""
    fields = ["trend", "start_seq", "end_seq", "boxes", "trends", "actions", "series"]
    many = pieces.groupBy("chart_id", "column_index").agg(F.array_sort(F.collect_list(F.struct("end_seq", F.struct(*fields).alias("p")))).alias("_p"))
    many = many.select("chart_id", "column_index", F.col("_p.p").alias("_p")).withColumns({"_f": F.element_at("_p", 1), "_l": F.element_at("_p", -1)})
    one = F.size("_p") == 1
    flat = lambda f: F.flatten(F.transform("_p", lambda x: x[f]))
    boxes = F.array_distinct(flat("boxes"))
    last = lambda f: F.when(one, F.col(f"_f.{f}")).otherwise(F.transform(boxes, lambda b: F.element_at(flat(f), (F.size(flat("boxes")) + 1 - F.array_position(F.reverse(flat("boxes")), b)).cast("int"))))
    return many.select(
        "chart_id", "column_index", F.col("_l.trend").alias("trend"), F.col("_f.start_seq").alias("start_seq"), F.col("_l.end_seq").alias("end_seq"),
        F.when(one, F.col("_f.boxes")).otherwise(boxes).alias("boxes"), last("trends").alias("trends"), last("actions").alias("actions"), flat("series").alias("series"),
    )


def grid_columns(bars: DataFrame, rules: P.PnfRules, size: int) -> DataFrame:
    """Columns of bars (chart_id, seq, prices, and of each chart the span _low to _high and the box size _box), by runs of about `size` bars."""
    names = P.METHODS[rules.method]
    price = F.when(F.forall(F.array(*names), lambda x: x.isNotNull() & ~F.isnan(x)), F.array(*[F.col(c).cast("double") for c in names]))
    whole = bars.withColumn("_p", price)
    firsts = whole.filter("_p IS NOT NULL").groupBy("chart_id").agg(F.min_by("_p", "seq").alias("_first"), F.min("seq").alias("_began"))
    cut = runs(bars, size).join(firsts, "chart_id")
    if rules.method == "ohlc":
        ends = fold(cut, "_key", ["seq"], "chart_id string, run bigint, n bigint, close double, last array<double>, first array<double>", lambda _: Ends(rules))
        known = fold(ends, "chart_id", ["run"], f"chart_id string, run bigint, _known struct<{KNOWN.replace(' ', ':').replace(',:', ',')}>", Carried)
        cut = cut.join(known, ["chart_id", "run"], "left")
    table = "chart_id string, run bigint, at int, trend int, single boolean, to int, then int, filled bigint, known boolean, begun bigint, turn array<int>, top int"
    functions = fold(cut, "_key", ["seq"], table, lambda _: Functions(rules))
    states = fold(functions, "chart_id", ["run"], f"chart_id string, run bigint, {STATE}, begun bigint", lambda chart: States(chart, rules))
    return joined(fold(cut.join(states, ["chart_id", "run"]), "_key", ["seq"], P.COLUMNS, lambda _: Pieces(rules)))


def may_act(tried: list[list[int]], a: int, d: int, reversal: int, sure: int, slack: int = 2) -> list[bool]:
    """Which bars of a run can act on a step-frozen chart: of prices in hundredths, in the order in which they are tried.

    sure: the place of the price that is tried in any case. Bars without prices can't act.
    """
    out = [False] * len(tried)
    for sign in (1, -1):
        stack: list[list[int]] = []  # bars that later ones may not have passed: what was surely reached, and the far side since
        for i, prices in enumerate(tried):
            if not prices:
                continue
            best, far, top = max(sign * p for p in prices), min(sign * p for p in prices), sign * prices[sure]
            while stack and stack[-1][0] < best + slack:
                p, f = stack.pop()
                far, top = min(far, f), max(top, p)
            if not stack:
                out[i] = True
            else:
                low = min(far, stack[-1][1])
                # A reversal away from the far side, which is a price: sign * low.
                limit = abs(low) * (d + sign * reversal * a) // d
                out[i] |= best >= sign * limit - slack * 2
            stack.append([top, far])
    return out


class Quiet:
    """A run without the bars that can't act. Its first bar stays."""

    def __init__(self, rules: P.PnfRules, names: list[str]):
        self.rules, self.names, self.frames = rules, names, []

    def step(self, rows: pd.DataFrame) -> list:
        self.frames.append(rows)
        return []

    def end(self) -> list[tuple]:
        rows = pd.concat(self.frames, ignore_index=True)
        chart = P.FrozenChart("", self.rules)
        names = [k for k in P.METHODS["ohlc"] if k in rows]
        ticks = {k: P.ticks_of(rows[k].to_numpy(float)) for k in names}
        bars = [dict(zip(names, x)) for x in zip(*ticks.values())]
        if self.rules.method != "cl":
            bars = [chart.checked(b) for b in bars]
        # Where the close decides, bars without one act only before there is a column, and stay.
        decided = [self.rules.method != "hlc" or b["close"] is not None for b in bars]
        tried = [P.order_of_prices(b, self.rules.method) if x else [] for b, x in zip(bars, decided)]
        act = may_act(tried, chart.a, chart.d, self.rules.reversal, -1 if self.rules.method == "hlc" else 0)
        kept = [i for i, x in enumerate(act) if x or not decided[i]]
        return list(rows.iloc[kept][["chart_id", *self.names]].itertuples(index=False, name=None))


def without_quiet(bars: DataFrame, rules: P.PnfRules, size: int) -> DataFrame:
    """bars (chart_id, seq and prices) but those that can't act on a step-frozen chart, whatever came before their run."""
    names = [c for c in bars.columns if c != "chart_id"]
    schema = bars.select("chart_id", *names).schema
    return fold(runs(bars, size), "_key", ["seq"], schema, lambda _: Quiet(rules, names))
