"""What charts hold, from their columns: cells, column figures, time series, breakouts, signals, levels, lines and counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

from marketloom.functions.folds import fold, once
from marketloom.operators.pnf.columns import scale


def by_chart() -> WindowSpec:
    return Window.partitionBy("chart_id")


def in_order() -> WindowSpec:
    return by_chart().orderBy("column_index")


# Signal names by code.
SIGNALS = [
    "Buy Signal", "Sell Signal", "Double Top Breakout", "Double Bottom Breakdown", "Triple Top Breakout", "Triple Bottom Breakdown",
    "Quadruple Top Breakout", "Quadruple Bottom Breakdown", "Ascending Triple Top Breakout", "Descending Triple Bottom Breakdown",
    "Bullish Catapult", "Bearish Catapult", "Bullish Signal Reversed", "Bearish Signal Reversed", "Bullish Triangle", "Bearish Triangle",
    "Long Tail Down Reversal", "Bull Trap", "Bear Trap", "Spread Triple Top Breakout", "Spread Triple Bottom Breakdown", "High Pole", "Low Pole",
]


def cells(columns: DataFrame) -> DataFrame:
    """chart_id, column_index, box_value, box_index (rank of the value in the chart), trend, action_seq: filled cells only.

    Ranks are those of a chart's different values, of which there are far fewer than cells: they are computed first, so that Spark knows
    how small they are and need not shuffle cells to rank them.
    """
    each = columns.select("chart_id", "column_index", F.explode(F.arrays_zip("boxes", "trends", "actions")).alias("_c"))
    each = each.select("chart_id", "column_index", F.col("_c.boxes").alias("box_value"), F.col("_c.trends").alias("trend"), F.col("_c.actions").alias("action_seq"))
    values = columns.select("chart_id", F.explode("boxes").alias("box_value")).distinct()
    ranks = once(values.withColumn("box_index", F.row_number().over(by_chart().orderBy("box_value")) - 1), "ranks")
    return each.join(ranks, ["chart_id", "box_value"])


def column_stats(cells_: DataFrame) -> DataFrame:
    """high, low (box indexes), height, high and low value, trend (of the lowest box) and midpoint (median box) of each column."""
    return cells_.groupBy("chart_id", "column_index").agg(
        F.max("box_index").alias("high"), F.min("box_index").alias("low"), F.count("*").cast("int").alias("height"), F.max("box_value").alias("high_value"), F.min("box_value").alias("low_value"),
        F.min_by("trend", "box_index").alias("trend"), F.median("box_value").alias("midpoint"),
    )


def time_series(columns: DataFrame) -> DataFrame:
    """One row a bar that changed the chart: the box where it left off, its column and trend, and how many boxes the column has by then."""
    each = columns.select("chart_id", "column_index", F.explode("series").alias("_s"))
    return each.select("chart_id", F.col("_s.seq").alias("seq"), F.col("_s.box_value").alias("box_value"), "column_index", F.col("_s.trend").alias("trend"), F.col("_s.filled").alias("filled_boxes"))


def _full(value: Column, n: int) -> Column:
    return F.when(F.row_number().over(in_order()) >= n, value)


def sma(stats: DataFrame, period: int) -> DataFrame:
    frame = in_order().rowsBetween(1 - period, 0)
    return stats.withColumn(f"sma_{period}", _full(F.avg("midpoint").over(frame), period))


def bollinger(stats: DataFrame, period: int, factor: float) -> DataFrame:
    frame = in_order().rowsBetween(1 - period, 0)
    mean, spread = F.avg("midpoint").over(frame), F.stddev_pop("midpoint").over(frame) * factor
    return stats.withColumns({"upper": _full(mean + spread, period), "lower": _full(mean - spread, period)})


def donchian(stats: DataFrame, period: int, ignore: int = 0) -> DataFrame:
    """Highest high and lowest low value of the last `period` columns, `ignore` columns late."""
    frame = in_order().rowsBetween(1 - period, 0)
    df = stats.withColumns({"_u": _full(F.max("high_value").over(frame), period), "_l": _full(F.min("low_value").over(frame), period)})
    late = lambda c: F.lag(c, ignore).over(in_order()) if ignore > 0 else F.col(c)
    return df.withColumns({"upper": late("_u"), "lower": late("_l")}).drop("_u", "_l")


def _folded(stats: DataFrame, out: str, start) -> DataFrame:
    """stats with one value a column, from a fold over a chart's columns in order. start() makes what values(frame) gives them by."""
    names = stats.columns

    class Kept:
        def __init__(self, chart):
            self.state, self.rows = start(), []

        def given(self, values: list) -> list[tuple]:
            done, self.rows = self.rows[: len(values)], self.rows[len(values) :]
            return [(*r, v) for r, v in zip(done, values)]

        def step(self, frame) -> list[tuple]:
            self.rows += list(zip(*(frame[c].tolist() for c in names)))
            return self.given(self.state.values(frame))

        def end(self) -> list[tuple]:
            return self.given([None] * len(self.rows))

    return fold(stats, "chart_id", ["column_index"], StructType([*stats.schema.fields, StructField(out, DoubleType())]), Kept)


def ema(stats: DataFrame, period: int) -> DataFrame:
    """Exponential mean of the midpoints, seeded with the mean of the first `period`; null before."""

    class Mean:
        def __init__(self):
            self.first, self.last, self.k = [], None, 2.0 / (period + 1)

        def values(self, frame) -> list:
            out = []
            for x in frame["midpoint"].tolist():
                if self.last is not None:
                    self.last += (x - self.last) * self.k
                else:
                    self.first.append(x)
                    self.last = sum(self.first) / period if len(self.first) == period else None
                out.append(self.last)
            return out

    return _folded(stats, f"ema_{period}", Mean)


def psar(stats: DataFrame, step: float, leap: float) -> DataFrame:
    """Parabolic stop of each column, signed by its direction; null in charts of two columns or fewer.

    `leap` stops the growth of the acceleration where it is met exactly.
    """

    class Stop:
        def __init__(self):
            self.held, self.flag = [], 0

        def values(self, frame) -> list:
            out = []
            for high, low in zip(frame["high_value"].tolist(), frame["low_value"].tolist()):
                if self.flag:
                    out.append(self.move(high, low))
                    continue
                self.held.append((high, low))
                if len(self.held) == 3:  # the first and the third column tell the direction
                    (high, low), falls = self.held[0], self.held[0][0] > self.held[2][0]
                    self.sar, self.ep, self.flag, self.acc = (high, low, -1, step) if falls else (low, high, 1, step)
                    out += [self.sar * self.flag, *(self.move(*x) for x in self.held[1:])]
            return out

        def move(self, high: float, low: float) -> float:
            to = self.sar + self.acc * (self.ep - self.sar)
            hit = to > low if self.flag > 0 else to < high
            self.sar = self.ep if hit else to
            flag = 1 if self.sar < high else -1 if self.sar > low else self.flag
            ep = max(self.ep, high) if flag > 0 else min(self.ep, low)
            if flag != self.flag:
                self.acc = step
            elif self.acc != leap and ep != self.ep:
                self.acc += step
            self.ep, self.flag = ep, flag
            return self.sar * self.flag

    return _folded(stats, "psar", Stop)


#: Cells that a task takes at once, about.
SHARE = 2**20
MARK = "chart_id STRING, trend INT, type STRING, column_index INT, box_index INT, hits INT, width INT, outer_width INT, action_seq BIGINT"
KINDS = ["conti", "reversal", "resistance", "fulcrum"]


def _named(codes: np.ndarray, names: list[str]) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(names, pa.string())).cast(pa.string())


def _by_rows(cells_: DataFrame, size: int) -> DataFrame:
    """Cells dealt to groups (chart_id, _part) of about `size` in neighbouring rows, and of one row at least; `_own` is false for the rows on either side of a group."""
    rows = cells_.groupBy("chart_id", "box_index").agg(F.count("*").alias("_n"))
    order = by_chart().orderBy("box_index")
    rows = rows.withColumn("_at", F.floor((F.sum("_n").over(order) - F.col("_n")) / size).cast("int"))
    rows = rows.withColumn("_parts", F.array("_at", F.lag("_at").over(order), F.lead("_at").over(order)))
    rows = rows.select("chart_id", "box_index", "_at", F.explode(F.array_distinct(F.array_compact("_parts"))).alias("_part"))
    rows = once(rows.select("chart_id", "box_index", "_part", (F.col("_part") == F.col("_at")).alias("_own")), "rows")
    groups = rows.select("chart_id", "_part").distinct().count()
    parts = max(groups, int(cells_.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells_.select("chart_id", "column_index", "box_index", "trend", "action_seq").join(rows, ["chart_id", "box_index"])
    return dealt.repartition(parts, "chart_id", "_part")


def breakouts(cells_: DataFrame, hits: int | None = None, inner: bool = True, size: int = SHARE) -> DataFrame:
    """Breakouts with type, hits, width and outer width; those of more than two hits hold smaller ones.

    A candidate is a cell whose left neighbour is empty. Its line is the row before it, up to its column: the marks of its own kind
    after the last opposite one. Two of them or more make a breakout. Marks of a row that follow each other are numbered in runs of one
    kind, so the line is the run of the last mark up to the candidate's column. All that is asked lies in three neighbouring rows, so cells
    are shuffled once, by groups of about `size` in neighbouring rows.

    hits: only those of so many hits. inner: whether the smaller ones are given, too.
    """
    fields = pa.schema([("chart_id", pa.string()), ("trend", pa.int32()), ("type", pa.string()), *[(c, pa.int32()) for c in ("column_index", "box_index", "hits", "width", "outer_width")], ("action_seq", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        chart = t["chart_id"][0].as_py()
        row, col = (t[c].to_numpy().astype(np.int64) for c in ("box_index", "column_index"))
        wide = int(col.max()) + 2
        place = row * wide + col
        order = np.argsort(place)
        place, row, col = place[order], row[order], col[order]
        trend, seq, own = (t[c].to_numpy()[order] for c in ("trend", "action_seq", "_own"))
        del t, order
        at = np.arange(len(row))

        def before(k):
            """The mark k places before in the row: its column, or -9, and its trend, or 0."""
            there = np.zeros(len(row), bool)
            there[k:] = row[k:] == row[:-k]
            return np.where(there, np.roll(col, k), -9), np.where(there, np.roll(trend, k), 0)

        (z, tz), (z2, t2) = before(1), before(2)
        first = np.maximum.accumulate(np.where(tz != trend, at, 0))
        some = np.flatnonzero(own & (col >= 1) & (z != col - 1))
        line = row[some] - trend[some]
        last = np.searchsorted(place, line * wide + col[some], side="right") - 1
        number = last - first[last] + 1
        keep = (last >= 0) & (row[last] == line) & (trend[last] == trend[some]) & (number >= (2 if hits is None else hits))
        some, last, number = some[keep], last[keep], number[keep]
        up, z, tz, prior = trend[some], z[some], tz[some], np.where(z2[some] == z[some] - 1, t2[some], 0)
        against = (tz == -up) & (prior == -up) & (up == 1)
        kind = np.where(z <= 0, np.where((tz == 0) | (tz == up), 0, 1), np.where((tz == up) & (prior != -up), 2, np.where(against, 3, 1)))
        outer = col[last] - np.maximum(z, 0) + 1
        # Breakout p of a candidate begins with mark p of its line's run and has so many hits less.
        begin = np.zeros(len(some), np.int64) if hits is None else number - hits
        many = (number - 1 if inner else np.minimum(number - 1, 1)) if hits is None else np.ones(len(some), np.int64)
        cuts = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 250_000, 250_000)) if len(some) else []
        for a, b in zip(cuts, [*cuts[1:], len(some)]):
            if a == b:
                continue
            i = np.repeat(np.arange(a, b), many[a:b])
            p = begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(many[a:b]) - many[a:b], many[a:b])
            start, end = col[first[last[i]] + p], col[last[i]]
            columns = [_named(np.zeros(len(i), int), [chart]), up[i], _named(kind[i], KINDS), col[some[i]], row[some[i]], number[i] - p, end - start + 1, outer[i], seq[some[i]]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return _by_rows(cells_, size).groupBy("chart_id", "_part").applyInArrow(found, MARK)


SIGNAL = ["chart_id", "column_index", "code", "box_index", "width"]


def _run(stats: DataFrame, holds: Column, name: str, stride: int = 1) -> DataFrame:
    """stats with how many columns in a row, in strides backwards from each, hold."""
    w = Window.partitionBy("chart_id", F.pmod("column_index", F.lit(stride))).orderBy("column_index")
    broken = F.max(F.when(~F.coalesce(holds, F.lit(False)), F.col("column_index"))).over(w)
    return stats.withColumn(name, ((F.col("column_index") - F.coalesce(broken, F.col("column_index") % stride - stride)) / stride).cast("int"))


def buy_sell(stats: DataFrame) -> DataFrame:
    """Columns that pass the extreme of the column two before; box_index is one above the column's top, or its bottom's number from 1."""
    two = lambda c: F.lag(c, 2).over(in_order())
    code = F.when((F.col("trend") == 1) & (F.col("high") > two("high")), 0).when((F.col("trend") == -1) & (F.col("low") < two("low")), 1)
    box = F.when(code == 0, F.col("high") + 1).otherwise(F.col("low") + 1)
    return stats.select("chart_id", "column_index", code.alias("code"), box.alias("box_index")).filter("code IS NOT NULL")


def triangles(stats: DataFrame, marks: DataFrame, strict: bool = False) -> DataFrame:
    """Breakouts of width 3 after more than three columns, each about two boxes less high than the one before and one box lower at its top."""
    slack = 0 if strict else 1
    near = lambda c, d: F.abs(F.col(c) - F.lead(c).over(in_order()) - d) <= slack
    s = _run(stats, near("height", 2) & near("high", 1) & (F.col("column_index") > 0), "_links")
    s = s.select("chart_id", (F.col("column_index") + 2).alias("column_index"), (F.col("_links") + 1).alias("_hits"))
    found = marks.filter("width = 3").join(s, ["chart_id", "column_index"]).filter("_hits > 3")
    return found.select("chart_id", "column_index", _odd(14), "box_index", F.col("_hits").alias("width"), "hits")


def poles(stats: DataFrame) -> DataFrame:
    """Columns more than three boxes beyond the one two before that are more than half as high as the next, which bears the signal.

    The second column is compared with the chart's last one.
    """
    whole = in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    two = lambda c: F.when(F.col("column_index") == 1, F.last(c).over(whole)).otherwise(F.lag(c, 2).over(in_order()))
    s = stats.withColumns({"_h2": two("high"), "_l2": two("low"), **{f"_{c}": F.lead(c).over(in_order()) for c in ("high", "low", "height")}})
    tall = (F.col("height") / F.col("_height") > 0.5) & (F.col("column_index") >= 1)
    high, low = (F.col("trend") == 1) & (F.col("high") > F.col("_h2") + 3), (F.col("trend") == -1) & (F.col("low") < F.col("_l2") - 3)
    s = s.filter(tall & (high | low))
    return s.select("chart_id", (F.col("column_index") + 1).alias("column_index"), F.when(F.col("trend") == 1, 21).otherwise(22).alias("code"), F.when(F.col("trend") == 1, F.col("_low") + 1).otherwise(F.col("_high")).alias("box_index"), F.lit(3).alias("width"), F.lit(0).alias("hits"))


def traps(stats: DataFrame, marks: DataFrame, reversal: int = 3) -> DataFrame:
    """Triple breakouts of one box beyond the column two before, after which a column of the reversal's height turns; that one bears the signal."""
    s = stats.select("chart_id", "column_index", "high", "low", F.lag("high", 2).over(in_order()).alias("_h2"), F.lag("low", 2).over(in_order()).alias("_l2"), *[F.lead(c).over(in_order()).alias(f"_{c}") for c in ("high", "low", "height")])
    df = marks.filter("hits = 3 AND width = 5").join(s, ["chart_id", "column_index"])
    one = F.when(F.col("trend") == 1, F.col("high") - F.col("_h2")).otherwise(F.col("_l2") - F.col("low")) == 1
    df = df.filter(one & (F.col("_height") >= reversal))
    return df.select("chart_id", (F.col("column_index") + 1).alias("column_index"), _odd(17), (F.when(F.col("trend") == 1, F.col("_low")).otherwise(F.col("_high")) + 1).alias("box_index"), F.lit(6).alias("width"), "hits")


def follow_ups(marks: DataFrame) -> DataFrame:
    """Double breakouts two columns after the breakout before them in order of column, box and hits, of the same trend.

    Codes from 8: after any; from 10: after a triple one, as a second row.
    """
    column = ["chart_id", "column_index"]
    double = once(marks.filter("hits = 2 AND width = 3").select("chart_id", "column_index").distinct(), "doubles")
    moved = lambda df, k: df.select("chart_id", (F.col("column_index") + k).cast("int").alias("column_index"))
    # The breakout before lies two columns back only if the column between has none: few columns are left to be sorted.
    between = marks.join(moved(double, -1), column, "left_semi").select(column).distinct()
    free = once(double.join(moved(between, 1), column, "left_anti"), "follow")
    near = marks.join(free.unionByName(moved(free, -2)).distinct(), column, "left_semi")
    w = by_chart().orderBy("column_index", "box_index", "hits")
    p = near.withColumns({f"_{c}": F.lag(c).over(w) for c in ("trend", "column_index", "hits", "width")})
    p = p.filter((F.col("_trend") == F.col("trend")) & (F.col("column_index") - F.col("_column_index") == 2) & (F.col("hits") == 2) & (F.col("width") == 3))
    p = p.join(free, column, "left_semi")  # of other columns the breakout before may have been left out
    any_ = p.select("chart_id", "column_index", _odd(8), "box_index", F.lit(5).alias("width"), "hits")
    return any_.unionByName(p.filter("_hits = 3 AND _width = 5").select("chart_id", "column_index", _odd(10), "box_index", F.lit(7).alias("width"), "hits"))


def reversed_signals(stats: DataFrame, marks: DataFrame) -> DataFrame:
    """Double breakouts after stairs of one box against them, of any length: the columns' ends move a box every second column."""
    back = lambda c, k: F.lag(c, k).over(in_order()) if k else F.col(c)
    out = []
    for trend, own, other in ((1, "low", "high"), (-1, "high", "low")):
        stair = (F.col("column_index") > 2) & (F.col(own) == back(own, 2) - trend) & (back(other, 1) == back(other, 3) - trend)
        s = _run(stats.withColumn("_stair", stair), F.col("_stair"), "_steps", 2)
        s = s.select("chart_id", (F.col("column_index") + 1).alias("column_index"), "_steps").filter("_steps > 0")
        found = marks.filter((F.col("trend") == trend) & (F.col("hits") == 2) & (F.col("width") == 3)).join(s, ["chart_id", "column_index"])
        out.append(found.select("chart_id", "column_index", _odd(12), "box_index", (2 * F.col("_steps") + 2).alias("width"), "hits"))
    return out[0].unionByName(out[1])


def _odd(code: int) -> Column:
    """The code, or the next one where the trend is down."""
    return F.when(F.col("trend") == 1, code).otherwise(code + 1).alias("code")


def signals(stats: DataFrame, marks: DataFrame, reversal: int = 3, strict: bool = False, cells_: DataFrame | None = None) -> DataFrame:
    """One signal a column: code, label, box_index and width, and the top and bottom box (numbered from 1) of what it looks at.

    Of several detectors the last in this order wins, of one detector's breakouts the last by box and hits: triangles, poles, traps, ascending
    and descending triples, catapults, reversals, spread triples, triples, quadruples. Double breakouts, the first of a column, and
    simple signals only fill what is free. With cells_, `action_seq` is the bar that filled the signal's box, 0 where it is empty.
    """
    plain = lambda where, code: marks.filter(where).select("chart_id", "column_index", _odd(code), "box_index", "width", "hits")
    follow = follow_ups(marks)
    simple = buy_sell(stats).withColumns({"width": F.lit(3), "hits": F.lit(0)})
    ranked = [
        (0, simple), (1, plain("hits = 2 AND width = 3", 2)), (2, triangles(stats, marks, strict)), (3, poles(stats)), (4, traps(stats, marks, reversal)), (5, follow.filter("code < 10")), (6, follow.filter("code >= 10")),
        (7, reversed_signals(stats, marks)), (8, plain("hits = 3 AND width IN (7, 9)", 19)), (9, plain("hits = 3 AND width = 5", 4)), (10, plain("hits = 4 AND width = 7", 6)),
    ]
    whole = lambda c: F.col(c).cast("int").alias(c)
    every = reduce(DataFrame.unionByName, [f.select("chart_id", "column_index", whole("code"), whole("box_index"), whole("width"), F.lit(p).alias("_p"), whole("hits")) for p, f in ranked])
    # Of double breakouts the first by box and hits stays, of all others the last.
    rank = lambda c: F.when(F.col("_p") == 1, -F.col(c)).otherwise(F.col(c))
    best = every.groupBy("chart_id", "column_index").agg(F.max_by(F.struct("code", "box_index", "width"), F.struct("_p", rank("box_index").alias("b"), rank("hits").alias("h"), rank("code").alias("c"))).alias("_s"))
    best = best.select("chart_id", "column_index", "_s.*")
    # The columns that a signal looks at: from its own column, or the one before, so many back; its own end counts where the pattern ends there.
    code, at = F.col("code"), F.col("column_index")
    back = F.when(code.isin(21, 22), 2).when(code.isin(17, 18), 5).when(code.isin(8, 9), 4).when(code.isin(10, 11), 6).when(code.isin(19, 20), F.col("width") - 1).when(code.isin(0, 1), 1).otherwise(F.col("width"))
    # A reversal looks at one column only, before its stairs; where they begin with the second column that is the chart's last.
    best = best.join(stats.groupBy("chart_id").agg(F.max("column_index").alias("_end")), "chart_id")
    before = at - F.col("width") - 1
    before = F.when(before < 0, F.col("_end") + 1 + before).otherwise(before)
    first, last = F.when(code.isin(12, 13), before).otherwise(F.greatest(F.lit(0), at - back)), F.when(code.isin(12, 13), before).otherwise(at - 1)
    seen = best.withColumn("_c", F.explode(F.sequence(first, last)))
    span = seen.join(stats.select("chart_id", F.col("column_index").alias("_c"), "high", "low"), ["chart_id", "_c"])
    span = span.groupBy("chart_id", "column_index").agg(F.max("high").alias("_top"), F.min("low").alias("_bottom"))
    own = stats.select("chart_id", "column_index", F.col("high").alias("_h"), F.col("low").alias("_l"), *[F.lag(c, k).over(in_order()).alias(f"_{c}{k}") for c in ("high", "low") for k in (1, 2)])
    df = best.join(span, ["chart_id", "column_index"]).join(own, ["chart_id", "column_index"])
    up, down = code.isin(0, 2, 4, 6, 12, 19), code.isin(1, 3, 5, 7, 13, 20)
    # A pole is the column before, its foot or head the one before that.
    top = F.when(up, F.col("_h")).when(code == 21, F.col("_high1")).when(code == 22, F.col("_high2")).otherwise(F.col("_top")) + 1
    bottom = F.when(down, F.col("_l")).when(code == 21, F.col("_low2")).when(code == 22, F.col("_low1")).otherwise(F.col("_bottom")) + 1
    df = df.select("chart_id", "column_index", "code", F.get(F.array(*map(F.lit, SIGNALS)), code).alias("label"), "box_index", "width", top.alias("top_index"), bottom.alias("bottom_index"))
    if cells_ is None:
        return df
    height = stats.groupBy("chart_id").agg(F.max("high").alias("_max"))
    df = df.join(height, "chart_id").withColumn("_b", F.least("box_index", "_max"))
    at_ = cells_.select("chart_id", "column_index", F.col("box_index").alias("_b"), "action_seq")
    return df.join(at_, ["chart_id", "column_index", "_b"], "left").withColumn("action_seq", F.coalesce("action_seq", F.lit(0))).drop("_max", "_b")


def multiple(marks: DataFrame, m: int, trend: int) -> DataFrame:
    """Breakouts of m hits within 2m - 1 columns."""
    return marks.filter((F.col("trend") == trend) & (F.col("hits") == m) & (F.col("width") <= 2 * m - 1))


def multiple_prices(series: DataFrame, cells_: DataFrame, marks: DataFrame, m: int, trend: int) -> DataFrame:
    """Rows of time_series() at which a column has come as far as such a breakout's box, with `price`, that box's value.

    A row that serves several breakouts has the price of the last by column, box and hits.
    """
    values = cells_.select("chart_id", "box_index", F.col("box_value").alias("price")).distinct()
    asked = multiple(marks, m, trend).select("chart_id", "column_index", "box_index", "hits").join(values, ["chart_id", "box_index"])
    met = series.join(asked, ["chart_id", "column_index"]).filter((F.col("box_value") - F.col("price")) * trend >= 0)
    first = met.groupBy("chart_id", "column_index", "price", "box_index", "hits").agg(F.min("seq").alias("seq"))
    return first.groupBy("chart_id", "column_index", "seq").agg(F.max_by("price", F.struct("box_index", "hits")).alias("price"))


def next_simple_signal(stats: DataFrame) -> DataFrame:
    """Box indexes at which each chart would next buy and sell, from its last three columns; charts of fewer have none."""
    last = stats.withColumn("_k", F.row_number().over(by_chart().orderBy(F.desc("column_index")))).filter("_k <= 3")
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    df = last.groupBy("chart_id").agg(F.count("*").alias("_n"), at(1, "trend").alias("t"), *[at(k, c).alias(f"{c}{k}") for k in (1, 2, 3) for c in ("high", "low")]).filter("_n = 3")
    buy = F.when(F.col("t") == 1, F.when(F.col("high1") <= F.col("high3"), F.col("high3") + 1)).otherwise(F.col("high2") + 1)
    sell = F.when(F.col("t") == -1, F.when(F.col("low1") >= F.col("low3"), F.col("low3") - 1)).otherwise(F.col("low2") - 1)
    return df.select("chart_id", buy.alias("next_buy"), sell.alias("next_sell"))


#: What a chart's arrays have for null.
NONE = -(2**31)
LINE = "chart_id STRING, bounded STRING, type STRING, length INT, column_index INT, box_index INT"


class Lines:
    """The lines of one chart: a few numbers for each of its columns are kept, and walked from left to right.

    A column has one line at most: rising (1) below an O column, falling (-1) above an X column. Lines that reach the chart's end
    count `pad` columns beyond it.
    """

    def __init__(self, chart: str, length: int, weak: bool):
        self.chart, self.least, self.weak, self.held = chart, length, weak, []

    def step(self, frame) -> list[tuple]:
        names = ["column_index", "sign", "start", "stop", "touch", "up", "down"]
        self.held.append(frame[names].astype(float).fillna(NONE).to_numpy(np.int32))
        return []

    @staticmethod
    def stops(rows: np.ndarray) -> np.ndarray:
        """Weak lines end at the first column with a breakout against them: at or above a falling line, below a rising one."""
        out, stacks = np.full(len(rows), NONE), {1: [], -1: []}
        for i in range(len(rows) - 1, -1, -1):
            n, sign, start, _, _, up, down = rows[i].tolist()
            if sign:
                # In the line's own direction breakouts lie on diagonals; the nearest whose diagonal is far enough ends it.
                stack = stacks[sign]
                far = start + n if sign < 0 else n - start + 1
                lo, hi = 0, len(stack)
                while lo < hi:  # the farther down the stack, the later and the farther
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if stack[mid][0] >= far else (lo, mid)
                out[i] = stack[lo - 1][1] if lo else NONE
            for sign, d in ((-1, up), (1, down)):
                if d != NONE:
                    while stacks[sign] and stacks[sign][-1][0] <= d:
                        stacks[sign].pop()
                    stacks[sign].append((d, n))
        return out

    def end(self) -> Iterator[list[tuple]]:
        rows, self.held = np.concatenate(self.held), []
        width, (column, sign, start, stop, touch) = len(rows), rows.T[:5]
        if self.weak:
            stop = self.stops(rows)
        size = np.where(stop == NONE, width + self.least - 1, stop) - column
        line = np.where(size >= self.least, sign * size, 0).astype(np.int64)
        outer = self.walk(line, np.where(touch == NONE, width, touch))
        at = np.flatnonzero(line)
        size = np.abs(line[at])
        size = np.where(size + at >= width, size - self.least + 1, size)
        for k in range(0, len(at), 50_000):
            some = zip(at[k : k + 50_000].tolist(), line[at[k : k + 50_000]].tolist(), size[k : k + 50_000].tolist())
            yield [(self.chart, "external" if i in outer else "internal", "bullish support" if x > 0 else "bearish resistance", n, i, int(start[i])) for i, x, n in some if n]

    @staticmethod
    def walk(line: np.ndarray, touch: np.ndarray) -> set:
        """The columns of the outer chain. Within a line's span an opposite line that leaves it is preferred, else the chain goes on behind it.

        Lines within a span whose opposite lines all stay inside it are taken out of `line`. An opposite line that meets a filled box within the
        span does not count; of lines of one length the first one's boxes are looked at.
        """
        width, some = len(line), np.flatnonzero(line)
        if not len(some):
            return set()
        at, turns = int(some[0]), 0
        outer = {at}
        while at + abs(int(line[at])) <= width - 1 and turns <= width:
            sign, span = np.sign(line[at]), abs(int(line[at]))
            part = line[at : at + span]
            across = np.where(np.sign(part) == -sign, np.abs(part), 0)
            for x in np.flatnonzero(across).tolist():
                b = int(np.argmax(across == across[x]))
                if touch[at + b] < at + span:
                    across[x] = 0
            reach = np.where(across > 0, np.arange(1, len(across) + 1) + across, 0)
            turns += 1
            if reach.any():
                if reach.max() > len(across):
                    at += int(np.argmax(reach))
                    outer.add(at)
                else:
                    line[at + 1 : at + span - 1] = 0
                continue
            at += span
            while at < width and not line[at]:
                at += 1
            if at == width:
                break
            outer.add(at)
        return outer


def _met(cells_: DataFrame, stats: DataFrame, lines: DataFrame, size: int = SHARE) -> DataFrame:
    """chart_id, column_index, stop, touch: the first columns after its own in which each line meets a box, and meets one if a rising line is looked at one row lower.

    Boxes of one diagonal share box_index + column_index, or box_index - column_index. Cells are shuffled once, by runs of columns that
    hold about `size` of them; a line is looked for in all runs that it crosses before it leaves the chart's rows.
    """
    per = stats.groupBy("chart_id").agg((F.max("column_index") + 1).alias("_n"), F.max("high").alias("_top"), F.sum("height").alias("_k"))
    per = once(per.select("chart_id", "_n", "_top", F.greatest(F.lit(1), F.least("_n", F.floor(F.col("_n") * F.lit(float(size)) / F.col("_k")))).cast("int").alias("_run")), "runs")
    runs = per.agg(F.sum(F.ceil(F.col("_n") / F.col("_run")))).first()[0] or 0
    run = lambda c: F.floor(c / F.col("_run")).cast("int")
    each = cells_.join(F.broadcast(per), "chart_id").select("chart_id", run(F.col("column_index")).alias("_part"), F.lit(0).alias("sign"), F.col("column_index").cast("int"), F.col("box_index").cast("int").alias("row"))
    end = F.least(F.col("_n") - 1, F.col("column_index") + F.when(F.col("sign") > 0, F.col("_top") - F.col("start") + 1).otherwise(F.col("start")))
    asked = lines.filter("sign <> 0").join(F.broadcast(per), "chart_id").withColumn("_end", end).filter("_end > column_index")
    asked = asked.select("chart_id", F.explode(F.sequence(run(F.col("column_index") + 1), run(F.col("_end")))).alias("_part"), F.col("sign").cast("int").alias("sign"), F.col("column_index").cast("int"), F.col("start").cast("int").alias("row"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        chart, (sign, column, row) = t["chart_id"][0].as_py(), (t[c].to_numpy().astype(np.int64) for c in ("sign", "column_index", "row"))
        del t
        boxes = np.flatnonzero(sign == 0)
        if not len(boxes):
            return
        base = int(column[boxes].min())
        at, wide = column[boxes] - base + 1, int(column[boxes].max()) - base + 3
        for way in (1, -1):
            lines_ = np.flatnonzero(sign == way)
            d = row[boxes] - way * column[boxes]
            low = int(d.min())
            place = np.sort((d - low) * wide + at)
            values = []
            for lower in (0, int(way > 0)):
                d = row[lines_] - way * column[lines_] - lower - low
                k = np.searchsorted(place, d * wide + np.maximum(column[lines_] - base + 1, 0), side="right")
                found = place[np.minimum(k, len(place) - 1)]
                values.append(np.where((k < len(place)) & (found // wide == d), found % wide + base - 1, NONE))
            some = np.flatnonzero((values[0] != NONE) | (values[1] != NONE))
            null = lambda v: pa.array(v[some], pa.int32(), mask=v[some] == NONE)
            yield pa.RecordBatch.from_arrays([_named(np.zeros(len(some), int), [chart]), pa.array(column[lines_[some]], pa.int32()), *map(null, values)], names=["chart_id", "column_index", "stop", "touch"])

    both = each.unionByName(asked).repartition(max(int(runs), int(cells_.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "chart_id", "_part")
    met = both.groupBy("chart_id", "_part").applyInArrow(meet, "chart_id STRING, column_index INT, stop INT, touch INT")
    return met.groupBy("chart_id", "column_index").agg(F.min("stop").alias("stop"), F.min("touch").alias("touch"))


def trendlines(cells_: DataFrame, stats: DataFrame, length: int = 4, marks: DataFrame | None = None, lowest: bool = False) -> DataFrame:
    """Lines that fall at 45 degrees from above each X column, or rise from below each O column, of `length` or to the chart's end.

    Strong lines end at the first filled box; weak ones, for which marks are given, at a breakout against them. Outer lines form one chain
    from left to right, `external`; the others are `internal`. `lowest`: whether lines begin below the chart's lowest row, too.

    Where lines meet boxes is found for some columns at a time; what is left for the walk is a row a column.
    """
    weak = marks is not None
    least = max(4 if weak else 3, length)
    sign = F.when(F.col("trend") == -1, 1).otherwise(-1)
    if not lowest:
        sign = F.when((F.col("trend") == -1) & (F.col("low") == 0), 0).when((F.col("trend") == 1) & (F.col("high") == 0), 0).otherwise(sign)
    start = F.when(F.col("trend") == 1, F.col("high") + 1).otherwise(F.col("low") - 1)
    lines = stats.select("chart_id", "column_index", sign.alias("sign"), start.alias("start"))
    df = lines.join(_met(cells_, stats, lines), ["chart_id", "column_index"], "left")
    if weak:
        own = F.col("box_index")
        far = marks.groupBy("chart_id", "column_index").agg(F.max(F.when(F.col("trend") == 1, own + F.col("column_index"))).alias("up"), F.max(F.when(F.col("trend") == -1, F.col("column_index") - own)).alias("down"))
        df = df.join(far, ["chart_id", "column_index"], "left")
    else:
        df = df.withColumns({"up": F.lit(None).cast("int"), "down": F.lit(None).cast("int")})
    return fold(df, "chart_id", ["column_index"], LINE, lambda chart: Lines(chart, least, weak))


def weak_trendlines(cells_: DataFrame, stats: DataFrame, marks: DataFrame, length: int = 4, lowest: bool = False) -> DataFrame:
    return trendlines(cells_, stats, length, marks, lowest)


COUNT = ["chart_id", "trend", "type", "column_index", "box_index", "box", "anchor_column", "anchor_box", "length", "target", "reward", "risk_1", "risk_2", "ratio_1", "ratio_2", "quality"]


def scale_rows(rows: DataFrame, rules, more: int) -> DataFrame:
    """rows (chart_id, row, value) of each chart's boxes with so many above and below. Scales don't go below their beginning."""
    ends = rows.groupBy("chart_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max("row").alias("top"))

    def beyond(low: float, high: float, top: int) -> list:
        grid = scale(low, high, rules, more)
        a, b = int(np.argmin(np.abs(grid - low))), int(np.argmin(np.abs(grid - high)))
        return [(top + k, float(v)) for k, v in enumerate(grid[b + 1 : b + 1 + more], 1)] + [(-k, float(v)) for k, v in enumerate(grid[max(0, a - more) : a][::-1], 1)]

    class Ends:
        def __init__(self, chart):
            self.chart = chart

        def step(self, frame) -> list[tuple]:
            return [(self.chart, r, v) for x in frame[["low", "high", "top"]].itertuples(index=False) for r, v in beyond(float(x[0]), float(x[1]), int(x[2]))]

        def end(self) -> list[tuple]:
            return []

    return rows.unionByName(fold(ends, "chart_id", [], "chart_id STRING, row INT, value DOUBLE", Ends))


def _beyond(rules):
    """Values of rows above a chart's top or below 0: the step-frozen scale goes on by its percentage, in hundredths, to infinity and to 0."""
    step = 1 + rules.boxsize / 100

    def grown(k: int) -> float:
        try:
            return step**k
        except OverflowError:
            return float("inf")

    def values(row: pd.Series, low: pd.Series, high: pd.Series, top: pd.Series) -> pd.Series:
        each = zip(row.tolist(), low.tolist(), high.tolist(), top.tolist())
        return pd.Series([round(h * grown(r - t), 2) if r > t else round(l / grown(-r), 2) if r < 0 else None for r, l, h, t in each], dtype=float)

    return F.pandas_udf(values, "double")


def _extent(stats: DataFrame, marks: DataFrame, reversal: int, least: int) -> int:
    """How many rows a count can reach beyond a chart: by its highest column, or its widest reversal pattern."""
    height = stats.agg(F.max("height")).first()[0] or 0
    wide = marks.filter("type = 'reversal'").agg(F.max("outer_width")).first()[0] or 0
    return int(max(2 * reversal * height, reversal * max(wide, least)) + 1)


def _valued(df: DataFrame, cells_: DataFrame, rules, stats: DataFrame, marks: DataFrame, least: int) -> DataFrame:
    """Counts with rows `_anchor`, `_target`, `_stop1` and `_stop2`, as COUNT: their values, the reward and the risks. Of fixed grids, rows below the scale are its lowest."""
    rows = once(cells_.select("chart_id", F.col("box_index").cast("int").alias("row"), F.col("box_value").alias("value")).distinct(), "scale")
    names = ("_anchor", "_target", "_stop1", "_stop2", "box_index")
    if rules.scaling == "log":
        ends = rows.groupBy("chart_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.max("row").alias("_top"))
        df, beyond = df.join(F.broadcast(ends), "chart_id"), _beyond(rules)
        df = df.withColumns({f"{n}_beyond": beyond(F.col(n).cast("int"), "_low", "_high", "_top") for n in names})
    else:
        rows = scale_rows(rows, rules, _extent(stats, marks, rules.reversal, least))
        df = df.join(rows.groupBy("chart_id").agg(F.min("row").alias("_least")), "chart_id").withColumns({n: F.greatest(n, "_least") for n in names[:4]})
        df = df.withColumns({f"{n}_beyond": F.lit(None).cast("double") for n in names})
    for name in names:
        df = df.withColumn("row", F.col(name).cast("int")).join(rows.withColumnRenamed("value", f"{name}_value"), ["chart_id", "row"], "left").drop("row")
        df = df.withColumn(f"{name}_value", F.coalesce(f"{name}_beyond", f"{name}_value"))
    sign, box = F.col("trend"), F.col("box_index_value")
    reward = (F.col("_target_value") - box) * sign
    risks = [(box - F.col(f"_stop{k}_value")) * sign for k in (1, 2)]
    two = lambda x: F.round(x, 2)
    return df.select(
        "chart_id", "trend", "type", "column_index", "box_index", box.alias("box"), "anchor_column", F.col("_anchor_value").alias("anchor_box"), F.col("length").cast("int").alias("length"), F.col("_target_value").alias("target"),
        F.round(reward, 6).alias("reward"), F.round(risks[0], 6).alias("risk_1"), F.round(risks[1], 6).alias("risk_2"), two(F.try_divide(reward, risks[0])).alias("ratio_1"), two(F.try_divide(reward, risks[1])).alias("ratio_2"), two("quality").alias("quality"),
    )


def least_between(keys: np.ndarray, first: np.ndarray, last: np.ndarray, block: int = 32) -> np.ndarray:
    """The least of keys[first..last] of each pair: ends of blocks by running minima, blocks between them by minima over powers of two."""
    n = -(-len(keys) // block)
    k = np.full((n, block), np.iinfo(np.int64).max)
    k.ravel()[: len(keys)] = keys
    up, down = np.minimum.accumulate(k, 1).ravel(), np.minimum.accumulate(k[:, ::-1], 1)[:, ::-1].ravel()
    a, b = first // block, last // block
    out = np.minimum(down[first], up[last])
    same = np.flatnonzero(a == b)
    for at in np.array_split(same, len(same) // 50_000 + 1):
        place = np.arange(block)
        inside = (place >= (first[at] % block)[:, None]) & (place <= (last[at] % block)[:, None])
        out[at] = np.where(inside, k[a[at]], np.iinfo(np.int64).max).min(1)
    table, size = k.min(1), 1
    between = b - a - 1
    while size <= n:
        at = np.flatnonzero((between >= size) & (between < 2 * size))
        out[at] = np.minimum(out[at], np.minimum(table[a[at] + 1], table[b[at] - size]))
        table, size = np.minimum(table[: len(table) - size], table[size:]), 2 * size
    return out


def filled_below(foot: np.ndarray, head: np.ndarray, to: np.ndarray, row: np.ndarray, block: int = 64) -> np.ndarray:
    """For each pair (to, row) how many rows below `row` the columns 0..to fill, column by column; nothing for to = -1.

    Rows are counted for whole blocks of columns, by sums of sums over feet and heads; the columns of a pair's own block are looked at singly.
    """
    out = np.zeros(len(to), np.int64)
    if not len(to):
        return out
    low = min(int(foot.min()), int(row.min()))
    foot, over, row = foot - low, head + 1 - low, row - low
    counts, done = np.zeros(max(int(over.max()), int(row.max())) + 2, np.int64), 0
    order = np.argsort(to, kind="stable")
    of = to[order] // block
    cuts = [*np.flatnonzero(np.diff(of, prepend=of[0] - 1)).tolist(), len(of)]
    for i, j in zip(cuts, cuts[1:]):
        start = int(of[i]) * block
        if start < 0:
            continue
        np.add.at(counts, foot[done:start], 1)
        np.add.at(counts, over[done:start], -1)
        done = start
        below = np.concatenate([[0], np.cumsum(np.cumsum(counts))])
        own = np.arange(start, min(start + block, len(foot)))
        for q in np.array_split(order[i:j], (j - i) // 20_000 + 1):
            r = row[q][:, None]
            each = np.maximum(r - foot[own], 0) - np.maximum(r - over[own], 0)
            out[q] = below[row[q]] + np.where(own <= to[q][:, None], each, 0).sum(1)
    return out


PATTERN = ["chart_id", "trend", "type", "column_index", "box_index", "hits", "width", "outer_width"]


def _patterns(stats: DataFrame, marks: DataFrame, width: str, begins: bool = False, size: int = SHARE) -> DataFrame:
    """marks with what their columns hold: the farthest row against the trend and the last column that has it, the rows of the first, the last but one and the last column,
    and how many boxes are filled before the breakout. begins: only those whose first column is of the trend and has the farthest row.

    Rows are looked at in the trend's direction: what is low for a bull is high, negative, for a bear. A pattern's columns are not spread
    out: a task has some `size` marks of a chart and four numbers of each of its columns, and asks for least rows and sums between two columns.
    """
    names = ["_foot", "_last", "_foot1", "_t1", "_height1", "_foot2", "_own"]
    types = {"chart_id": "STRING", "type": "STRING", "_filled": "BIGINT"}
    schema = ", ".join(f"{c} {types.get(c, 'INT')}" for c in [*PATTERN, *names, "_filled"])
    fields = pa.schema([(c, {"STRING": pa.string(), "BIGINT": pa.int64()}.get(types.get(c), pa.int32())) for c in [*PATTERN, *names, "_filled"]])

    def held(asked: pa.Table, columns_: pa.Table) -> pa.Table:
        if not asked.num_rows or not columns_.num_rows:
            return fields.empty_table()
        place = columns_["column_index"].to_numpy()
        n = int(place.max()) + 1
        high, low, height, trend = (np.zeros(n, np.int64) for _ in range(4))
        for a, c in ((high, "high"), (low, "low"), (height, "height"), (trend, "trend")):
            a[place] = columns_[c].to_numpy()
        sign, column, box, wide = (asked[c].to_numpy().astype(np.int64) for c in ("trend", "column_index", "box_index", width))
        out = []
        for way, foot, head in ((1, low, high), (-1, -high, -low)):
            at = np.flatnonzero(sign == way)
            last, first = column[at], column[at] - wide[at] + 1
            least = least_between(foot * n + (n - 1 - np.arange(n)), first, last)
            if begins:
                keep = (foot[first] == least // n) & (trend[first] == way)
                at, last, first, least = at[keep], last[keep], first[keep], least[keep]
            so_far = filled_below(foot, head, np.concatenate([last, first - 1]), np.tile(way * box[at], 2))
            values = [least // n, n - 1 - least % n, foot[first], trend[first], height[first], foot[last - 1], foot[last], so_far[: len(at)] - so_far[len(at) :]]
            rows = asked.select(PATTERN).take(pa.array(at))
            for c, v in zip([*names, "_filled"], values):
                rows = rows.append_column(c, pa.array(v))
            out.append(rows.cast(fields))
        return pa.concat_tables(out)

    shares = once(marks.groupBy("chart_id").agg(F.ceil(F.count("*") / size).cast("int").alias("_n")), "shares")
    parts = max(shares.agg(F.sum("_n")).first()[0] or 0, int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = marks.select(PATTERN).join(F.broadcast(shares), "chart_id").withColumn("_part", F.pmod(F.hash("column_index"), "_n")).drop("_n")
    figures = stats.select("chart_id", "column_index", "trend", "high", "low", "height").join(F.broadcast(shares), "chart_id")
    figures = figures.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    dealt = [df.repartition(parts, "chart_id", "_part").groupBy("chart_id", "_part") for df in (asked, figures)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(held, schema)


def _quality(width: str) -> Column:
    """The filled share of a pattern's boxes before its breakout."""
    h = F.col("trend") * F.col("box_index") - F.col("_foot")
    return F.col("_filled") / ((F.col(width).cast("bigint") - 1) * (h - 1) + h)


def vertical_counts(stats: DataFrame, marks: DataFrame, cells_: DataFrame, rules, least: int = 5) -> DataFrame:
    """Counts of breakouts whose first column begins at the pattern's farthest row, in the breakout's direction: its height times the reversal, from one row beyond that row."""
    df = _patterns(stats, marks, "width", begins=True)
    t, foot = F.col("trend"), F.col("_foot")
    df = df.withColumns({
        "type": F.lit("vertical"), "anchor_column": F.col("column_index") - F.col("width") + 1, "length": F.col("_height1"), "_anchor": t * (foot - 1), "_target": t * (foot - 1 + F.col("_height1") * rules.reversal),
        "_stop1": t * (F.col("_foot2") - 1), "_stop2": t * (foot - 1), "quality": _quality("width"),
    })
    return _valued(df, cells_, rules, stats, marks, least)


def horizontal_counts(stats: DataFrame, marks: DataFrame, cells_: DataFrame, rules, least: int = 5) -> DataFrame:
    """Counts of reversal breakouts of at least so many columns: the width times the reversal, from the pattern's farthest row. Bears count like bulls."""
    df = _patterns(stats, marks.filter((F.col("type") == "reversal") & (F.col("width") >= least)), "width")
    t, foot = F.col("trend"), F.col("_foot")
    df = df.withColumns({
        "type": F.lit("horizontal R>1"), "anchor_column": F.col("_last"), "length": F.col("width"), "_anchor": t * foot, "_target": t * (foot + F.col("width") * rules.reversal),
        "_stop1": t * (F.col("_foot2") - 1), "_stop2": t * (foot - 1), "quality": _quality("width"),
    })
    return _valued(df, cells_, rules, stats, marks, least)


def base_counts(stats: DataFrame, marks: DataFrame, cells_: DataFrame, rules, least: int = 5) -> DataFrame:
    """Horizontal counts of one-box charts, of each reversal breakout two: by its base and by its signal, over the outer width.

    The base is the row that has the most filled boxes in the pattern, of equal ones the farthest from the target; its quality is the
    filled share of the row, and a target short of the breakout has no reward. The signal's row is where the breakout's column begins; its
    quality is the filled share of the pattern's boxes before the breakout. The target is the row plus or minus the outer width.

    Boxes of a row within a pattern are a difference of running counts along the row, so that wide patterns cost no more than narrow ones.
    """
    wide = _patterns(stats, marks.filter((F.col("type") == "reversal") & (F.col("outer_width") >= least)), "outer_width")
    wide = once(wide, "wide")
    own = ["chart_id", "column_index", "box_index", "trend", "hits", "outer_width"]
    t, foot = F.col("trend"), F.col("_foot")
    reach = stats.select("chart_id", F.col("column_index").alias("_c"), "high", "low")
    # The pattern's rows, from its farthest one to the breakout's column's end.
    end = F.when(t == 1, F.col("high")).otherwise(-F.col("low"))
    asked = wide.join(reach, (wide["chart_id"] == reach["chart_id"]) & (wide["column_index"] == reach["_c"])).select(*[wide[c] for c in own], F.explode(F.sequence(foot, end)).alias("_f")).withColumn("_r", (t * F.col("_f")).cast("int"))
    ends = F.array(F.struct((F.col("column_index") - F.col("outer_width")).cast("int").alias("_c"), F.lit(-1).alias("_sign")), F.struct(F.col("column_index").cast("int").alias("_c"), F.lit(1).alias("_sign")))
    asked = asked.select("*", F.inline(ends))
    filled = cells_.select("chart_id", F.col("box_index").cast("int").alias("_r"), F.col("column_index").cast("int").alias("_c"), F.lit(1).alias("_one"))
    so_far = F.count("_one").over(Window.partitionBy("chart_id", "_r").orderBy("_c"))
    seen = asked.unionByName(filled, allowMissingColumns=True).withColumn("_n", F.col("_sign") * so_far).filter("_sign IS NOT NULL")
    each = seen.groupBy(*own, "_f").agg(F.sum("_n").alias("_n"))
    base = each.groupBy(own).agg(F.max_by(F.struct("_f", "_n"), F.struct("_n", -F.col("_f"))).alias("_b"))
    df = wide.join(base, own)
    kinds = [
        F.struct(F.lit("horizontal (base) R=1").alias("kind"), F.col("_b._f").alias("_at"), (F.col("_b._n") / F.col("outer_width")).alias("quality")),
        F.struct(F.lit("horizontal (signal) R=1").alias("kind"), F.col("_own").alias("_at"), _quality("outer_width").alias("quality")),
    ]
    df = df.select("*", F.inline(F.array(*kinds)))
    df = df.withColumns({
        "type": F.col("kind"), "anchor_column": F.col("column_index"), "length": F.col("outer_width"), "_anchor": t * F.col("_at"), "_target": t * (F.col("_at") + F.col("outer_width")),
        "_stop1": t * (F.col("_at") - 1), "_stop2": t * (foot - 1),
    })
    out = _valued(df, cells_, rules, stats, marks, least)
    short = (F.col("type") == "horizontal (base) R=1") & (F.col("reward") < 0)
    return out.withColumns({c: F.when(short, 0.0).otherwise(F.col(c)) for c in ("reward", "ratio_1", "ratio_2")})


def counts(stats: DataFrame, marks: DataFrame, cells_: DataFrame, rules, least: int = 5) -> DataFrame:
    """All price targets of charts: by columns and rows, or by base and signal where a turn takes one box."""
    if rules.reversal == 1:
        return without_repeats(base_counts(stats, marks, cells_, rules, least))
    return without_repeats(vertical_counts(stats, marks, cells_, rules, least).unionByName(horizontal_counts(stats, marks, cells_, rules, least)))


def render(cells_: DataFrame, columns: int = 30, lines: DataFrame | None = None) -> DataFrame:
    """The last columns of each chart as text: a line a box, highest first. Boxes that no shown column fills have no line.

    lines: trendlines(), whose external ones are drawn as * where no box stands, from their first column up or down by a box a column.
    """
    ends = once(cells_.groupBy("chart_id").agg(F.max("column_index").alias("_last")), "ends")
    place = F.col("column_index") - F.col("_last") + columns - 1
    shown = once(cells_.select("chart_id", "column_index", "box_index", "box_value", "trend").join(F.broadcast(ends), "chart_id").withColumn("_at", place).filter("_at >= 0"), "shown")
    marked = shown.select("chart_id", "box_index", "box_value", "_at", F.when(F.col("trend") == 1, "X").otherwise("O").alias("m"))
    if lines is not None:
        rising = F.when(F.col("type").startswith("bullish"), 1).otherwise(-1)
        seen = lines.filter("bounded = 'external' AND length > 0").join(F.broadcast(ends), "chart_id")
        from_, to = F.greatest(F.lit(0), F.col("_last") - columns + 1 - F.col("column_index")), F.least(F.col("length") - 1, F.col("_last") - F.col("column_index"))
        steps = seen.withColumns({"_from": from_, "_to": to}).filter("_from <= _to").select("chart_id", "_last", "column_index", "box_index", rising.alias("_s"), F.explode(F.sequence("_from", "_to")).alias("_k"))
        on = steps.select("chart_id", "_last", (F.col("column_index") + F.col("_k")).alias("column_index"), (F.col("box_index") + F.col("_s") * F.col("_k")).alias("box_index")).distinct()
        free = on.join(shown, ["chart_id", "column_index", "box_index"], "left_anti").withColumn("_at", place)
        boxes = marked.select("chart_id", "box_index", "box_value").distinct()
        marked = marked.unionByName(free.join(boxes, ["chart_id", "box_index"]).select("chart_id", "box_index", "box_value", "_at", F.lit("*").alias("m")))
    marks = marked.groupBy("chart_id", "box_index", "box_value").agg(F.map_from_entries(F.collect_list(F.struct("_at", "m"))).alias("_m"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda i: F.coalesce(F.col("_m")[i.cast("int")], F.lit("."))), " ")
    rank = F.row_number().over(by_chart().orderBy(F.desc("box_index")))
    return marks.select("chart_id", rank.alias("line"), "box_value", line.alias("text"))


def without_repeats(counts: DataFrame) -> DataFrame:
    """Drops a count whose length, column and box are those of the next, in order of type, column and box."""
    w = by_chart().orderBy("type", "column_index", "box_index", "length", "target")
    same = [F.col(c) == F.lead(c).over(w) for c in ("length", "column_index", "box_index")]
    return counts.withColumn("_same", F.coalesce(reduce(Column.__and__, same), F.lit(False))).filter("NOT _same").drop("_same")
