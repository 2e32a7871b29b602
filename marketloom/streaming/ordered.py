"""Keyed streams in order of event time, and what runs on them: a paper book over candles and ticks, and gaps filled from history.

Rows of a key may come in any order within the stream's lateness. They wait in the key's state until the watermark has passed them,
and are then taken in order, so a result hangs neither on micro-batches nor on the order of arrival. State is what waits and what the
book or the filler keeps; both survive a restart with the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketloom.functions.folds import fold
from marketloom.operators.paper import Book

EVENT = "at BIGINT, kind INT, seq BIGINT, price DOUBLE, epoch BIGINT, signal STRING"
BOOK = "side STRING, entry DOUBLE, since BIGINT, realized DOUBLE, minute BIGINT, price DOUBLE, epoch BIGINT"
PAPER = "symbol STRING, event STRING, side STRING, entry_price DOUBLE, entry_epoch BIGINT, price DOUBLE, epoch BIGINT, reason STRING, pnl DOUBLE, realized DOUBLE"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def plain(x):
    """A value of a pandas frame as a Python one; NaN is null."""
    x = x.item() if hasattr(x, "item") else x
    return None if x is None or x != x else x


class InOrder(StatefulProcessor):
    """Takes a key's rows (the columns of `row`, `at` first, in seconds) in the order of those columns, once the watermark has passed `at`.

    start(key, state) makes the object that takes them: event(*row) gives tuples of the schema `out`, state() what is kept of it.
    """

    def __init__(self, row: str, kept: str, out: str, start):
        self.row, self.kept_as, self.out, self.start = row, kept, out, start

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.kept = handle.getValueState("kept", self.kept_as)

    def _taken(self, key, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.waiting.get()] + rows if self.waiting.exists() else rows
        due = sorted((r for r in rows if r[0] * 1000 <= watermark), key=lambda r: tuple((x is not None, x) for x in r))
        rest = [r for r in rows if r[0] * 1000 > watermark]
        if due:
            machine = self.start(key[0], tuple(self.kept.get()) if self.kept.exists() else None)
            out = [x for r in due for x in machine.event(*r)]
            self.kept.update(machine.state())
            if out:
                yield pd.DataFrame(out, columns=names_of(self.out))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(min(r[0] for r in rest) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = names_of(self.row)
        new = [tuple(plain(x) for x in r) for b in rows for r in b[names].itertuples(index=False)]
        yield from self._taken(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._taken(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def timed(rows: DataFrame, lateness: str) -> DataFrame:
    """Streaming rows with a watermark on `at`. Of several streams the one that lags decides, so each has its own before they are put together."""
    return rows.withColumn("_ts", F.timestamp_seconds("at")).withWatermark("_ts", lateness)


def in_order(rows: DataFrame, key: str, row: str, kept: str, out: str, start) -> DataFrame:
    """Streaming timed() rows of each key through the object that start makes, in order of event time. Needs the RocksDB state store."""
    return rows.groupBy(key).transformWithStateInPandas(InOrder(row, kept, out, start), outputStructType=out, outputMode="append", timeMode="EventTime")


class LiveBook:
    """A paper book event by event, with marks to market.

    OPEN, CLOSE (with its reason and profit) and MARK rows; `realized` is the symbol's profit so far. A position is marked by the last
    tick of each `every` seconds in which it had one and didn't end, when a later event shows that they are over.
    """

    def __init__(self, symbol: str, stop: float, target: float, every: int, state: tuple | None = None):
        self.book, self.every = Book(symbol, stop, target), every
        side, entry, since, self.realized, self.minute, self.price, self.epoch = state or (None, None, None, 0.0, None, None, None)
        self.book.open = (side, entry, since) if side is not None else None

    def state(self) -> tuple:
        return (*(self.book.open or (None, None, None)), self.realized, self.minute, self.price, self.epoch)

    def row(self, event: str, position: tuple, price: float, epoch: int, reason: str | None, pnl: float | None) -> tuple:
        return (self.book.symbol, event, *position, price, epoch, reason, pnl, round(self.realized, 2))

    def ended(self, price: float, epoch: int, reason: str) -> Iterator[tuple]:
        position = self.book.open
        pnl = self.book.closed(price, epoch, reason)[-1]
        self.realized, self.minute = self.realized + pnl, None
        yield self.row("CLOSE", position, price, epoch, reason, pnl)

    def event(self, at: int, kind: int, seq: int, price: float, epoch: int, signal: str | None) -> Iterator[tuple]:
        if self.minute is not None and at // self.every > self.minute:
            side, entry, _ = self.book.open
            yield self.row("MARK", self.book.open, self.price, self.epoch, None, round(self.price - entry if side == "BUY" else entry - self.price, 2))
            self.minute = None
        if kind == 0:
            if signal in ("BUY", "SELL") and not (self.book.open and self.book.open[0] == signal):
                if self.book.open:
                    yield from self.ended(price, epoch, "REVERSAL")
                self.book.open = (signal, price, epoch)
                yield self.row("OPEN", self.book.open, price, epoch, None, None)
        elif self.book.open:
            side, entry, _ = self.book.open
            sign = 1 if side == "BUY" else -1
            stop, target = entry - sign * self.book.stop, entry + sign * self.book.target
            if sign * price <= sign * stop and stop != 0:
                yield from self.ended(price, epoch, "SL")
            elif sign * price >= sign * target and target != 0:
                yield from self.ended(price, epoch, "TP")
            else:
                self.minute, self.price, self.epoch = at // self.every, price, epoch

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        return [x for r in rows[names_of(EVENT)].itertuples(index=False) for x in self.event(*map(plain, r))]

    def end(self) -> list[tuple]:
        return []


def book_events(signals: DataFrame, ticks: DataFrame, seconds: int, side=lambda rows: rows) -> DataFrame:
    """Candles with a signal and ticks as one table of events of a symbol: candles act at their end, before the ticks of that second. side: what is done to each of the two first."""
    candles = signals.select(
        "symbol", (F.col("bucket_epoch") + seconds).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.col("close").alias("price"), F.col("bucket_epoch").alias("epoch"), "signal"
    )
    prices = ticks.select("symbol", F.col("e").alias("at"), F.lit(1).alias("kind"), "seq", F.col("ltp").alias("price"), F.col("e").alias("epoch"), F.lit(None).cast("string").alias("signal"))
    return side(candles).unionByName(side(prices))


def live_paper(signals: DataFrame, ticks: DataFrame, seconds: int, stop: float = 10.0, target: float = 20.0, every: int = 60, lateness: str = "10 seconds") -> DataFrame:
    """A paper book a symbol over two streams, candles with a signal and ticks, in whatever order they arrive within the lateness."""
    events = book_events(signals, ticks, seconds, lambda rows: timed(rows, lateness))
    return in_order(events, "symbol", EVENT, BOOK, PAPER, lambda symbol, state: LiveBook(symbol, stop, target, every, state))


def paper_events(signals: DataFrame, ticks: DataFrame, seconds: int, stop: float = 10.0, target: float = 20.0, every: int = 60) -> DataFrame:
    """The same book over stored candles and ticks."""
    return fold(book_events(signals, ticks, seconds), "symbol", ["at", "kind", "seq"], PAPER, lambda symbol: LiveBook(symbol, stop, target, every))


CANDLE = "bucket_epoch BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"
FILLED = f"symbol STRING, {CANDLE}, filled BOOLEAN"
_HELD = "ARRAY<STRUCT<bucket_epoch: BIGINT, open: DOUBLE, high: DOUBLE, low: DOUBLE, close: DOUBLE, volume: BIGINT>>"


class Filler:
    """Closed candles of one symbol, in order, with gaps filled from history.

    A candle behind a gap is held back, and all after it, while history for the gap may come: it is looked at whenever some arrives and
    after each delay, `attempts` times. History that has all of a gap's buckets is given first, in order; if attempts are spent, nothing
    of it is, and the candles go on. Only the gap's own buckets are taken, one row each, the last that came. A gap over midnight in
    India is no gap.
    """

    def __init__(self, symbol: str, seconds: int, attempts: int, state: tuple | None = None):
        self.symbol, self.seconds, self.attempts = symbol, seconds, attempts
        self.last, self.left, held, history = state or (None, attempts, [], [])
        self.held, self.history = [tuple(x) for x in held], {x[0]: tuple(x) for x in history}

    def state(self) -> tuple:
        return (self.last, self.left, sorted(self.held), sorted(self.history.values()))

    def gap(self) -> range | None:
        """The buckets that are missing before the first candle held back."""
        if not self.held or self.last is None:
            return None
        missing = range(self.last + self.seconds, self.held[0][0], self.seconds)
        day = lambda e: (e + 19_800) // 86_400
        return missing if missing and day(self.last) == day(self.held[0][0]) else None

    def given(self, spent: bool = False) -> Iterator[tuple]:
        """What can be given now. spent: one more delay is over."""
        if spent and self.held:
            self.left -= 1
        while self.held:
            missing = self.gap()
            if missing is not None:
                if all(b in self.history for b in missing):
                    yield from ((self.symbol, *self.history[b], True) for b in missing)
                elif self.left > 0:
                    return
            candle = self.held.pop(0)
            self.last, self.left = candle[0], self.attempts
            self.history = {b: x for b, x in self.history.items() if b > self.last}
            yield (self.symbol, *candle, False)

    def candle(self, *row) -> None:
        if (self.last is None or row[0] > self.last) and row[0] not in {x[0] for x in self.held}:
            self.held = sorted([*self.held, row])

    def past(self, *row) -> None:
        if self.last is None or row[0] > self.last:
            self.history[row[0]] = row


class GapProcessor(StatefulProcessor):
    def __init__(self, seconds: int, attempts: int, delay: float):
        self.seconds, self.attempts, self.delay = seconds, attempts, delay

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("filler", f"last BIGINT, left INT, held {_HELD}, history {_HELD}")

    def _done(self, filler: Filler, rows: list, now: int) -> Iterator[pd.DataFrame]:
        self.kept.update(filler.state())
        timers = list(self.handle.listTimers())
        if filler.held and not timers:
            self.handle.registerTimer(now + int(self.delay * 1000))
        elif not filler.held:
            for t in timers:
                self.handle.deleteTimer(t)
        if rows:
            yield pd.DataFrame(rows, columns=names_of(FILLED))

    def _filler(self, key) -> Filler:
        return Filler(key[0], self.seconds, self.attempts, tuple(self.kept.get()) if self.kept.exists() else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        filler, names = self._filler(key), names_of(CANDLE)
        new = sorted((bool(r[0]), *map(plain, r[1:])) for b in rows for r in b[["past", *names]].itertuples(index=False))
        for past, *row in new:
            (filler.past if past else filler.candle)(*row)
        yield from self._done(filler, list(filler.given()), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        filler = self._filler(key)
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        yield from self._done(filler, list(filler.given(spent=True)), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def live_backfill(closed: DataFrame, history: DataFrame, seconds: int, attempts: int = 3, delay: float = 1.0) -> DataFrame:
    """Streaming closed candles with gaps filled from a stream of history (symbol, timestamp, prices, volume); `filled` tells which.

    A symbol's candles come in order of bucket. A gap waits for history at most attempts x delay seconds.
    """
    names = names_of(CANDLE)
    live = closed.select("symbol", *names, F.lit(False).alias("past"))
    old = history.withColumnRenamed("timestamp", "bucket_epoch").select("symbol", *names, F.lit(True).alias("past"))
    return live.unionByName(old).groupBy("symbol").transformWithStateInPandas(GapProcessor(seconds, attempts, delay), outputStructType=FILLED, outputMode="append", timeMode="ProcessingTime")
