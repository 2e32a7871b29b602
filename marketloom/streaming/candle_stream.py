"""Candles of a live tick stream: one state machine a symbol, its output rolled up and written idempotently.

State of a symbol: the current candle, the one waiting to close, how many ticks newer buckets have had, the last closed bucket and
the partial first one. A waiting candle closes at the second tick of newer buckets, or when the clock passes its end plus a grace;
late ticks are dropped by the symbol's own last closed bucket. A waiting candle is never lost: it closes before another takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marketloom.functions.folds import fold
from marketloom.functions.timebucket import IST, OPEN, OPEN_MCX

CANDLE = "symbol STRING, bucket_epoch BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, gap_from BIGINT"
STATE = "current ARRAY<DOUBLE>, pending ARRAY<DOUBLE>, newer BIGINT, last_closed BIGINT, partial BIGINT, started BOOLEAN"


def bucket_of(e: int, symbol: str, seconds: int) -> int:
    anchor = (e + IST) // 86_400 * 86_400 + (OPEN_MCX if symbol.startswith("MCX:") else OPEN) - IST
    return anchor + max(e - anchor, 0) // seconds * seconds


class Machine:
    """The state machine of one symbol. Candles are [bucket, open, high, low, close, volume]."""

    def __init__(self, symbol: str, seconds: int, drop_partial_first: bool = True, state=None):
        self.symbol, self.seconds, self.drop = symbol, seconds, drop_partial_first
        current, pending, self.newer, self.last, self.partial, self.started = state or (None, None, 0, None, None, False)
        # State gives a null array back as one null.
        self.current, self.pending = (None if x is None or x[0] is None else list(x) for x in (current, pending))

    def state(self):
        # A state's array of doubles keeps no whole numbers.
        current, pending = (x and [float(v) for v in x] for x in (self.current, self.pending))
        return (current, pending, self.newer, self.last, self.partial, self.started)

    def close(self, candle: list) -> Iterator[tuple]:
        bucket = int(candle[0])
        if self.last is not None and bucket <= self.last:
            return
        gap = self.last + self.seconds if self.last is not None and bucket > self.last + self.seconds else None
        self.last = bucket
        if bucket != self.partial:
            yield (self.symbol, bucket, *candle[1:5], int(candle[5]), gap)

    def tick(self, e: int, price: float) -> Iterator[tuple]:
        bucket = bucket_of(e, self.symbol, self.seconds)
        if not self.started:
            self.started = True
            if self.drop and e > bucket:
                self.partial = bucket
        if self.pending and self.newer >= 2:
            yield from self.close(self.pending)
            self.pending, self.newer = None, 0
        if self.last is not None and bucket <= self.last:
            return
        if self.pending and bucket == self.pending[0]:
            self.update(self.pending, price)
        elif self.current is None:
            self.current = [bucket, price, price, price, price, 1]
            self.newer += self.pending is not None
        elif bucket == self.current[0]:
            self.update(self.current, price)
            self.newer += self.pending is not None
        elif bucket > self.current[0]:
            if self.pending:
                yield from self.close(self.pending)
            self.pending, self.newer, self.current = self.current, 1, [bucket, price, price, price, price, 1]

    @staticmethod
    def update(candle: list, price: float) -> None:
        candle[2], candle[3], candle[4], candle[5] = max(candle[2], price), min(candle[3], price), price, candle[5] + 1

    def due(self, now: float, grace: int) -> Iterator[tuple]:
        """Closes what the clock has passed."""
        for name in ("pending", "current"):
            candle = getattr(self, name)
            if candle and now >= candle[0] + self.seconds + grace:
                yield from self.close(candle)
                setattr(self, name, None)
                self.newer = 0

    def next_due(self, grace: int) -> float | None:
        ends = [c[0] + self.seconds + grace for c in (self.pending, self.current) if c]
        return min(ends) if ends else None


class CandleProcessor(StatefulProcessor):
    """The machine as a stateful operator: ticks in, closed candles out, a timer for idle symbols."""

    def __init__(self, seconds: int, grace: int = 1, drop_partial_first: bool = True, timers: bool = True):
        self.seconds, self.grace, self.drop, self.timers = seconds, grace, drop_partial_first, timers

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", STATE)

    def _machine(self, symbol: str) -> Machine:
        return Machine(symbol, self.seconds, self.drop, self.kept.get() if self.kept.exists() else None)

    def _done(self, machine: Machine, rows: list, timerValues) -> Iterator[pd.DataFrame]:
        current, pending, newer, last, partial, started = machine.state()
        self.kept.update((current, pending, newer, last, partial, started))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            end = machine.next_due(self.grace)
            if end is not None:
                # A timer in the past would not run: what is overdue is closed by the next micro-batch.
                self.handle.registerTimer(max(int(end * 1000), timerValues.getCurrentProcessingTimeInMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDLE.split(", ")])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Seeds a symbol with the last bucket that it has stored: ticks of it and of earlier ones are late, later ones show gaps."""
        machine = Machine(key[0], self.seconds, self.drop)
        machine.last = int(initialState["bucket_epoch"].max())
        self.kept.update(machine.state())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, out = self._machine(key[0]), []
        batch = pd.concat([b[["seq", "e", "ltp"]] for b in rows])  # a micro-batch of one symbol, in order of arrival
        for e, price in batch.sort_values("seq")[["e", "ltp"]].itertuples(index=False):
            out += machine.tick(int(e), float(price))
        yield from self._done(machine, out, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._machine(key[0])
        yield from self._done(machine, list(machine.due(expiredTimerInfo.getExpiryTimeInMs() / 1000, self.grace)), timerValues)

    def close(self) -> None:
        pass


def live_candles(ticks: DataFrame, seconds: int, grace: int = 1, drop_partial_first: bool = True, timers: bool = True, seed: DataFrame | None = None) -> DataFrame:
    """Closed candles of streaming ticks (symbol, e, ltp, seq). gap_from: the first bucket missing before the candle, if any.

    seed: stored candles (symbol, bucket_epoch), whose last bucket a symbol starts from. Needs the RocksDB state store. Without timers
    only ticks close candles, which makes a replay deterministic.
    """
    processor = CandleProcessor(seconds, grace, drop_partial_first, timers)
    start = seed.groupBy("symbol").agg(F.max("bucket_epoch").alias("bucket_epoch")).groupBy("symbol") if seed is not None else None
    return ticks.groupBy("symbol").transformWithStateInPandas(processor, outputStructType=CANDLE, outputMode="append", timeMode="ProcessingTime" if timers else "none", initialState=start)


class _Replay:
    """The machine as a fold over stored ticks."""

    def __init__(self, symbol: str, seconds: int, drop_partial_first: bool):
        self.machine, self.begun = Machine(symbol, seconds, drop_partial_first), False

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        if not self.begun and "_last" in rows and not pd.isna(rows["_last"].iloc[0]):
            self.machine.last = int(rows["_last"].iloc[0])
        self.begun, out = True, []
        for e, price in zip(rows["e"].tolist(), rows["ltp"].tolist()):
            out += self.machine.tick(int(e), float(price))
        return out

    def end(self) -> list[tuple]:
        return []


def replay(ticks: DataFrame, seconds: int, drop_partial_first: bool = True, seed: DataFrame | None = None) -> DataFrame:
    """The same machine over a stored stream, in memory of one batch of ticks; candles still open at its end are not given."""
    rows = ticks.select("symbol", "e", "ltp", "seq")
    if seed is not None:
        rows = rows.join(seed.groupBy("symbol").agg(F.max("bucket_epoch").alias("_last")), "symbol", "left")
    return fold(rows, "symbol", ["seq"], CANDLE, lambda symbol: _Replay(symbol, seconds, drop_partial_first))


ROLL = "symbol STRING, bucket_epoch BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"


class Roller:
    """Closed candles of one symbol, rolled up as they come: a target bucket is given when it has all its source buckets, in order."""

    def __init__(self, symbol: str, source: int, target: int, state=None):
        self.symbol, self.source, self.target = symbol, source, target
        self.bucket, self.next, self.held = state or (None, None, None)
        self.held = None if self.held is None or self.held[0] is None else list(self.held)

    def state(self):
        return (self.bucket, self.next, self.held)

    def candle(self, bucket: int, o: float, h: float, l: float, c: float, volume: int) -> Iterator[tuple]:
        own = bucket_of(bucket, self.symbol, self.target)
        if bucket == own:
            self.bucket, self.next, self.held = own, bucket + self.source, [o, h, l, c, float(volume)]
        elif own == self.bucket and bucket == self.next:
            x = self.held
            self.next, self.held = bucket + self.source, [x[0], max(x[1], h), min(x[2], l), c, x[4] + volume]
        elif own != self.bucket or bucket > (self.next or 0):
            self.bucket, self.next, self.held = None, None, None  # something is missing
            return
        else:
            return
        if self.next == own + self.target:
            yield (self.symbol, own, *self.held[:4], int(self.held[4]))
            self.bucket, self.next, self.held = None, None, None


class RollProcessor(StatefulProcessor):
    def __init__(self, source: int, target: int):
        self.source, self.target = source, target

    def init(self, handle) -> None:
        self.kept = handle.getValueState("roller", "bucket BIGINT, next BIGINT, held ARRAY<DOUBLE>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        roller, out = Roller(key[0], self.source, self.target, self.kept.get() if self.kept.exists() else None), []
        names = ["bucket_epoch", "open", "high", "low", "close", "volume"]
        for row in pd.concat([b[names] for b in rows]).sort_values("bucket_epoch").itertuples(index=False):
            out += roller.candle(int(row[0]), *map(float, row[1:5]), int(row[5]))
        self.kept.update(roller.state())
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ROLL.split(", ")])

    def close(self) -> None:
        pass


def live_rollup(closed: DataFrame, source: int, target: int) -> DataFrame:
    """Streaming closed candles of `source` seconds as candles of `target` seconds. Of a bucket that lacks a candle nothing is given."""
    return closed.groupBy("symbol").transformWithStateInPandas(RollProcessor(source, target), outputStructType=ROLL, outputMode="append", timeMode="none")


def event_time_candles(ticks: DataFrame, steps: list[int], lateness: str = "1 second") -> DataFrame:
    """Streaming candles of the last of `steps` seconds in one query, by Spark's own watermark: ticks to candles of the first step, those to the next.

    A bucket is final when event time passes its end by `lateness`. Steps divide each other and a quarter of an hour, so the session's
    opening begins a bucket; ticks before the opening belong to the first. From the second step on, buckets that lack a source are
    left out. Ticks (symbol, e, ltp, seq).
    """
    bad = [s for a, s in zip([1, *steps], steps) if s % a or 900 % s]
    if bad:
        raise ValueError(f"steps must divide each other and 900: {bad}")
    opening = F.when(F.col("symbol").startswith("MCX:"), F.lit(OPEN_MCX)).otherwise(OPEN) - IST
    anchor = F.floor((F.col("e") + IST) / 86_400) * 86_400 + opening
    timed = ticks.withColumn("_ts", F.timestamp_seconds(F.greatest(F.col("e"), anchor))).withWatermark("_ts", lateness)
    first = [F.min_by("ltp", "seq").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "seq").alias("close"), F.count("*").alias("volume")]
    out = timed.groupBy("symbol", F.window("_ts", f"{steps[0]} seconds").alias("_w")).agg(*first)
    for source, target in zip(steps, steps[1:]):
        start = F.col("_w.start")
        out = out.groupBy("symbol", F.window(F.window_time("_w"), f"{target} seconds").alias("_v")).agg(
            F.min_by("open", start).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", start).alias("close"),
            F.sum("volume").alias("volume"), F.count("*").alias("_n"),
        ).filter(F.col("_n") == target // source).withColumnRenamed("_v", "_w")
    return out.select("symbol", F.unix_seconds("_w.start").alias("bucket_epoch"), "open", "high", "low", "close", "volume")


def write_once(path: str):
    """A foreachBatch function that appends candles whose (symbol, bucket) is not yet at path, so a repeated batch adds nothing.

    Candles lie by day, and a batch is compared with the days that it has, not with all that was ever written.
    """

    def write(batch: DataFrame, _id: int) -> None:
        spark, rows = batch.sparkSession, batch.dropDuplicates(["symbol", "bucket_epoch"]).withColumn("day", F.floor(F.col("bucket_epoch") / 86_400))
        days = [r[0] for r in rows.select("day").distinct().collect()]  # a batch has few
        try:
            have = spark.read.parquet(path).filter(F.col("day").isin(days)).select("symbol", "bucket_epoch")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            have = None
        if have is not None:
            rows = rows.join(have, ["symbol", "bucket_epoch"], "left_anti")
        if days:
            rows.write.mode("append").partitionBy("day").parquet(path)

    return write
