"""Strategy signals, paper trades and their results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.folds import fold

TRADE = "symbol STRING, side STRING, entry_price DOUBLE, entry_epoch BIGINT, exit_price DOUBLE, exit_epoch BIGINT, reason STRING, pnl DOUBLE"


def breakout_signal(candles: DataFrame) -> DataFrame:
    """BUY where a close is above the previous high, SELL where it is below the previous low, else NONE."""
    w = Window.partitionBy("symbol").orderBy("bucket_epoch")
    signal = F.when(F.col("close") > F.lag("high").over(w), "BUY").when(F.col("close") < F.lag("low").over(w), "SELL").otherwise("NONE")
    return candles.withColumn("signal", signal)


def profit(side, entry, price, qty: int = 1):
    return F.when(side == "BUY", price - entry).otherwise(entry - price) * qty


class Book:
    """One symbol's position: a signal opens it or turns it, a tick at its stop or target ends it, and then the next signal may open anew.

    The same signal while a position is open changes nothing. A level of exactly 0 is none.
    """

    def __init__(self, symbol: str, stop: float, target: float):
        self.symbol, self.stop, self.target, self.open = symbol, stop, target, None

    def closed(self, price: float | None, epoch: int | None, reason: str) -> tuple:
        side, entry, since = self.open
        self.open = None
        pnl = None if price is None else round(price - entry if side == "BUY" else entry - price, 2)
        return (self.symbol, side, entry, since, price, epoch, reason, pnl)

    def hit(self, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which prices reach the stop, and which the target."""
        side, entry, _ = self.open
        sign = 1 if side == "BUY" else -1
        stop, target = entry - sign * self.stop, entry + sign * self.target
        return (sign * prices <= sign * stop) & (stop != 0), (sign * prices >= sign * target) & (target != 0)

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        out, kinds, prices, epochs = [], rows["kind"].to_numpy(), rows["price"].to_numpy(), rows["epoch"].to_numpy()
        signals = rows["signal"].to_numpy()
        candles = np.flatnonzero(kinds == 0).tolist()
        for a, b in zip([-1, *candles], [*candles, len(rows)]):
            if a >= 0 and signals[a] in ("BUY", "SELL") and not (self.open and self.open[0] == signals[a]):
                if self.open:
                    out.append(self.closed(float(prices[a]), int(epochs[a]), "REVERSAL"))
                self.open = (signals[a], float(prices[a]), int(epochs[a]))
            if self.open and b > a + 1:
                stop, target = self.hit(prices[a + 1 : b])
                some = np.flatnonzero(stop | target)
                if len(some):
                    i = int(some[0])
                    out.append(self.closed(float(prices[a + 1 + i]), int(epochs[a + 1 + i]), "SL" if stop[i] else "TP"))
        return out

    def end(self) -> list[tuple]:
        return [self.closed(None, None, "OPEN")] if self.open else []


def paper_trades(signals: DataFrame, ticks: DataFrame | None = None, seconds: int = 0, stop: float = 10.0, target: float = 20.0) -> DataFrame:
    """Trades of candles with a signal (symbol, bucket_epoch, close, signal) and ticks (symbol, e, ltp, seq), closed or still open.

    A candle acts at its end, `seconds` after its bucket's start, before the ticks of that second. Entry and reversal are at its close,
    and their epochs are its bucket's; an exit by tick is at the tick's price and time.
    """
    none = F.lit(None).cast("string")
    events = signals.select("symbol", (F.col("bucket_epoch") + seconds).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.col("close").alias("price"), F.col("bucket_epoch").alias("epoch"), "signal")
    events = events.filter("signal <> 'NONE'")
    if ticks is not None:
        events = events.unionByName(ticks.select("symbol", F.col("e").alias("at"), F.lit(1).alias("kind"), "seq", F.col("ltp").alias("price"), F.col("e").alias("epoch"), none.alias("signal")))
    return fold(events, "symbol", ["at", "kind", "seq"], TRADE, lambda symbol: Book(symbol, stop, target))


def reversal_trades(signals: DataFrame) -> DataFrame:
    """Trades without levels: the first signal of each run of equal ones enters at the close, the next opposite one exits there."""
    w = Window.partitionBy("symbol").orderBy("bucket_epoch")
    df = signals.filter(F.col("signal") != "NONE").withColumn("_p", F.lag("signal").over(w))
    df = df.filter(F.col("_p").isNull() | (F.col("_p") != F.col("signal")))
    df = df.select("symbol", F.col("signal").alias("side"), F.col("close").alias("entry_price"), F.col("bucket_epoch").alias("entry_epoch"), F.lead("close").over(w).alias("exit_price"), F.lead("bucket_epoch").over(w).alias("exit_epoch"))
    return df.withColumn("pnl", F.round(profit(F.col("side"), F.col("entry_price"), F.col("exit_price")), 2))


def summary(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Realised, unrealised (at the symbol's last price) and total profit of each symbol."""
    df = trades.join(marks.select("symbol", F.col("ltp").alias("_mark")), "symbol", "left")
    done = F.sum(F.when(F.col("exit_epoch").isNotNull(), F.col("pnl")))
    running = F.sum(F.when(F.col("exit_epoch").isNull(), profit(F.col("side"), F.col("entry_price"), F.col("_mark"))))
    out = df.groupBy("symbol").agg(F.count("*").alias("trades"), F.round(F.coalesce(done, F.lit(0.0)), 2).alias("realized"), F.round(F.coalesce(running, F.lit(0.0)), 2).alias("unrealized"))
    return out.withColumn("total", F.round(F.col("realized") + F.col("unrealized"), 2))
