"""Streams: order of event time, restarts, gaps held back, commits, counters, chained candles, timers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from marketloom.operators import candles as C
from marketloom.operators import paper as P
from marketloom.streaming import candle_stream as L
from marketloom.streaming import commits as K
from marketloom.streaming import ordered as O

BASE = 1745379900


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def put(spark, rows, schema, folder, name):
    """One file, and so one micro-batch, of the rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    time.sleep(0.02)


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def run(rows, out, checkpoint, sink=None):
    q = rows.writeStream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    q = q.foreachBatch(sink) if sink else q.format("parquet").option("path", str(out))
    q = q.start()
    assert q.awaitTermination(120)
    return q


def run_until(rows, out, checkpoint, schema, done, seconds=60):
    """Runs a stream whose timers are by the clock until done(its rows) or for so long, and stops it."""
    q = rows.writeStream.option("checkpointLocation", str(checkpoint)).option("path", str(out)).format("parquet").trigger(processingTime="200 milliseconds").start()
    read = lambda: rows.sparkSession.read.schema(schema).parquet(str(out)).collect()
    try:
        until = time.time() + seconds
        while time.time() < until:
            time.sleep(0.5)
            if q.exception():
                raise q.exception()
            if out.exists() and done(read()):
                break
    finally:
        q.stop()
    return read()


SIGNALS, TICKS = "symbol string, bucket_epoch long, close double, signal string", "symbol string, e long, ltp double, seq long"


def market(rng, n=600):
    signals, ticks = [], []
    for symbol in "AB":
        price = 100.0
        for i in range(n):
            price = round(price + rng.choice([-3, -1, 0, 1, 3]), 2)
            ticks.append((symbol, BASE + i, price, i))
            if i % 10 == 9:
                signals.append((symbol, BASE + i - 9, price, rng.choice(["BUY", "SELL", "NONE"])))
    return signals, ticks


def test_live_paper_equals_the_batch_book(spark, tmp_path):
    """Rows arrive up to 20 seconds out of order, in micro-batches, with a restart half way."""
    rng = random.Random(21)
    signals, ticks = market(rng)
    end = [("A", BASE + 5000, 100.0, "NONE"), ("B", BASE + 5000, 100.0, "NONE")], [("A", BASE + 5000, 100.0, 9999), ("B", BASE + 5000, 100.0, 9999)]
    late = lambda rows, at: sorted(rows, key=lambda r: r[at] + rng.random() * 20)
    parts = lambda rows, n: [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]
    batches = list(zip(parts(late(signals, 1), 4), parts(late(ticks, 1), 4)))
    got = lambda: O.live_paper(stream(spark, SIGNALS, tmp_path / "s"), stream(spark, TICKS, tmp_path / "t"), 10, 6.0, 8.0, 60, "60 seconds")
    for k, (s, t) in enumerate([*batches[:2], *batches[2:], end]):
        put(spark, s, SIGNALS, tmp_path / "s", k)
        put(spark, t, TICKS, tmp_path / "t", k)
        if k in (1, 4):
            run(got(), tmp_path / "out", tmp_path / "check")
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    s, t = spark.createDataFrame(signals, SIGNALS), spark.createDataFrame(ticks, TICKS)
    key = lambda r: tuple((x is not None, x) for x in r)
    batch = [tuple(r) for r in O.paper_events(s, t.unionByName(spark.createDataFrame(end[1], TICKS)), 10, 6.0, 8.0, 60).collect()]
    assert sorted((r for r in rows if r[6] < BASE + 5000), key=key) == sorted((r for r in batch if r[6] < BASE + 5000), key=key)
    closed = sorted((r[0], r[2], r[3], r[4], r[5], r[6], r[7], r[8]) for r in rows if r[1] == "CLOSE" and r[6] < BASE + 5000)
    trades = sorted((r.symbol, r.side, r.entry_price, r.entry_epoch, r.exit_price, r.exit_epoch, r.reason, r.pnl) for r in P.paper_trades(s, t, 10, 6.0, 8.0).filter("exit_epoch IS NOT NULL").collect())
    assert closed == trades and len(trades) > 30 and {r[6] for r in trades} == {"SL", "TP", "REVERSAL"}
    prices = {(r[0], r[1]): r[2] for r in ticks}
    marks = [r for r in rows if r[1] == "MARK"]
    assert len(marks) > 3
    for symbol, _, side, entry, since, price, epoch, _, pnl, realized in marks:
        assert price == prices[symbol, epoch] and pnl == round(price - entry if side == "BUY" else entry - price, 2)
        assert realized == round(sum(r[7] for r in trades if r[0] == symbol and r[5] <= epoch), 2)


def test_marks_by_hand():
    book = O.LiveBook("A", 5.0, 5.0, 60)
    events = [(60, 0, 0, 100.0, 0, "BUY"), (61, 1, 1, 101.0, 61, None), (119, 1, 2, 102.0, 119, None), (120, 1, 3, 103.0, 120, None), (130, 1, 4, 105.0, 130, None), (200, 1, 5, 1.0, 200, None), (240, 0, 0, 50.0, 180, "SELL"), (250, 1, 6, 55.0, 250, None)]
    out = [(r[1], r[5], r[7], r[8], r[9]) for e in events for r in book.event(*e)]
    assert out == [("OPEN", 100.0, None, None, 0.0), ("MARK", 102.0, None, 2.0, 0.0), ("CLOSE", 105.0, "TP", 5.0, 5.0), ("OPEN", 50.0, None, None, 5.0), ("CLOSE", 55.0, "SL", -5.0, 0.0)]


CANDLES = "symbol string, bucket_epoch long, open double, high double, low double, close double, volume long"
PAST = CANDLES.replace("bucket_epoch", "timestamp")


def candle(k, symbol="A", price=1.0):
    return (symbol, BASE + 5 * k, price, price, price, price, 1)


def test_gaps_are_filled_whole_and_in_order_in_the_stream(spark, tmp_path):
    out, check = tmp_path / "out", tmp_path / "check"
    put(spark, [candle(k) for k in (0, 1, 5, 6)] + [candle(k, "B") for k in (0, 3)], CANDLES, tmp_path / "c", 0)
    put(spark, [candle(2, "A", 7.0), candle(2, "Z", 7.0)], PAST, tmp_path / "h", 0)
    filled = O.live_backfill(stream(spark, CANDLES, tmp_path / "c"), stream(spark, PAST, tmp_path / "h"), 5, attempts=1000, delay=600)
    given = lambda s: [((r.bucket_epoch - BASE) // 5, r.open, r.filled) for r in spark.read.parquet(str(out)).filter(F.col("symbol") == s).orderBy("bucket_epoch").collect()]
    run_until(filled, out, check, O.FILLED, lambda rows: len(rows) >= 3)
    assert given("A") == [(0, 1.0, False), (1, 1.0, False)] and given("B") == [(0, 1.0, False)] and given("Z") == []
    put(spark, [candle(k, "A", 8.0) for k in (3, 4, 9)], PAST, tmp_path / "h", 1)
    run_until(filled, out, check, O.FILLED, lambda rows: len(rows) >= 8)  # the waiting candles were kept in state
    assert given("A") == [(0, 1.0, False), (1, 1.0, False), (2, 7.0, True), (3, 8.0, True), (4, 8.0, True), (5, 1.0, False), (6, 1.0, False)]
    assert given("B") == [(0, 1.0, False)]


def test_spent_attempts_release_candles_by_a_timer(spark, tmp_path):
    put(spark, [candle(k) for k in (0, 4, 5)], CANDLES, tmp_path / "c", 0)
    put(spark, [candle(k, "A", 7.0) for k in (1, 2)], PAST, tmp_path / "h", 0)
    filled = O.live_backfill(stream(spark, CANDLES, tmp_path / "c"), stream(spark, PAST, tmp_path / "h"), 5, attempts=2, delay=0.2)
    rows = run_until(filled, tmp_path / "out", tmp_path / "check", O.FILLED, lambda rows: len(rows) >= 3)
    assert sorted(((r.bucket_epoch - BASE) // 5, r.filled) for r in rows) == [(0, False), (4, False), (5, False)]


def test_filler_rules():
    f = O.Filler("A", 5, 2)
    row = lambda k: candle(k)[1:]
    take = lambda spent=False: [((x[1] - BASE) // 5, x[7]) for x in f.given(spent)]
    f.candle(*row(0))
    f.candle(*row(3))
    assert take() == [(0, False)] and take(True) == [] and f.state()[1] == 1
    f.past(*row(1))
    f.past(*row(2))
    f.past(*row(2))
    f.candle(*row(3))
    assert take() == [(1, True), (2, True), (3, False)] and f.state()[1:] == (2, [], [])
    f.candle(*row(2))  # late
    f.candle(*row(6))
    f.candle(*row(9))
    assert take() == [] and take(True) == [] and take(True) == [(6, False)] and take(True) == [] and take(True) == [(9, False)]
    night = O.Filler("A", 5, 9)
    for e in (BASE, BASE + 86_400):
        night.candle(e, 1.0, 1.0, 1.0, 1.0, 1)
    assert len(list(night.given())) == 2


class Broken(K.CommittedSink):
    fails = 0

    def commit(self, spark, manifest):
        if self.fails and manifest["batch"] == 1:
            self.fails -= 1
            raise RuntimeError("between write and commit")
        super().commit(spark, manifest)


def test_failure_between_write_and_commit(spark, tmp_path):
    for k in range(3):
        put(spark, [candle(i) for i in range(4 * k, 4 * k + 6)] + [candle(4 * k)], CANDLES, tmp_path / "c", k)  # batches overlap, a row repeats
    sink = Broken(str(tmp_path / "out"))
    sink.fails = 1
    rows = stream(spark, CANDLES, tmp_path / "c")
    with pytest.raises(Exception, match="between write and commit"):
        run(rows, None, tmp_path / "check", sink.write)
    assert sink.read(spark).count() == 6
    run(rows, None, tmp_path / "check", sink.write)
    got = [r.bucket_epoch for r in sink.read(spark).collect()]
    assert sorted(got) == [BASE + 5 * i for i in range(14)]
    sink.write(spark.createDataFrame([candle(50)], CANDLES), 1)  # a repeated batch adds nothing
    sink.write(spark.createDataFrame([], CANDLES), 7)
    assert sink.read(spark).count() == 14 and set(sink.committed(spark)) == {0, 1, 2, 7}
    assert K.CommittedSink(str(tmp_path / "none")).read(spark) is None


def test_counters_of_micro_batches(spark, tmp_path):
    data = [[(s, BASE + i, float(i % 3), i) for i in range(n) for s in "AB"] for n in (5, 1, 9)]
    for k, rows in enumerate(data):
        put(spark, rows, TICKS, tmp_path / "t", k)
    counters = K.IntervalCounters("ticks")
    spark.streams.addListener(counters)
    try:
        run(K.observed(stream(spark, TICKS, tmp_path / "t"), "ticks", zero=F.col("ltp") == 0, a=F.col("symbol") == "A"), tmp_path / "out", tmp_path / "check")
        until = time.time() + 30
        while sum(b["rows"] for b in counters.batches) < 30 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    seen = [(b["rows"], b["zero"], b["a"]) for b in counters.batches if b["rows"]]
    assert seen == [(len(rows), sum(r[2] == 0 for r in rows), sum(r[0] == "A" for r in rows)) for rows in data]
    totals = counters.by_interval(spark, 3600).agg(F.sum("rows"), F.sum("zero")).first()
    assert tuple(totals) == (30, sum(r[2] == 0 for rows in data for r in rows))
    assert K.IntervalCounters("x").by_interval(spark, 60).count() == 0


def test_chained_candles_equal_strict_rollups(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, BASE - 7 + i, float(rng.randrange(90, 110)), i) for s in ("A", "MCX:B") for i in range(1300) if rng.random() < (0.99 if i < 700 else 0.6)]
    order = sorted(rows, key=lambda r: r[1] + rng.random() * 8)
    for k in range(3):
        put(spark, order[k * len(order) // 3 : (k + 1) * len(order) // 3], TICKS, tmp_path / "t", k)
    put(spark, [(s, BASE + 9000, 1.0, 9999) for s in ("A", "MCX:B")], TICKS, tmp_path / "t", 3)
    run(L.event_time_candles(stream(spark, TICKS, tmp_path / "t"), [5, 60, 300], "10 seconds"), tmp_path / "out", tmp_path / "check")
    names = ["symbol", "bucket_epoch", "open", "high", "low", "close", "volume"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(names).collect())
    five = C.session_ohlc(spark.createDataFrame(rows, TICKS), 5)
    want = sorted(tuple(r) for r in C.rollup(C.rollup(five, 5, 60), 60, 300).select(names).collect())
    assert got == want and len(want) >= 2
    with pytest.raises(ValueError):
        L.event_time_candles(stream(spark, TICKS, tmp_path / "t"), [5, 12])


def test_timer_closes_idle_symbols_in_a_stream(spark, tmp_path):
    """No second tick comes: the clock closes the candles."""
    put(spark, [("A", BASE, 1.0, 0), ("B", BASE + 1, 2.0, 0), ("A", BASE + 1, 3.0, 1)], TICKS, tmp_path / "t", 0)
    live = L.live_candles(stream(spark, TICKS, tmp_path / "t"), 5, drop_partial_first=False)
    rows = run_until(live, tmp_path / "out", tmp_path / "check", L.CANDLE, lambda rows: len(rows) >= 2)
    assert sorted((r.symbol, r.bucket_epoch, r.close, r.volume) for r in rows) == [("A", BASE, 3.0, 2), ("B", BASE, 2.0, 1)]
