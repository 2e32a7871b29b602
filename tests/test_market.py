import random
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.operators import instruments as I
from marketloom.operators import paper as P
from marketloom.operators.pnf import cells as K
from marketloom.operators.pnf.columns import FrozenChart, PnfRules, columns
from marketloom.streaming import candle_stream as L


def test_integer_boxes_equal_decimal_ones():
    rng = random.Random(1)
    for _ in range(3000):
        size = rng.choice([0.25, 0.5, 1.0, 1.5, 3.0])
        ref, price = rng.randint(100, 10**7), rng.randint(100, 10**7)
        part = Decimal(str(size / 100))
        r, p = Decimal(ref) / 100, Decimal(price) / 100
        n = int((abs(p - r) / (r * part)).to_integral_value(ROUND_FLOOR))
        steps = FrozenChart("c", PnfRules(boxsize=size))
        assert abs(steps.count(price, ref)) == n
        if n:
            sign = 1 if price > ref else -1
            first = ((r + sign * r * part) * 100).to_integral_value(ROUND_HALF_UP)
            assert steps.boxes(ref, sign * min(n, 3))[0] == first


def chart(spark, closes, **rules):
    bars = spark.createDataFrame([("c", i, float(p)) for i, p in enumerate(closes)], "chart_id string, seq long, close double")
    return columns(bars, PnfRules(**rules))


def test_columns_turn_at_three_boxes(spark):
    rows = chart(spark, [100, 103, 105, 103.5, 101, 110], boxsize=1.0, scaling="abs").orderBy("column_index").collect()
    assert [r.trend for r in rows] == [1, -1, 1]
    assert rows[0].boxes == [100.0, 101.0, 102.0, 103.0, 104.0, 105.0]
    assert rows[1].boxes == [104.0, 103.0, 102.0, 101.0]
    rows = chart(spark, [100, 102, 103.5, 99]).orderBy("column_index").collect()
    assert [(r.trend, r.boxes) for r in rows] == [(1, [101.0, 102.0, 103.0]), (-1, [101.97, 100.94, 99.91])]
    assert chart(spark, [100, 100.5]).count() == 0
    with pytest.raises(ValueError):
        PnfRules(method="x")
    with pytest.raises(ValueError):
        columns(spark.createDataFrame([("c", 1)], "chart_id string, seq long"))


def test_triple_top(spark):
    prices = [100, 105, 101, 105, 101, 106]
    c = K.cells(chart(spark, prices, boxsize=1.0, scaling="abs"))
    marks = [(r.trend, r.hits, r.width) for r in K.breakouts(c).filter("trend = 1").orderBy("column_index", F.desc("hits")).collect()]
    assert (1, 3, 5) in marks and (1, 2, 3) in marks
    found = K.signals(K.column_stats(c), K.breakouts(c)).orderBy("column_index").collect()
    assert found[-1].label == "Triple Top Breakout"
    assert "X" in K.render(c).first().text or "O" in K.render(c).first().text


def test_signals_trades_and_levels(spark):
    rows = [("A", 60 * i, o, h, l, c, 1) for i, (o, h, l, c) in enumerate([(1, 2, 1, 2), (2, 5, 2, 4), (4, 6, 3, 5), (5, 5, 0, 1)])]
    s = P.breakout_signal(spark.createDataFrame([(a, b, *map(float, x), v) for a, b, *x, v in rows], "symbol string, bucket_epoch long, open double, high double, low double, close double, volume long"))
    assert [r.signal for r in s.orderBy("bucket_epoch").collect()] == ["NONE", "BUY", "NONE", "SELL"]
    t = P.reversal_trades(s)
    assert [(r.side, r.entry_price, r.exit_price, r.pnl) for r in t.orderBy("entry_epoch").collect()] == [("BUY", 4.0, 1.0, -3.0), ("SELL", 1.0, None, None)]
    ticks = spark.createDataFrame([("A", 70, 30.0, 1), ("A", 200, 12.0, 2)], "symbol string, e long, ltp double, seq long")
    out = P.paper_trades(s, ticks).orderBy("entry_epoch").collect()
    assert [(r.reason, r.exit_epoch, r.pnl) for r in out] == [("TP", 70, 26.0), ("SL", 200, -11.0)]


def book(spark, signals, ticks, seconds=0):
    s = spark.createDataFrame([("A", e, float(c), x) for e, c, x in signals], "symbol string, bucket_epoch long, close double, signal string")
    t = spark.createDataFrame([("A", e, float(p), i) for i, (e, p) in enumerate(ticks)], "symbol string, e long, ltp double, seq long")
    return [(r.side, r.entry_price, r.entry_epoch, r.exit_price, r.exit_epoch, r.reason, r.pnl) for r in P.paper_trades(s, t, seconds).orderBy("entry_epoch").collect()]


def test_paper_trades_by_hand(spark):
    # The target ends the trade; the same signal then opens a new one, and is ignored while that is open.
    assert book(spark, [(60, 100, "BUY"), (120, 110, "BUY"), (180, 111, "BUY"), (240, 112, "BUY")], [(70, 105), (100, 120), (101, 50)]) == [
        ("BUY", 100.0, 60, 120.0, 100, "TP", 20.0), ("BUY", 110.0, 120, None, None, "OPEN", None),
    ]
    # A stop, a tick without position, a turn at the close, and levels of the other side.
    assert book(spark, [(60, 100, "SELL"), (120, 95, "BUY"), (180, 90, "SELL"), (240, 91, "NONE")], [(61, 110), (62, 500), (130, 100), (190, 70), (200, 1)]) == [
        ("SELL", 100.0, 60, 110.0, 61, "SL", -10.0), ("BUY", 95.0, 120, 90.0, 180, "REVERSAL", -5.0), ("SELL", 90.0, 180, 70.0, 190, "TP", 20.0),
    ]
    # A candle acts at its end: ticks before it don't see its position, and at the end itself it comes first. A level of 0 is none.
    assert book(spark, [(60, 100, "BUY")], [(61, 200), (119, 1), (120, 90)], 60) == [("BUY", 100.0, 60, 90.0, 120, "SL", -10.0)]
    assert book(spark, [(60, 10, "BUY")], [(61, 0), (62, -5), (63, 30)]) == [("BUY", 10.0, 60, 30.0, 63, "TP", 20.0)]
    assert book(spark, [], [(1, 1)]) == [] and book(spark, [(1, 5, "SELL")], []) == [("SELL", 5.0, 1, None, None, "OPEN", None)]


def test_instruments(spark):
    head = ["tok", "Name", "short", "12.9", "x", "isin", "s", "u", "1745000000", "NSE:A-EQ", "10", "10", "1", "2", "A", "100.5", "CE", "15"]
    rows = [tuple([*head]), tuple([*head[:9], "NSE:B-INDEX", *head[10:]]), tuple([*head[:9], " ", *head[10:]]), tuple([*head[:17], None])]
    df = spark.createDataFrame(rows, ", ".join(f"_c{i} string" for i in range(18)))
    assert sorted((r.kind, r.symbol, r.lot_size, r.tick_size) for r in I.parse_master(df, "CM").collect()) == [("equity", "NSE:A-EQ", 12, 0.0), ("index_spot", "NSE:B-INDEX", 12, 0.0)]
    o = I.parse_master(df, "FO")
    assert {r.kind for r in o.collect()} == {"option"} and o.first().strike == 100.5
    with pytest.raises(ValueError):
        I.parse_master(df, "XX")
    assert I.search(o, "").count() == 0 and I.search(o, "b-ind").count() == 1


def test_atm_tie_is_the_lower_strike(spark):
    o = spark.createDataFrame([("U", 1, float(k), t, f"{k}{t}") for k in (100, 110, 120) for t in ("CE", "PE")], "underlying_symbol string, expiry_epoch long, strike double, option_type string, symbol string")
    s = spark.createDataFrame([("U", 105.0)], "underlying_symbol string, spot double")
    assert I.atm(o, s).first().atm_strike == 100.0
    assert [r.symbol for r in I.near_money(o, s, "CE", "OTM", 1).collect()] == ["110CE"]
    assert I.atm_pair(o, s).first().pe_symbol == "100PE"


def test_stream_equals_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = 1745379900
    rows = [("A", base + x, 100.0 + i, i) for i, x in enumerate([0, 2, 4, 5, 3, 6, 10, 11, 12, 25, 26, 31, 33])] + [("B", base + x, 10.0, i) for i, x in enumerate([3, 7, 11, 12, 16, 17])]
    ticks = spark.createDataFrame(rows, "symbol string, e long, ltp double, seq long")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    expected = {(r.symbol, r.bucket_epoch, r.open, r.high, r.low, r.close, r.volume, r.gap_from) for r in L.replay(ticks, 5).collect()}
    assert ("A", base, 100.0, 104.0, 100.0, 104.0, 4, None) in expected and all(x[:2] != ("B", base) for x in expected)
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = L.live_candles(stream, 5, timers=False).writeStream.foreachBatch(L.write_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("day").collect()}
    assert got == expected


def test_seeded_stream_and_rollup(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = 1745379900
    rows = [("A", base + x, 100.0 + i, i) for i, x in enumerate([0, 5, 10, 11, 16, 20, 21, 25, 30, 31, 36, 40, 41])] + [("B", base + x, 5.0, i) for i, x in enumerate([0, 5, 6, 11])]
    ticks = spark.createDataFrame(rows, "symbol string, e long, ltp double, seq long")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    seed = spark.createDataFrame([("A", base + 5), ("A", base), ("C", base)], "symbol string, bucket_epoch long")
    expected = {tuple(r) for r in L.replay(ticks, 5, seed=seed).collect()}
    assert {r[1] - base for r in expected if r[0] == "A"} == {10, 15, 20, 25, 30} and {r[1] - base for r in expected if r[0] == "B"} == {0}
    late = [r for r in L.replay(ticks.filter("e >= 1745379920"), 5, seed=seed).collect() if r.symbol == "A"]
    assert min(late, key=lambda r: r.bucket_epoch).gap_from == base + 10
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = L.live_candles(stream, 5, timers=False, seed=seed).writeStream.foreachBatch(L.write_once(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).drop("day")
    assert {tuple(r) for r in out.collect()} == expected
    closed = spark.readStream.schema(out.schema).parquet(str(tmp_path / "out"))
    q = L.live_rollup(closed.drop("gap_from", "day"), 5, 10).writeStream.format("parquet").option("path", str(tmp_path / "roll")).option("checkpointLocation", str(tmp_path / "ckpt2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rolled = {(r.symbol, r.bucket_epoch - base, r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "roll")).collect()}
    by = {(r[0], r[1] - base): r for r in expected}
    assert rolled == {("A", k, by["A", k][2], max(by["A", k][3], by["A", k + 5][3]), min(by["A", k][4], by["A", k + 5][4]), by["A", k + 5][5], by["A", k][6] + by["A", k + 5][6]) for k in (10, 20)}


def test_roller_needs_all_source_buckets():
    r, base = L.Roller("A", 5, 15), 1745379900
    out = [x for k in (0, 5, 10, 15, 25, 30, 35, 35, 40, 50, 55) for x in r.candle(base + k, 1.0, 2.0 + k, 0.5, 1.5, 1)]
    assert [(x[1] - base, x[3], x[6]) for x in out] == [(0, 12.0, 3), (30, 42.0, 3)]


def test_timer_closes_idle_symbols():
    m = L.Machine("A", 5)
    assert list(m.tick(1745379900, 1.0)) == [] and m.next_due(1) == 1745379906
    assert [x[1] for x in m.due(1745379906, 1)] == [1745379900] and m.next_due(1) is None


def test_expansion_broadcasts_no_ladders(spark):
    q = spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"), F.lit(50).alias("step"), (F.col("id") * 10.0).alias("open_price"), (F.col("id") * 10.0 + F.when(F.col("id") % 3 == 0, 700).otherwise(10)).alias("current_price"))
    ladder = I.strike_ladder(q.withColumn("current_price", F.col("open_price")), 5)
    df = I.expansion(ladder, q, 5)
    floor = lambda x: int(x // 50 * 50)
    want = sorted((f"n{i}", k) for i in range(0, 300, 3) for k in range(floor(i * 10 + 700) - 250, floor(i * 10 + 700) + 251, 50) if not floor(i * 10) - 250 <= k <= floor(i * 10) + 250)
    assert sorted(map(tuple, df.collect())) == want
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
