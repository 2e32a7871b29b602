from pyspark.sql import functions as F

from marketloom.functions.timebucket import RESOLUTIONS, chunk_days, completed_end, resolution_seconds, session_bucket
from marketloom.operators import candles as C
from marketloom.sources import history as H
from marketloom.sources import ticks as S

OPEN = 1745379900  # 09:15 in India


def buckets(spark, rows, seconds):
    df = spark.createDataFrame(rows, "e long, symbol string")
    return [r[0] for r in df.orderBy("e").select(session_bucket(F.col("e"), F.col("symbol"), seconds)).collect()]


def test_buckets_are_anchored_to_the_session(spark):
    assert buckets(spark, [(OPEN + x, "NSE:A") for x in (7, 9, 10)], 5) == [OPEN + 5, OPEN + 5, OPEN + 10]
    assert buckets(spark, [(OPEN + x, "NSE:A") for x in (-3600, 0, 59, 60)], 60) == [OPEN, OPEN, OPEN, OPEN + 60]
    assert buckets(spark, [(OPEN - 900, "MCX:A"), (OPEN - 840, "MCX:A")], 60) == [OPEN - 900, OPEN - 840]


def test_resolutions():
    assert resolution_seconds(" 5s ") == 5 and RESOLUTIONS["D"] == 86400
    assert [chunk_days(x) for x in ("5S", "1", "D")] == [30, 100, 366]
    try:
        resolution_seconds("7X")
    except ValueError:
        return
    raise AssertionError


def candle_rows(spark, buckets_, symbol="A"):
    rows = [(symbol, b, 100.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1) for i, b in enumerate(buckets_)]
    return spark.createDataFrame(rows, "symbol string, bucket_epoch long, open double, high double, low double, close double, volume long")


def test_rollup_needs_every_source_bucket(spark):
    five = [OPEN + 60 * i for i in range(6)]
    out = C.rollup(candle_rows(spark, five), 60, 300).collect()
    assert [(r.bucket_epoch, r.open, r.high, r.low, r.close, r.volume) for r in out] == [(OPEN, 100.0, 105.0, 99.0, 104.0, 5)]
    assert C.rollup(candle_rows(spark, [b for b in five if b != OPEN + 60]), 60, 300).count() == 0
    assert C.rollup(candle_rows(spark, [*five, OPEN]), 60, 300).count() == 1  # a repeated bucket counts once


def test_minutes_of_twelve_buckets(spark):
    full = candle_rows(spark, [OPEN + 5 * i for i in range(12)])
    (row,) = C.minute_from_5s(full).collect()
    assert (row.bucket_epoch, row.open, row.close, row.volume) == (OPEN, 100.0, 111.0, 0)
    assert C.minute_from_5s(full.filter(F.col("bucket_epoch") != OPEN + 5)).count() == 0
    assert C.repaired_minutes(full, C.minute_from_5s(full), OPEN, OPEN + 60).count() == 0


def test_gaps_and_prefix(spark):
    df = candle_rows(spark, [OPEN, OPEN + 60, OPEN + 240])
    assert [tuple(r) for r in C.gaps(df, 60).collect()] == [("A", OPEN + 120, OPEN + 180, 2)]
    assert [r.bucket_epoch for r in C.missing_buckets(df, 60).orderBy("bucket_epoch").collect()] == [OPEN + 120, OPEN + 180]
    assert sorted(r.bucket_epoch for r in C.contiguous_prefix(df, 60).collect()) == [OPEN, OPEN + 60]
    assert [r.bucket_epoch for r in C.contiguous_prefix(df, 60, most=1).collect()] == [OPEN + 60]


def test_partial_first(spark):
    t = spark.createDataFrame([("A", OPEN + 2, 1.0, 1), ("A", OPEN + 61, 2.0, 2), ("B", OPEN, 1.0, 1)], "symbol string, e long, ltp double, seq long")
    out = C.without_partial_first(C.session_ohlc(t, 60), t)
    assert sorted((r.symbol, r.bucket_epoch) for r in out.collect()) == [("A", OPEN + 60), ("B", OPEN)]


def test_tick_parsing_and_validity(spark):
    rows = [(1, '{"symbol":"A","ltp":2.5,"exch_feed_time":5}'), (2, '{"symbol":" ","ltp":1,"exch_feed_time":5}'), (3, '{"symbol":"A","ltp":0,"exch_feed_time":5}'), (4, '{"symbol":"A"}'), (5, "junk"), (6, None)]
    t = S.parse(spark.createDataFrame(rows, "seq long, value string"))
    assert t.count() == 6 and t.filter("ltp IS NULL OR symbol IS NULL").count() == 0
    assert [r.seq for r in t.filter(S.valid(F.col("symbol"), F.col("exch_feed_time"), F.col("ltp"))).collect()] == [1]


def test_keep_last_upsert_and_files(spark, tmp_path):
    df = candle_rows(spark, [OPEN, OPEN + 60])
    assert [r.close for r in H.upsert(df, df.filter(F.col("bucket_epoch") == OPEN).withColumn("close", F.lit(7.0)), ["symbol", "bucket_epoch"]).orderBy("bucket_epoch").collect()] == [7.0, 101.0]
    H.append_candles(df, str(tmp_path / "c"), 60)
    H.append_candles(df, str(tmp_path / "c"), 60)
    back = H.read_candles(spark, str(tmp_path / "c"), "A").orderBy("bucket_epoch").collect()
    assert [(r.bucket_epoch, r.ist_time) for r in back] == [(OPEN, "2025-04-23 09:15:00"), (OPEN + 60, "2025-04-23 09:16:00")]
    H.save_history(df.withColumn("kind", F.lit("spot")), str(tmp_path / "h"))
    assert H.load_history(spark, str(tmp_path / "h"), "spot", "A").count() == 2


def test_history_responses(spark):
    rows = [("A", '{"s":"ok","candles":[[60,1,2,0.5,1.5,10],[120,1,2,0.5,1.5,10]]}'), ("B", '{"s":"error"}'), ("C", "junk")]
    df = spark.createDataFrame(rows, "symbol string, value string")
    assert [(r.symbol, r.timestamp, r.volume) for r in H.parse_response(df, "value", "symbol", 60, 150).collect()] == [("A", 60, 10)]
    chunks = H.range_chunks(spark.createDataFrame([("A", 0, 31 * 86400), ("B", 5, 4)], "symbol string, lo long, hi long"), "5S").collect()
    assert [tuple(r) for r in chunks] == [("A", 0, 30 * 86400 - 1), ("A", 30 * 86400, 31 * 86400)]


def test_messages_are_packed(spark):
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(["aaaa", "bbbb", "cc", "d" * 30])], "k string, i int, l string")
    assert [r.text for r in H.pack_lines(df, "k", "i", "l", 10).orderBy("message").collect()] == ["aaaa\nbbbb", "cc", "d" * 10]


def test_completed_end(spark):
    df = spark.createDataFrame([(OPEN + 30,), (OPEN + 130,), (OPEN + 90000 - 3600,)], "now long")
    out = [r[0] for r in df.select(completed_end(F.col("now"), F.lit("A"), 60)).collect()]
    assert out[0] == OPEN - 1 and out[1] == OPEN + 119


def test_backfill_is_all_or_nothing(spark):
    df = candle_rows(spark, [OPEN, OPEN + 180, OPEN + 300])
    history = spark.createDataFrame([("A", OPEN + x, 1.0, 2.0, 0.5, 1.5, 9) for x in (60, 240, 240, 0)], "symbol string, timestamp long, open double, high double, low double, close double, volume int")
    out = {(r.bucket_epoch - OPEN, r.filled) for r in C.backfilled(df, history, 60).collect()}
    assert out == {(0, False), (180, False), (300, False), (240, True)}  # the first gap lacks a bucket
    assert C.backfilled(df, history.filter("timestamp < 0"), 60).count() == 3


def test_counters_and_outages(spark):
    df, watch = C.counted(candle_rows(spark, [OPEN, OPEN + 60]), "interval", late=F.col("bucket_epoch") > OPEN)
    assert df.count() == 2 and watch.get == {"rows": 2, "late": 1}
    t = spark.createDataFrame([("A", OPEN, 1.0, 1), ("A", OPEN + 61, 2.0, 2), ("B", OPEN, 1.0, 1)], "symbol string, e long, ltp double, seq long")
    o = spark.createDataFrame([("A", "subscription_down", OPEN + 60, OPEN + 70), (None, "stream_down", OPEN + 5, OPEN + 6)], "symbol string, reason string, from_epoch long, to_epoch long")
    out = {(r.symbol, r.bucket_epoch - OPEN): r.partial_reason for r in C.quality_flags(t, 60, session_bucket(F.col("e"), F.col("symbol"), 60), outages=o).collect()}
    assert out == {("A", 0): "stream_down", ("A", 60): "subscription_down", ("B", 0): "stream_down"}


def test_upsert_takes_the_last_arrival(spark):
    df = candle_rows(spark, [OPEN])
    new = spark.createDataFrame([("A", OPEN, float(i)) for i in range(5)], "symbol string, bucket_epoch long, close double").coalesce(1)
    assert [r.close for r in H.upsert(df.select("symbol", "bucket_epoch", "close"), new, ["symbol", "bucket_epoch"]).collect()] == [4.0]
    assert H.catch_up_ranges(candle_rows(spark, [OPEN]).unionByName(candle_rows(spark, [OPEN + 60], "B")), 60).collect() == [("A", OPEN + 60, OPEN + 60)]
