"""History by ranges with pushed filters, order books, and candle files appended many times."""

import json

from pyspark.sql import functions as F

from marketloom.sources import history as H
from marketloom.sources import history_source as S

DAY = 86_400
START = 1_700_000_000


def recorded(tmp_path, symbols=("NSE:A", "NSE:B"), days=75):
    end, opened = START + days * DAY, {}
    for s in symbols:
        for k, (lo, hi) in enumerate(S.ranges(START, end, "5S")):
            rows = [[t, 1.0, 2.0, 0.5, 1.5, 7] for t in range(lo, hi + 1, DAY)]
            said = {"s": "ok", "candles": rows} if (s, k) != ("NSE:B", 1) else {"s": "error", "message": "no"}
            f = tmp_path / S.response_name(s, "5S", lo, hi)
            f.write_text(json.dumps(said))
            opened[s, k] = f
    return end, opened


def test_ranges():
    assert S.ranges(0, -1, "5S") == [] and S.ranges(5, 5, "5S") == [(5, 5)]
    assert S.ranges(0, 61 * DAY, "5S") == [(0, 30 * DAY - 1), (30 * DAY, 60 * DAY - 1), (60 * DAY, 61 * DAY)]


def test_filters_reach_the_source_and_other_ranges_stay_closed(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(S.HistorySource)
    end, files = recorded(tmp_path)
    df = spark.read.format("history").options(path=str(tmp_path), symbols="NSE:A, NSE:B,NSE:A,NSE:C", resolution="5S", start=START, end=end).load()
    want = {(s, t) for s in ("NSE:A", "NSE:B") for k, (lo, hi) in enumerate(S.ranges(START, end, "5S")) for t in range(lo, hi + 1, DAY) if (s, k) != ("NSE:B", 1)}
    assert {(r.symbol, r.timestamp) for r in df.collect()} == want and df.count() == len(want)
    for f in ("NSE:A", 0), ("NSE:B", 0), ("NSE:B", 1), ("NSE:B", 2):
        files[f].write_text(json.dumps({"s": "ok", "candles": [["opened"] * 6]}))  # reading it fails
    part = df.filter((F.col("symbol") == "NSE:A") & (F.col("timestamp") >= START + 40 * DAY) & (F.col("timestamp") < START + 70 * DAY) & (F.col("volume") > 1))
    assert {(r.symbol, r.timestamp) for r in part.collect()} == {x for x in want if x[0] == "NSE:A" and START + 40 * DAY <= x[1] < START + 70 * DAY}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "volume" in plan.split("Filter", 1)[1].split("BatchScan")[0] and "NSE:A" not in plan.split("BatchScan")[0]
    assert df.filter(F.col("symbol").isin("NSE:C")).count() == 0 and df.filter("timestamp = 5").count() == 0


def book_of(spark, **d):
    return H.depth(spark.createDataFrame([(json.dumps({"s": "ok", "d": d}),), (json.dumps({"s": "error"}),), ("{",), (None,)], "value string"))


def test_order_books(spark):
    level = lambda price, volume: {"price": price, "volume": volume, "ord": 1}
    book = book_of(spark, A={"bids": [level(10.0, 5), level(9.0, 6)], "ask": [level(11.0, 4), level(12.0, 0), level(13.0, 9)]}, B={"bids": [], "ask": []}, C={"bids": [level(1.0, 2)]})
    rows = {(r.symbol, r.level): r for r in book.collect()}
    assert set(rows) == {("A", 0), ("A", 1), ("A", 2), ("C", 0)} or set(rows) == {("A", 0), ("A", 1), ("A", 2)}
    assert (rows["A", 0].spread, rows["A", 1].bid_upto, rows["A", 2].ask_upto, rows["A", 2].bid) == (1.0, 11, 13, None)
    buy, sell = ({r.symbol: (r.filled, r.mean_price, r.worst) for r in H.price_for(book, 10, s).collect()} for s in ("BUY", "SELL"))
    assert buy["A"] == (10, (4 * 11 + 6 * 13) / 10, 13.0) and sell["A"] == (10, (50 + 45) / 10, 9.0)
    assert H.price_for(book, 100).filter("symbol = 'A'").first().filled == 13


def test_index_spots(spark):
    q = spark.createDataFrame([("NSE:NIFTY50-INDEX", 1.0, 2.0), ("X", 5.0, 6.0), ("BSE:SENSEX-INDEX", None, 4.0)], "symbol string, open_price double, current_price double")
    names = {"NSE:NIFTY50-INDEX": "NIFTY", "BSE:SENSEX-INDEX": "SENSEX"}
    assert sorted(map(tuple, H.index_spots(q, names).collect())) == [("NIFTY", 1.0, 2.0), ("SENSEX", 0.0, 4.0)]


def test_the_last_append_wins(spark, tmp_path):
    path = str(tmp_path / "c")
    assert H.read_candles(spark, path).count() == 0
    for k in range(10):
        H.append_candles(spark.createDataFrame([("A", b, float(k), 9.0, 0.0, float(k)) for b in (60, 120)], "symbol string, bucket_epoch long, open double, high double, low double, close double"), path, 60)
        assert {(r.bucket_epoch, r.close) for r in H.read_candles(spark, path, "A").collect()} == {(60, float(k)), (120, float(k))}


def test_upsert_by_an_order_column(spark):
    rows = [("A", 1, float(k), k) for k in range(50)]
    df = spark.createDataFrame(rows, "symbol string, bucket_epoch long, close double, n long")
    assert [r.close for r in H.upsert(df, df.filter("n < 30").repartition(7), ["symbol", "bucket_epoch"], "n").collect()] == [29.0]


def test_deep_books_are_summed_in_one_pass(spark):
    volumes = [(7 * i) % 31 for i in range(3000)]
    side = lambda n: [{"price": 100.0 + i, "volume": volumes[i], "ord": i} for i in range(n)]
    # A symbol that stands in two responses has two books.
    value = [(json.dumps({"s": "ok", "d": {"a": {"bids": side(3000), "ask": side(1000)}}}),), (json.dumps({"s": "ok", "d": {"a": {"bids": side(2), "ask": []}}}),)]
    df = H.depth(spark.createDataFrame(value, "value string"))
    sums = [sum(volumes[: i + 1]) for i in range(3000)]
    want = [(i, sums[i], sums[i] if i < 1000 else None) for i in range(3000)] + [(i, sums[i], None) for i in range(2)]
    key = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.level, r.bid_upto, r.ask_upto) for r in df.collect()), key=key) == sorted(want, key=key)
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_prices_of_deep_books(spark):
    levels = [{"price": 10.0 + i, "volume": 2, "ord": 1} for i in range(2000)]
    df = H.price_for(H.depth(spark.createDataFrame([(json.dumps({"s": "ok", "d": {"a": {"bids": [], "ask": levels}}}),)], "value string")), 3001)
    assert "slice(" not in df._jdf.queryExecution().optimizedPlan().toString()
    (r,) = df.collect()
    assert (r.symbol, r.filled, r.worst) == ("a", 3001, 10.0 + 1500) and abs(r.mean_price - (2 * sum(10.0 + i for i in range(1500)) + 1510.0) / 3001) < 1e-9
