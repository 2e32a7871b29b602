"""The market-data queries over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.functions import timebucket as B
from marketloom.functions.folds import once
from marketloom.operators import candles as C
from marketloom.operators import instruments as I
from marketloom.operators import paper as P
from marketloom.operators.pnf import cells as K
from marketloom.operators.pnf.columns import PnfRules, columns, mean_true_range
from marketloom.sources import history as H
from marketloom.sources import ticks as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = 1_705_000_000

# SQL that several oracles begin with.
TICKS = """WITH raw AS (SELECT event_type AS symbol, user_id::VARCHAR AS user_id, floor(epoch(ts))::BIGINT AS e, value AS ltp, event_id AS seq FROM events),
t AS (SELECT * FROM raw WHERE trim(symbol) <> '' AND e > 0 AND ltp > 0)"""


def bucket_sql(e: str, seconds: int) -> str:
    anchor = f"({e} + 19800 - ({e} + 19800) % 86400 + 33300 - 19800)"
    return f"({anchor} + (greatest({e} - {anchor}, 0) // {seconds}) * {seconds})"


OHLC = "min_by(ltp, seq) AS open, max(ltp) AS high, min(ltp) AS low, max_by(ltp, seq) AS close, count(*) AS volume"
HOURS = f"{TICKS}, c AS (SELECT symbol, {bucket_sql('e', 3600)} AS bucket_epoch, {OHLC} FROM t GROUP BY 1, 2)"
#: Quarter hours of single users have many gaps.
USERS = f"{TICKS}, c AS (SELECT user_id AS symbol, {bucket_sql('e', 900)} AS bucket_epoch, {OHLC} FROM t GROUP BY 1, 2)"
FIELDS = "symbol, bucket_epoch, open, high, low, close, volume"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def hours(spark: SparkSession, d: str) -> DataFrame:
    return C.session_ohlc(S.from_events(spark, d), 3600)


def users(spark: SparkSession, d: str) -> DataFrame:
    return C.session_ohlc(S.from_events(spark, d, "user_id"), 900)


@query(f"{TICKS} SELECT symbol, e, ltp, seq FROM t")
def tick_validity(spark, d):
    return S.from_events(spark, d)


@query(f"{HOURS} SELECT {FIELDS} FROM c")
def ohlc_session_1h(spark, d):
    return hours(spark, d)


@query(f"{TICKS} SELECT symbol, {bucket_sql('e', 86400)} AS bucket_epoch, {OHLC} FROM t GROUP BY 1, 2")
def ohlc_session_1d(spark, d):
    return C.session_ohlc(S.from_events(spark, d), 86_400)


@query(f"{TICKS} SELECT symbol, e - e % 3600 AS bucket_epoch, {OHLC} FROM t GROUP BY 1, 2")
def ohlc_plain_bucket(spark, d):
    return C.ohlc(S.from_events(spark, d), B.plain_bucket(F.col("e"), 3600))


@query(f"{TICKS} SELECT symbol, {bucket_sql('e', 3600)} AS bucket_epoch, {OHLC} FROM t WHERE (e + 19800) % 86400 BETWEEN 33300 AND 55800 GROUP BY 1, 2")
def ohlc_market_hours(spark, d):
    return C.session_ohlc(S.from_events(spark, d).filter(B.market_hours(F.col("e"))), 3600)


@query(f"{TICKS} SELECT symbol, {bucket_sql('e', 3600)} AS bucket_epoch, {OHLC} FROM t WHERE e % 86400 BETWEEN 33300 AND 55800 GROUP BY 1, 2")
def ohlc_market_hours_utc(spark, d):
    return C.session_ohlc(S.from_events(spark, d).filter(B.market_hours(F.col("e"), utc=True)), 3600)


@query(f"{HOURS}, f AS (SELECT symbol, min_by(e, seq) AS first FROM t GROUP BY 1), m AS (SELECT *, min(bucket_epoch) OVER (PARTITION BY symbol) AS least FROM c) SELECT {FIELDS} FROM m JOIN f USING (symbol) WHERE bucket_epoch <> least OR first <= bucket_epoch")
def ohlc_partial_drop(spark, d):
    return C.without_partial_first(hours(spark, d), S.from_events(spark, d))


ROLL = f"{HOURS}, r AS (SELECT symbol, {bucket_sql('bucket_epoch', 10800)} AS b, min_by(open, bucket_epoch) AS open, max(high) AS high, min(low) AS low, max_by(close, bucket_epoch) AS close, sum(volume)::BIGINT AS volume, count(DISTINCT bucket_epoch) AS n FROM c GROUP BY 1, 2) SELECT symbol, b AS bucket_epoch, open, high, low, close, volume FROM r"


@query(f"{ROLL} WHERE n = 3")
def rollup_strict(spark, d):
    return C.rollup(hours(spark, d), 3600, 10_800)


@query(ROLL)
def rollup_lenient(spark, d):
    return C.rollup(hours(spark, d), 3600, 10_800, strict=False)


MIN5 = f"{TICKS}, f AS (SELECT symbol, e - e % 86400 + (seq % 12) * 5 AS bucket_epoch, min_by(ltp, seq) AS open, max(ltp) AS high, min(ltp) AS low, max_by(ltp, seq) AS close FROM t GROUP BY 1, 2), m AS (SELECT symbol, bucket_epoch - bucket_epoch % 60 AS b, min_by(open, bucket_epoch) AS open, max(high) AS high, min(low) AS low, max_by(close, bucket_epoch) AS close, count(DISTINCT bucket_epoch) AS n FROM f GROUP BY 1, 2 HAVING n = 12)"


def five(spark, d):
    return C.ohlc(S.from_events(spark, d), B.plain_bucket(F.col("e"), 86_400) + F.pmod("seq", F.lit(12)) * 5)


@query(f"{MIN5} SELECT symbol, b AS bucket_epoch, open, high, low, close, 0 AS volume FROM m")
def minute_from_5s(spark, d):
    return C.minute_from_5s(five(spark, d))


@query(f"{MIN5} SELECT symbol, b AS bucket_epoch, open, high, low, close, 0 AS volume FROM m WHERE b BETWEEN 1704500000 AND 1705500000 AND b % 172800 <> 0")
def repair_minutes(spark, d):
    return C.repaired_minutes(five(spark, d), C.minute_from_5s(five(spark, d)).filter("bucket_epoch % 172800 = 0"), 1_704_500_000, 1_705_500_000)


GAPS = f"{USERS}, p AS (SELECT symbol, bucket_epoch AS b, lag(bucket_epoch) OVER (PARTITION BY symbol ORDER BY bucket_epoch) AS p FROM c), g AS (SELECT symbol, p + 900 AS gap_from, b - 900 AS gap_to, (b - p) // 900 - 1 AS missing FROM p WHERE b - p > 900 AND (b + 19800) // 86400 = (p + 19800) // 86400)"


@query(f"{GAPS} SELECT * FROM g")
def gap_ranges(spark, d):
    return C.gaps(users(spark, d), 900)


@query(f"{GAPS} SELECT symbol, unnest(range(gap_from, gap_to + 1, 900)) AS bucket_epoch FROM g")
def missing_buckets(spark, d):
    return C.missing_buckets(users(spark, d), 900)


@query(f"{USERS}, x AS (SELECT symbol, unnest(range(1704171600, 1704193201, 900)) AS bucket_epoch FROM (SELECT DISTINCT symbol FROM c)) SELECT * FROM x ANTI JOIN c USING (symbol, bucket_epoch)")
def expected_missing(spark, d):
    u = users(spark, d)
    return C.expected_missing(u, u.select("symbol").distinct(), 1_704_171_600, 1_704_193_200, 900)


@query(f"{HOURS}, b AS (SELECT *, coalesce((bucket_epoch - lag(bucket_epoch) OVER (PARTITION BY symbol ORDER BY bucket_epoch) <> 3600)::INT, 0) AS x FROM c), s AS (SELECT *, sum(x) OVER (PARTITION BY symbol ORDER BY bucket_epoch) AS y FROM b) SELECT {FIELDS} FROM s WHERE y = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket_epoch DESC) <= 500")
def contiguous_prefix(spark, d):
    return C.contiguous_prefix(hours(spark, d), 3600)


@query(f"{HOURS} SELECT {FIELDS} FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bucket_epoch DESC) <= 180")
def tail_n(spark, d):
    return H.tail(hours(spark, d), 180)


@query(f"{HOURS} SELECT symbol, bucket_epoch, 3600 AS timeframe_seconds, open, high, low, close, 0 AS volume, true AS is_complete FROM c")
def closed_candles(spark, d):
    return C.closed(H.candle_rows(hours(spark, d), 3600), 3600)


#: The history has six of seven missing quarter hours, so that some gaps can be closed as a whole.
@query(f"{GAPS}, h AS (SELECT symbol, gap_from, missing, unnest(range(gap_from, gap_to + 1, 900)) AS bucket_epoch FROM g), k AS (SELECT *, count(*) OVER (PARTITION BY symbol, gap_from) AS n FROM h WHERE bucket_epoch // 900 % 7 <> 0) SELECT {FIELDS}, false AS filled FROM c UNION ALL SELECT symbol, bucket_epoch, 1.0::DOUBLE, 3.0::DOUBLE, 0.5::DOUBLE, 2.0::DOUBLE, 4, true FROM k WHERE n = missing")
def gap_backfill(spark, d):
    u = users(spark, d)
    price = {"open": 1.0, "high": 3.0, "low": 0.5, "close": 2.0}
    history = C.missing_buckets(u, 900).filter("floor(bucket_epoch / 900) % 7 <> 0").select("symbol", F.col("bucket_epoch").alias("timestamp"), *[F.lit(v).alias(k) for k, v in price.items()], F.lit(4).cast("bigint").alias("volume"))
    return C.backfilled(u, history, 900)


@query(f"{USERS} SELECT symbol, max(bucket_epoch) AS last_bucket, count(*) AS n FROM c GROUP BY 1")
def last_bucket(spark, d):
    return C.last_bucket(users(spark, d))


@query(f"{TICKS} SELECT symbol, user_id, ltp, seq FROM t QUALIFY row_number() OVER (PARTITION BY symbol, user_id ORDER BY seq DESC) = 1")
def keep_last(spark, d):
    t = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("user_id").cast("string").alias("user_id"), F.col("value").alias("ltp"), F.col("event_id").alias("seq"))
    return H.keep_last(t.filter("ltp > 0"), ["symbol", "user_id"], "seq")


@query(f"{HOURS} SELECT symbol, bucket_epoch, CASE WHEN bucket_epoch % 7200 = 5400 THEN close + 1 ELSE close END AS close FROM c")
def upsert_keep_last(spark, d):
    h = hours(spark, d).select("symbol", "bucket_epoch", "close")
    return H.upsert(h, h.filter("bucket_epoch % 7200 = 5400").withColumn("close", F.col("close") + 1), ["symbol", "bucket_epoch"])


@query(f"{HOURS} SELECT {FIELDS} FROM c WHERE bucket_epoch % 7200 <> 5400")
def anti_existing(spark, d):
    h = hours(spark, d)
    return H.without_existing(h, h.filter("bucket_epoch % 7200 = 5400"), ["symbol", "bucket_epoch"])


@query(f"{HOURS} SELECT {FIELDS} FROM c WHERE bucket_epoch + 3600 <= {NOW}")
def completed_only(spark, d):
    return H.completed(hours(spark, d), "bucket_epoch", 3600, NOW)


@query("WITH o AS (SELECT o_orderpriority AS symbol, floor(epoch(min(o_orderdate)))::BIGINT AS lo, floor(epoch(max(o_orderdate)))::BIGINT AS hi FROM orders GROUP BY 1) SELECT symbol, f AS chunk_from, least(f + 8639999, hi) AS chunk_to FROM (SELECT symbol, hi, unnest(range(lo, hi + 1, 8640000)) AS f FROM o)")
def range_chunks(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("symbol")).agg(B.epoch(F.min("o_orderdate")).alias("lo"), B.epoch(F.max("o_orderdate")).alias("hi"))
    return H.range_chunks(o, "5")


@query(f"{USERS}, h AS (SELECT symbol, count(*) AS n, min(bucket_epoch) AS f, max(bucket_epoch) AS l FROM c GROUP BY 1), r AS (SELECT symbol, CASE WHEN n >= 60 THEN l + 900 ELSE least(1706745600 - 54000, f) END AS lo, 1706745600 AS hi FROM h) SELECT * FROM r WHERE lo <= hi")
def warmup_ranges(spark, d):
    return H.warmup_ranges(users(spark, d), 1_706_745_600, 900, rows=60)


@query(f"{USERS}, h AS (SELECT symbol, max(bucket_epoch) AS l FROM c GROUP BY 1) SELECT symbol, l + 900 AS lo, m AS hi FROM h, (SELECT max(l) AS m FROM h) WHERE l < m")
def catch_up_ranges(spark, d):
    return H.catch_up_ranges(users(spark, d), 900)


@query(f"{TICKS} SELECT symbol, max_by(ltp, seq) AS ltp, max_by(e, seq) AS e, max(seq) AS seq FROM t GROUP BY 1")
def latest_tick(spark, d):
    return S.latest(S.from_events(spark, d))


FLAGS = f"{TICKS}, b AS (SELECT *, {bucket_sql('e', 3600)} AS bucket_epoch FROM t), g AS (SELECT *, e - lag(e) OVER (PARTITION BY symbol, bucket_epoch ORDER BY seq) AS g FROM b), a AS (SELECT symbol, bucket_epoch, min(e) AS first_tick, max(e) AS last_tick, max(g) AS w, count(*) AS volume FROM g GROUP BY 1, 2), r AS (SELECT *, CASE WHEN first_tick - bucket_epoch > 600 THEN 'late_start' WHEN w > 600 THEN 'tick_gap' ELSE '' END AS partial_reason FROM a)"


@query(f"{FLAGS} SELECT symbol, bucket_epoch, first_tick, last_tick, volume, partial_reason, partial_reason <> '' AS is_partial FROM r")
def tick_gap_flags(spark, d):
    return C.quality_flags(S.from_events(spark, d), 3600, B.session_bucket(F.col("e"), F.col("symbol"), 3600), gap=600)


@query(f"{HOURS}, h AS (SELECT symbol, bucket_epoch AS ts, open, high, low, CASE WHEN bucket_epoch % 10800 = 1800 THEN close + 1 ELSE close END AS close FROM c WHERE symbol <> 'view'), k AS (SELECT c.symbol, count(*) AS matched, count(*) FILTER (c.close <> h.close) AS mismatched FROM c JOIN h ON c.symbol = h.symbol AND bucket_epoch = ts GROUP BY 1) SELECT s.symbol, coalesce(matched, 0) AS matched, coalesce(mismatched, 0) AS mismatched, CASE WHEN s.symbol IN (SELECT symbol FROM c) THEN 'ok' ELSE 'missing' END AS status FROM (SELECT DISTINCT symbol FROM c UNION SELECT 'absent') s LEFT JOIN k USING (symbol)")
def reconcile_ohlc(spark, d):
    h = hours(spark, d)
    history = h.filter("symbol <> 'view'").select("symbol", F.col("bucket_epoch").alias("timestamp"), "open", "high", "low", F.when(F.col("bucket_epoch") % 10_800 == 1800, F.col("close") + 1).otherwise(F.col("close")).alias("close"))
    return C.reconcile(h, history, h.select("symbol").unionByName(spark.createDataFrame([("absent",)], "symbol string")))


@query(f"{HOURS} SELECT symbol, bucket_epoch, strftime(make_timestamp((bucket_epoch + 19800) * 1000000), '%Y-%m-%d %H:%M:%S') AS ist_time, strftime(make_timestamp((bucket_epoch + 3600 + 19800) * 1000000), '%Y-%m-%d %H:%M:%S') AS bucket_close_ist, open, high, low, close FROM c")
def candle_rows(spark, d):
    return H.candle_rows(hours(spark, d), 3600)


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT event_id AS seq, event_type AS symbol, value AS ltp, 0.0::DOUBLE AS prev_close_price, 0.0::DOUBLE AS ch, 0.0::DOUBLE AS chp, 0.0::DOUBLE AS high_price, 0.0::DOUBLE AS low_price, 0.0::DOUBLE AS open_price, floor(epoch(ts))::BIGINT AS exch_feed_time, '' AS type FROM events")
def tick_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return S.parse(e.select(F.col("event_id").alias("seq"), F.to_json(F.struct(F.col("event_type").alias("symbol"), F.col("value").alias("ltp"), B.epoch("ts").alias("exch_feed_time"))).alias("value")))


@query("")
def paper_book(spark, d):
    from marketloom.streaming.ordered import paper_events

    return paper_events(P.breakout_signal(hours(spark, d)), S.from_events(spark, d), 3600, every=86_400)


#: Order books of the parts' brands: the dearest parts as bids, the cheapest of another size as asks.
BOOKS = """WITH p AS (SELECT p_brand AS symbol, p_retailprice AS price, p_size::BIGINT AS volume, p_partkey AS ord FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price DESC, ord) - 1 AS level, sum(volume) OVER (PARTITION BY symbol ORDER BY price DESC, ord) AS upto FROM p WHERE volume % 2 = 0),
a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY price, ord) - 1 AS level, sum(volume) OVER (PARTITION BY symbol ORDER BY price, ord) AS upto FROM p WHERE volume % 2 = 1)"""


def books(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("symbol"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("bigint").alias("volume"), F.col("p_partkey").alias("ord"))
    level = F.struct("price", "volume", "ord")
    side = lambda odd, sign: F.transform(F.array_sort(F.collect_list(F.when(F.col("volume") % 2 == odd, F.struct((sign * F.col("price")).alias("k"), "ord", level.alias("l"))))), lambda x: x["l"])
    book = p.groupBy("symbol").agg(F.struct(side(0, -1).alias("bids"), side(1, 1).alias("ask")).alias("b"))
    return H.depth(book.select(F.to_json(F.struct(F.lit("ok").alias("s"), F.create_map("symbol", "b").alias("d"))).alias("value")))


@query(
    f"""{BOOKS} SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.level, a.level) AS level, b.price AS bid, b.volume AS bid_volume, b.ord AS bid_orders, b.upto::BIGINT AS bid_upto,
  a.price AS ask, a.volume AS ask_volume, a.ord AS ask_orders, a.upto::BIGINT AS ask_upto, a.price - b.price AS spread FROM b FULL JOIN a ON a.symbol = b.symbol AND a.level = b.level"""
)
def depth_levels(spark, d):
    return books(spark, d)


@query(
    f"""{BOOKS}, t AS (SELECT *, greatest(0, least(volume, 500 - (upto - volume))) AS n FROM a)
SELECT symbol, coalesce(sum(n), 0)::BIGINT AS filled, round(sum(n * price) / nullif(sum(n), 0), 6) AS mean_price, max(price) FILTER (n > 0) AS worst FROM (SELECT DISTINCT symbol FROM p) LEFT JOIN t USING (symbol) GROUP BY 1"""
)
def depth_price(spark, d):
    return H.price_for(books(spark, d), 500).withColumn("mean_price", F.round("mean_price", 6))


@query("SELECT s_name AS symbol, s_acctbal AS open_price, s_acctbal + 1 AS current_price FROM supplier")
def quotes_extract(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    entry = F.struct(F.col("s_name").alias("n"), F.struct(F.col("s_acctbal").alias("open_price"), (F.col("s_acctbal") + 1).alias("lp")).alias("v"))
    return H.quotes(s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(entry).alias("d"))).alias("value")))


# Strategy and paper trading.

SIG = f"{HOURS}, s AS (SELECT *, CASE WHEN close > lag(high) OVER w THEN 'BUY' WHEN close < lag(low) OVER w THEN 'SELL' ELSE 'NONE' END AS signal FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bucket_epoch))"
TRADES = f"""{SIG}, n AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY bucket_epoch) AS p FROM s WHERE signal <> 'NONE'),
r AS (SELECT symbol, signal AS side, close AS entry_price, bucket_epoch AS entry_epoch, lead(close) OVER w AS exit_price, lead(bucket_epoch) OVER w AS exit_epoch FROM n WHERE p IS NULL OR p <> signal WINDOW w AS (PARTITION BY symbol ORDER BY bucket_epoch)),
tr AS (SELECT *, round(CASE WHEN side = 'BUY' THEN exit_price - entry_price ELSE entry_price - exit_price END, 2) AS pnl FROM r)"""


@query(f"{SIG} SELECT {FIELDS}, signal FROM s")
def breakout_signal(spark, d):
    return P.breakout_signal(hours(spark, d))


@query(f"{TRADES} SELECT * FROM tr")
def trades_reverse(spark, d):
    return P.reversal_trades(P.breakout_signal(hours(spark, d)))


#: The book as a recursion over candles and ticks in order: what is open after each, and what it closed.
PAPER = f"""{SIG.replace('WITH raw', 'WITH RECURSIVE raw', 1)}, ev0 AS (SELECT symbol, bucket_epoch + 3600 AS due, 0 AS kind, 0 AS seq, close AS price, bucket_epoch AS epoch, signal FROM s WHERE signal <> 'NONE' UNION ALL SELECT symbol, e, 1, seq, ltp, e, NULL FROM t),
ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY due, kind, seq) AS i FROM ev0),
bk AS (SELECT DISTINCT symbol, 0::BIGINT AS i, NULL::VARCHAR AS side, NULL::DOUBLE AS entry, NULL::BIGINT AS since, NULL::VARCHAR AS c_side, NULL::DOUBLE AS c_entry, NULL::BIGINT AS c_since, NULL::DOUBLE AS c_price, NULL::BIGINT AS c_epoch, NULL::VARCHAR AS c_reason FROM ev
 UNION ALL SELECT symbol, i, CASE WHEN opens THEN signal WHEN NOT ends THEN side END, CASE WHEN opens THEN price WHEN NOT ends THEN entry END, CASE WHEN opens THEN epoch WHEN NOT ends THEN since END,
   CASE WHEN ends THEN side END, CASE WHEN ends THEN entry END, CASE WHEN ends THEN since END, CASE WHEN ends THEN price END, CASE WHEN ends THEN epoch END, CASE WHEN ends THEN CASE WHEN kind = 0 THEN 'REVERSAL' WHEN sl THEN 'SL' ELSE 'TP' END END
  FROM (SELECT *, kind = 0 AND (side IS NULL OR side <> signal) AS opens, coalesce(side IS NOT NULL AND CASE WHEN kind = 0 THEN side <> signal ELSE sl OR tp END, false) AS ends
   FROM (SELECT ev.*, side, entry, since, CASE WHEN side = 'BUY' THEN ev.price <= entry - 10 AND entry <> 10 ELSE ev.price >= entry + 10 END AS sl, CASE WHEN side = 'BUY' THEN ev.price >= entry + 20 ELSE ev.price <= entry - 20 AND entry <> 20 END AS tp
    FROM bk JOIN ev ON ev.symbol = bk.symbol AND ev.i = bk.i + 1))),
pt0 AS (SELECT symbol, c_side AS side, c_entry AS entry_price, c_since AS entry_epoch, c_price AS exit_price, c_epoch AS exit_epoch, c_reason AS reason FROM bk WHERE c_side IS NOT NULL
 UNION ALL SELECT symbol, side, entry, since, NULL, NULL, 'OPEN' FROM bk WHERE side IS NOT NULL AND i = (SELECT max(ev.i) FROM ev WHERE ev.symbol = bk.symbol)),
pt AS (SELECT *, round(CASE WHEN side = 'BUY' THEN exit_price - entry_price ELSE entry_price - exit_price END, 2) AS pnl FROM pt0)"""


@query(f"{PAPER} SELECT * FROM pt")
def sl_tp_exit(spark, d):
    return P.paper_trades(P.breakout_signal(hours(spark, d)), S.from_events(spark, d), 3600)


@query(
    f"""{PAPER}, l AS (SELECT symbol, max_by(ltp, seq) AS mark FROM t GROUP BY 1), a AS (SELECT symbol, count(*) AS trades, round(coalesce(sum(pnl) FILTER (exit_epoch IS NOT NULL), 0), 2) AS realized,
  round(coalesce(sum(CASE WHEN side = 'BUY' THEN mark - entry_price ELSE entry_price - mark END) FILTER (exit_epoch IS NULL), 0), 2) AS unrealized FROM pt LEFT JOIN l USING (symbol) GROUP BY 1)
SELECT *, round(realized + unrealized, 2) AS total FROM a"""
)
def pnl_summary(spark, d):
    t = S.from_events(spark, d)
    return P.summary(P.paper_trades(P.breakout_signal(C.session_ohlc(t, 3600)), t, 3600), S.latest(t))


# Instruments: parts are underlyings, line items their options.

OPT = """WITH o AS (SELECT DISTINCT p_brand AS underlying_symbol, floor(epoch(date_trunc('week', l_shipdate)))::BIGINT + 302400 AS expiry_epoch, (p_size * 50 + 1000)::DOUBLE AS strike,
  CASE WHEN l_linenumber % 2 = 0 THEN 'CE' ELSE 'PE' END AS option_type FROM lineitem JOIN part ON l_partkey = p_partkey),
opt AS (SELECT *, underlying_symbol || '-' || expiry_epoch || '-' || strike::BIGINT || '-' || option_type AS symbol FROM o), sp AS (SELECT p_brand AS underlying_symbol, 1000 + 25.0::DOUBLE * (max(p_size) + min(p_size)) AS spot FROM part GROUP BY 1)"""
EXP = f"{OPT}, x AS (SELECT DISTINCT underlying_symbol, expiry_epoch, strftime(make_timestamp((expiry_epoch + 19800) * 1000000), '%Y-%m') AS m FROM opt), y AS (SELECT underlying_symbol, expiry_epoch, expiry_epoch = max(expiry_epoch) OVER (PARTITION BY underlying_symbol, m) AS is_monthly FROM x), ex AS (SELECT *, row_number() OVER (PARTITION BY underlying_symbol ORDER BY expiry_epoch) AS nth, row_number() OVER (PARTITION BY underlying_symbol, is_monthly ORDER BY expiry_epoch) AS nth_of_kind FROM y)"
ATM = f"{OPT}, am AS (SELECT underlying_symbol, expiry_epoch, min_by(strike, abs(strike - spot) * 1000000 + strike) AS atm_strike FROM opt JOIN sp USING (underlying_symbol) GROUP BY 1, 2)"


def options(spark, d):
    l, p = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "part"))
    week = (B.epoch(F.date_trunc("week", "l_shipdate")) + 302_400).alias("expiry_epoch")
    o = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("underlying_symbol"), week, (F.col("p_size") * 50 + 1000).cast("double").alias("strike"), F.when(F.col("l_linenumber") % 2 == 0, "CE").otherwise("PE").alias("option_type"))
    return o.distinct().withColumn("symbol", F.concat_ws("-", "underlying_symbol", F.col("expiry_epoch").cast("string"), F.col("strike").cast("bigint").cast("string"), "option_type"))


def spots(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_brand").alias("underlying_symbol")).agg((F.lit(1000) + 25.0 * (F.max("p_size") + F.min("p_size"))).alias("spot"))


@query(f"{EXP} SELECT * FROM ex")
def expiry_calendar(spark, d):
    return I.expiries(options(spark, d))


@query(f"{EXP} SELECT underlying_symbol, expiry_epoch, nth_of_kind FROM ex WHERE is_monthly")
def monthly_expiries(spark, d):
    return I.expiries(options(spark, d)).filter("is_monthly").select("underlying_symbol", "expiry_epoch", "nth_of_kind")


@query(f"{EXP} SELECT underlying_symbol, expiry_epoch, nth_of_kind FROM ex WHERE NOT is_monthly")
def weekly_expiries(spark, d):
    return I.expiries(options(spark, d)).filter("NOT is_monthly").select("underlying_symbol", "expiry_epoch", "nth_of_kind")


@query(f"{EXP} SELECT underlying_symbol, expiry_epoch, nth FROM ex WHERE nth <= 3")
def nth_expiry(spark, d):
    return I.expiries(options(spark, d)).filter("nth <= 3").select("underlying_symbol", "expiry_epoch", "nth")


@query(f"{OPT} SELECT underlying_symbol, coalesce(min(expiry_epoch) FILTER (expiry_epoch >= 796847400), min(expiry_epoch)) AS expiry_epoch FROM opt GROUP BY 1")
def nearest_expiry(spark, d):
    return I.nearest_expiry(options(spark, d), 796_900_000)


@query(f"{EXP} SELECT opt.* FROM opt SEMI JOIN (SELECT * FROM ex WHERE NOT is_monthly AND nth_of_kind = 2) USING (underlying_symbol, expiry_epoch) WHERE option_type = 'CE'")
def next_weekly_ce(spark, d):
    return I.chain(options(spark, d), monthly=False, nth=2, option_type="CE")


@query(f"{EXP} SELECT opt.* FROM opt SEMI JOIN (SELECT * FROM ex WHERE is_monthly AND nth_of_kind = 1) USING (underlying_symbol, expiry_epoch)")
def current_monthly_chain(spark, d):
    return I.chain(options(spark, d), monthly=True, nth=1)


@query(f"{ATM} SELECT * FROM am")
def atm_strike(spark, d):
    return I.atm(options(spark, d), spots(spark, d))


@query(f"{ATM} SELECT underlying_symbol, expiry_epoch, atm_strike, min(symbol) FILTER (option_type = 'CE') AS ce_symbol, min(symbol) FILTER (option_type = 'PE') AS pe_symbol FROM opt JOIN am USING (underlying_symbol, expiry_epoch) WHERE strike = atm_strike GROUP BY 1, 2, 3")
def atm_pair(spark, d):
    return I.atm_pair(options(spark, d), spots(spark, d))


def _near(option_type: str, side: str):
    above = (option_type == "CE") == (side == "OTM")
    sql = f"{ATM}, n AS (SELECT opt.*, atm_strike, row_number() OVER (PARTITION BY underlying_symbol, expiry_epoch ORDER BY strike {'ASC' if above else 'DESC'}, symbol) AS rank FROM opt JOIN am USING (underlying_symbol, expiry_epoch) WHERE option_type = '{option_type}' AND strike {'>' if above else '<'} atm_strike) SELECT * FROM n WHERE rank <= 5"
    name = f"{side.lower()}_{option_type.lower()}_topk"
    QUERIES[name] = lambda spark, d: I.near_money(options(spark, d), spots(spark, d), option_type, side)
    ORACLES[name] = sql


for _type in ("CE", "PE"):
    for _side in ("OTM", "ITM"):
        _near(_type, _side)


@query(f"{OPT} SELECT DISTINCT underlying_symbol, strike FROM opt")
def distinct_strikes(spark, d):
    return I.strikes_of(options(spark, d))


@query("SELECT r_name AS name, CASE r_regionkey WHEN 1 THEN 'NSE:NIFTY50-INDEX' WHEN 2 THEN 'BSE:SENSEX-INDEX' END AS spot_symbol, CASE r_regionkey WHEN 1 THEN 'NSE' WHEN 2 THEN 'BSE' END AS option_exchange, CASE r_regionkey WHEN 1 THEN 50 WHEN 2 THEN 100 END AS step FROM region")
def index_configuration(spark, d):
    r = spark.read.parquet(f"{d}/region.parquet")
    index = F.when(F.col("r_regionkey") == 1, " nifty").when(F.col("r_regionkey") == 2, "SENSEX").otherwise("none")
    return I.with_index(r.select(F.col("r_name").alias("name"), index.alias("index")), "index").drop("index")


@query(f"{OPT} SELECT opt.* FROM opt WHERE strike IN (1500, 2000, 2500)")
def strikes_for(spark, d):
    o = options(spark, d)
    return I.for_strikes(o, o.filter("strike IN (1500, 2000, 2500)"))


LADDER = "SELECT p_name || '-' || p_partkey AS name, floor(p_retailprice / 50)::BIGINT * 50 AS o, floor((p_retailprice + p_size * 20) / 50)::BIGINT * 50 AS c FROM part"


def opens(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.lit(50).alias("step"), F.col("p_retailprice").alias("open_price"), (F.col("p_retailprice") + F.col("p_size") * 20).alias("current_price"))


@query(f"SELECT name, unnest(range(least(o - 250, c), greatest(o + 250, c) + 1, 50)) AS strike FROM ({LADDER})")
def strike_ladder(spark, d):
    return I.strike_ladder(opens(spark, d), 5)


@query(f"SELECT name, unnest(range(c - 250, c + 251, 50)) AS strike, o FROM ({LADDER}) WHERE c < o - 250 OR c > o + 250".replace("SELECT name, unnest", "SELECT name, strike FROM (SELECT name, unnest", 1) + ") WHERE strike < o - 250 OR strike > o + 250")
def subscription_expansion(spark, d):
    o = opens(spark, d)
    return I.expansion(I.strike_ladder(o.withColumn("current_price", F.col("open_price")), 5), o, 5)


def parts(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_name").alias("symbol"), F.col("p_type").alias("display_name"), F.col("p_brand").alias("underlying_symbol"))


@query("SELECT * FROM (SELECT p_name || ' ' || p_partkey AS symbol, p_type AS display_name, p_brand AS underlying_symbol FROM part) WHERE contains(lower(symbol), 'ring 1') OR contains(lower(display_name), 'ring 1') ORDER BY symbol LIMIT 50")
def symbol_search(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return I.search(p.select(F.concat_ws(" ", "p_name", "p_partkey").alias("symbol"), F.col("p_type").alias("display_name"), F.col("p_brand").alias("underlying_symbol")), " Ring 1 ")


@query("SELECT p_name AS symbol, p_type AS display_name, p_brand AS underlying_symbol FROM part WHERE contains(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 'brand1') OR contains(regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g'), 'brand1') OR contains(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), 'brand1')")
def underlying_match(spark, d):
    return I.of_underlying(parts(spark, d), "Brand#1")


@query("SELECT p_partkey, CASE p_size WHEN 10 THEN 'NSE' WHEN 12 THEN 'BSE' ELSE p_size::VARCHAR END AS exchange, CASE p_size WHEN 10 THEN 'CM' WHEN 11 THEN 'FO' ELSE p_size::VARCHAR END AS segment FROM part")
def code_maps(spark, d):
    size = F.col("p_size").cast("string")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.mapped(size, T.EXCHANGES).alias("exchange"), T.mapped(size, T.SEGMENTS).alias("segment"))


@query("SELECT n_nationkey, 'NSE:' || upper(trim(n_name)) || '-EQ' AS broker, upper(trim(n_name)) AS plain FROM nation")
def symbol_format(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", T.to_broker(F.col("n_name")).alias("broker"))
    return n.withColumn("plain", T.from_broker(F.col("broker")))


@query("SELECT r_name AS sector, n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
def sector_members(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    return I.members(n.join(r, F.col("n_regionkey") == F.col("r_regionkey")), F.col("r_name"), F.col("n_name"))


@query("SELECT p_partkey, coalesce(try_cast(trim(p_type) AS DOUBLE), 0) AS as_double, coalesce(try_cast(p_retailprice AS DOUBLE), 0)::BIGINT - CASE WHEN coalesce(try_cast(p_retailprice AS DOUBLE), 0)::BIGINT > p_retailprice THEN 1 ELSE 0 END AS as_long FROM part")
def permissive_casts(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", T.to_double(F.col("p_type")).alias("as_double"), T.to_long(F.col("p_retailprice")).alias("as_long"))


# Point-and-figure: one chart an event type, of its ticks' prices moved up by 100.

PNF = """WITH RECURSIVE raw AS (SELECT event_type AS chart_id, event_id AS seq, round(100 + value, 2) AS price FROM events), bars AS (SELECT chart_id, seq, round(price * 100)::BIGINT AS p, row_number() OVER (PARTITION BY chart_id ORDER BY seq) AS i FROM raw),
f AS (SELECT chart_id, i, seq, p AS ref, 0 AS trend, -1 AS col, seq AS began, 0::BIGINT AS n, p AS last FROM bars WHERE i = 1
 UNION ALL SELECT chart_id, i, seq, ref, CASE WHEN act = 1 THEN trend WHEN act = 2 THEN sign(n)::INT ELSE trend END, CASE WHEN act = 2 THEN col + 1 ELSE col END, CASE WHEN act = 2 AND trend <> 0 THEN seq ELSE began END, CASE WHEN act = 0 THEN 0 ELSE n END,
   CASE WHEN act = 0 THEN ref ELSE (2 * ref * (100 + n) + 100) // 200 END
  FROM (SELECT *, CASE WHEN trend <> 0 AND n * trend >= 1 THEN 1 WHEN (trend = 0 AND abs(n) >= 3) OR (trend <> 0 AND -n * trend >= 3) THEN 2 ELSE 0 END AS act
   FROM (SELECT b.chart_id, b.i, b.seq, f.last AS ref, f.trend, f.col, f.began, CASE WHEN b.p >= f.last THEN (b.p - f.last) * 100 // f.last ELSE -((f.last - b.p) * 100 // f.last) END AS n FROM f JOIN bars b ON b.chart_id = f.chart_id AND b.i = f.i + 1))),
a AS (SELECT * FROM f WHERE n <> 0), bx AS (SELECT chart_id, col AS column_index, trend, seq, unnest(range(1, abs(n) + 1)) AS j, ref, began FROM a),
b2 AS (SELECT chart_id, column_index, trend, seq, ((2 * ref * (100 + trend * j) + 100) // 200) / 100 AS box_value, began FROM bx),
ends AS (SELECT chart_id, column_index, max(seq) AS action_seq, max(trend) AS trend, min(began) AS start_seq, count(*)::INT AS filled FROM b2 GROUP BY 1, 2),
cl AS (SELECT *, dense_rank() OVER (PARTITION BY chart_id ORDER BY box_value) - 1 AS box_index FROM (SELECT DISTINCT chart_id, column_index, box_value, ends.trend, ends.action_seq FROM b2 JOIN ends USING (chart_id, column_index))),
st AS (SELECT chart_id, column_index, max(box_index) AS high, min(box_index) AS low, count(*)::INT AS height, max(box_value) AS high_value, min(box_value) AS low_value, max(trend) AS trend, median(box_value) AS midpoint FROM cl GROUP BY 1, 2),
br0 AS (SELECT c.* FROM cl c ANTI JOIN (SELECT chart_id, column_index + 1 AS column_index, box_index FROM cl) l USING (chart_id, column_index, box_index) WHERE c.column_index >= 1),
mk AS (SELECT *, row_number() OVER (PARTITION BY chart_id, box_index, trend ORDER BY column_index) AS rk FROM cl),
br1 AS (SELECT b.*, b.box_index - b.trend AS line, coalesce(m.column_index, -1) AS foe FROM br0 b ASOF LEFT JOIN mk m ON m.chart_id = b.chart_id AND m.box_index = b.box_index - b.trend AND m.trend = -b.trend AND b.column_index >= m.column_index),
br2 AS (SELECT b.*, m.rk AS last_rk, m.column_index AS last FROM br1 b ASOF JOIN mk m ON m.chart_id = b.chart_id AND m.box_index = b.line AND m.trend = b.trend AND b.column_index >= m.column_index),
br3 AS (SELECT b.*, coalesce(m.rk, 0) AS foe_rk FROM br2 b ASOF LEFT JOIN mk m ON m.chart_id = b.chart_id AND m.box_index = b.line AND m.trend = b.trend AND b.foe >= m.column_index),
br4 AS (SELECT b.*, m.column_index AS z, m.trend AS tz FROM br3 b ASOF LEFT JOIN cl m ON m.chart_id = b.chart_id AND m.box_index = b.box_index AND b.column_index > m.column_index WHERE last_rk - foe_rk >= 2),
br5 AS (SELECT b.*, coalesce(m.trend, 0) AS pz FROM br4 b LEFT JOIN cl m ON m.chart_id = b.chart_id AND m.box_index = b.box_index AND m.column_index = z - 1),
br AS (SELECT b.chart_id, b.trend, CASE WHEN coalesce(z, 0) = 0 THEN CASE WHEN coalesce(tz, b.trend) = b.trend THEN 'conti' ELSE 'reversal' END WHEN tz = b.trend AND pz <> -b.trend THEN 'resistance' WHEN tz = -b.trend AND pz = -b.trend AND b.trend = 1 THEN 'fulcrum' ELSE 'reversal' END AS type,
  b.column_index, b.box_index, last_rk - foe_rk - p AS hits, last - m.column_index + 1 AS width, CASE WHEN z IS NULL THEN last + 1 ELSE last - z + 1 END AS outer_width, b.action_seq
  FROM (SELECT *, unnest(range(0, greatest(1, last_rk - foe_rk - 1))) AS p FROM br5) b JOIN mk m ON m.chart_id = b.chart_id AND m.box_index = line AND m.trend = b.trend AND m.rk = foe_rk + p + 1)"""


def pnf(spark, d, rules: PnfRules = PnfRules(), run: int | None = None):
    e = spark.read.parquet(f"{d}/events.parquet")
    return columns(e.select(F.col("event_type").alias("chart_id"), F.col("event_id").alias("seq"), F.round(100 + F.col("value"), 2).alias("close")), rules, run)


def drawn(spark, d, rules: PnfRules = PnfRules()):
    """The charts' cells, of columns that are computed once for all that is asked of them."""
    return K.cells(once(pnf(spark, d, rules), "columns"))


def stats(spark, d):
    return K.column_stats(K.cells(pnf(spark, d)))


def parts_of(spark, d, rules: PnfRules = PnfRules()):
    """Cells, column figures and breakouts."""
    c = drawn(spark, d, rules)
    return c, once(K.column_stats(c).drop("midpoint"), "stats"), once(K.breakouts(c), "breakouts")


@query(f"{PNF} SELECT chart_id, column_index, trend, start_seq, action_seq AS end_seq, filled FROM ends")
def pnf_columns(spark, d):
    return pnf(spark, d).select("chart_id", "column_index", "trend", "start_seq", "end_seq", F.size("boxes").alias("filled"))


@query(f"{PNF} SELECT chart_id, action_seq AS seq, column_index, trend, filled AS filled_boxes, CASE WHEN trend = 1 THEN high_value ELSE low_value END AS box_value FROM ends JOIN st USING (chart_id, column_index, trend)")
def pnf_time_series(spark, d):
    return K.time_series(pnf(spark, d))


@query(f"{PNF} SELECT * FROM cl")
def pnf_cells(spark, d):
    return K.cells(pnf(spark, d))


@query(f"{PNF} SELECT * FROM st")
def pnf_column_stats(spark, d):
    return stats(spark, d)


FULL = "CASE WHEN row_number() OVER (PARTITION BY chart_id ORDER BY column_index) >= 5 THEN {} END"
FRAME = "OVER (PARTITION BY chart_id ORDER BY column_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query(f"{PNF} SELECT chart_id, column_index, round({FULL.format('avg(midpoint) ' + FRAME)}, 6) AS sma_5 FROM st")
def pnf_sma(spark, d):
    return K.sma(stats(spark, d), 5).select("chart_id", "column_index", F.round("sma_5", 6).alias("sma_5"))


@query(f"{PNF} SELECT chart_id, column_index, round({FULL.format(f'avg(midpoint) {FRAME} + 2 * stddev_pop(midpoint) {FRAME}')}, 4) AS upper, round({FULL.format(f'avg(midpoint) {FRAME} - 2 * stddev_pop(midpoint) {FRAME}')}, 4) AS lower FROM st")
def pnf_bollinger(spark, d):
    return K.bollinger(stats(spark, d), 5, 2.0).select("chart_id", "column_index", F.round("upper", 4).alias("upper"), F.round("lower", 4).alias("lower"))


@query(f"{PNF}, dc AS (SELECT chart_id, column_index, {FULL.format('max(high_value) ' + FRAME)} AS u, {FULL.format('min(low_value) ' + FRAME)} AS l FROM st) SELECT chart_id, column_index, lag(u, 1) OVER w AS upper, lag(l, 1) OVER w AS lower FROM dc WINDOW w AS (PARTITION BY chart_id ORDER BY column_index)")
def pnf_donchian(spark, d):
    return K.donchian(stats(spark, d), 5, 1).select("chart_id", "column_index", "upper", "lower")


@query(
    PNF
    + """, o AS (SELECT chart_id, column_index, midpoint, row_number() OVER (PARTITION BY chart_id ORDER BY column_index) AS i FROM st), s0 AS (SELECT chart_id, avg(midpoint) AS m FROM o WHERE i <= 5 GROUP BY 1 HAVING count(*) = 5),
em AS (SELECT o.chart_id, o.column_index, o.i, s0.m AS v FROM o JOIN s0 USING (chart_id) WHERE i = 5 UNION ALL SELECT o.chart_id, o.column_index, o.i, em.v + (o.midpoint - em.v) * (2::DOUBLE / 6) FROM em JOIN o ON o.chart_id = em.chart_id AND o.i = em.i + 1)
SELECT st.chart_id, st.column_index, round(em.v, 6) AS ema_5 FROM st LEFT JOIN em USING (chart_id, column_index)"""
)
def pnf_ema(spark, d):
    return K.ema(stats(spark, d), 5).select("chart_id", "column_index", F.round("ema_5", 6).alias("ema_5"))


@query("")
def pnf_psar(spark, d):
    return K.psar(stats(spark, d), 0.02, 0.2).select("chart_id", "column_index", F.round("psar", 6).alias("psar"))


@query(f"{PNF} SELECT * FROM br")
def pnf_breakouts(spark, d):
    return K.breakouts(drawn(spark, d))


@query(f"{PNF}, bs AS (SELECT chart_id, column_index, CASE WHEN trend = 1 AND high > lag(high, 2) OVER w THEN 0 WHEN trend = -1 AND low < lag(low, 2) OVER w THEN 1 END AS code, high, low FROM st WINDOW w AS (PARTITION BY chart_id ORDER BY column_index)) SELECT chart_id, column_index, code, CASE WHEN code = 0 THEN high ELSE low END + 1 AS box_index FROM bs WHERE code IS NOT NULL")
def pnf_buy_sell(spark, d):
    return K.buy_sell(stats(spark, d))


@query(f"{PNF} SELECT chart_id, column_index, box_index, hits, width, type FROM br WHERE trend = 1 AND hits = 2 AND width <= 3")
def pnf_double_top_buy(spark, d):
    return K.multiple(K.breakouts(drawn(spark, d), hits=2), 2, 1).select("chart_id", "column_index", "box_index", "hits", "width", "type")


@query(f"{PNF} SELECT chart_id, column_index, box_index, hits, width, type FROM br WHERE trend = -1 AND hits = 3 AND width <= 5")
def pnf_triple_bottom_sell(spark, d):
    return K.multiple(K.breakouts(drawn(spark, d), hits=3), 3, -1).select("chart_id", "column_index", "box_index", "hits", "width", "type")


@query("")
def pnf_signals(spark, d):
    c = drawn(spark, d)
    s = once(K.column_stats(c).drop("midpoint"), "stats")
    return K.signals(s, once(K.breakouts(c).drop("type", "outer_width", "action_seq"), "breakouts"), cells_=c)


#: In a series of one row a column, the row of each breakout's column has come to its end.
@query(f"{PNF} SELECT br.chart_id, br.column_index, max(ends.action_seq) AS seq, max_by(v.box_value, br.box_index) AS price FROM br JOIN ends ON ends.chart_id = br.chart_id AND ends.column_index = br.column_index JOIN (SELECT DISTINCT chart_id, box_index, box_value FROM cl) v ON v.chart_id = br.chart_id AND v.box_index = br.box_index WHERE br.trend = 1 AND hits = 2 AND width <= 3 GROUP BY 1, 2")
def pnf_double_top_prices(spark, d):
    columns_ = once(pnf(spark, d), "columns")
    c = K.cells(columns_)
    return K.multiple_prices(K.time_series(columns_), c, K.breakouts(c, hits=2), 2, 1)


@query(
    f"""{PNF}, r AS (SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY column_index DESC) AS k FROM st), p AS (SELECT chart_id, max(trend) FILTER (k = 1) AS t, max(high) FILTER (k = 1) AS h1, max(high) FILTER (k = 2) AS h2, max(high) FILTER (k = 3) AS h3,
  max(low) FILTER (k = 1) AS l1, max(low) FILTER (k = 2) AS l2, max(low) FILTER (k = 3) AS l3 FROM r WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3)
SELECT chart_id, CASE WHEN t = 1 THEN CASE WHEN h1 <= h3 THEN h3 + 1 END ELSE h2 + 1 END AS next_buy, CASE WHEN t = -1 THEN CASE WHEN l1 >= l3 THEN l3 - 1 END ELSE l2 - 1 END AS next_sell FROM p"""
)
def pnf_next_signal(spark, d):
    return K.next_simple_signal(stats(spark, d))


@query("")
def pnf_trendlines_strong(spark, d):
    c = drawn(spark, d)
    return K.trendlines(c, once(K.column_stats(c).drop("midpoint"), "stats"), 4)


@query("")
def pnf_trendlines_weak(spark, d):
    c = drawn(spark, d)
    return K.weak_trendlines(c, once(K.column_stats(c).drop("midpoint"), "stats"), K.breakouts(c, inner=False), 4)


#: What the columns of a breakout's width hold, rows seen in its direction; the scale goes on by its percentage beyond the boxes.
COUNTS = f"""{PNF}, pat AS (SELECT b.chart_id, b.trend, b.type, b.column_index, b.box_index, b.hits, b.width, min(CASE WHEN b.trend = 1 THEN s.low ELSE -s.high END) AS foot, max_by(CASE WHEN b.trend = 1 THEN s.low ELSE -s.high END, -s.column_index) AS foot1, max_by(s.trend, -s.column_index) AS t1,
  max_by(s.height, -s.column_index) AS height1, max(CASE WHEN s.column_index = b.column_index - 1 THEN CASE WHEN b.trend = 1 THEN s.low ELSE -s.high END END) AS foot2, sum(greatest(0, least(CASE WHEN b.trend = 1 THEN s.high ELSE -s.low END, b.trend * b.box_index - 1) - CASE WHEN b.trend = 1 THEN s.low ELSE -s.high END + 1)) AS filled,
  max(struct_pack(f := -CASE WHEN b.trend = 1 THEN s.low ELSE -s.high END, c := s.column_index)).c AS last FROM br b JOIN st s ON s.chart_id = b.chart_id AND s.column_index BETWEEN b.column_index - b.width + 1 AND b.column_index GROUP BY ALL),
ct0 AS (SELECT chart_id, trend, 'vertical' AS type, column_index, box_index, column_index - width + 1 AS anchor_column, height1::INT AS length, trend * (foot - 1) AS ar, trend * (foot - 1 + height1 * 3) AS tr, trend * (foot2 - 1) AS r1, trend * (foot - 1) AS r2, filled / ((width - 1) * (trend * box_index - foot - 1) + trend * box_index - foot) AS q FROM pat WHERE foot1 = foot AND t1 = trend
 UNION ALL SELECT chart_id, trend, 'horizontal R>1', column_index, box_index, last, width::INT, trend * foot, trend * (foot + width * 3), trend * (foot2 - 1), trend * (foot - 1), filled / ((width - 1) * (trend * box_index - foot - 1) + trend * box_index - foot) FROM pat WHERE type = 'reversal' AND width >= 5),
sc AS (SELECT chart_id, box_index, max(box_value) AS v FROM cl GROUP BY 1, 2), se AS (SELECT chart_id, max(box_index) AS top, max(v) AS hi, min(v) AS lo FROM sc GROUP BY 1),
need AS (SELECT DISTINCT chart_id, r FROM (SELECT chart_id, unnest([ar, tr, r1, r2, box_index]) AS r FROM ct0)), rv AS (SELECT n.chart_id, n.r, CASE WHEN n.r > top THEN round(hi * 1.01 ** (n.r - top), 2) WHEN n.r < 0 THEN round(lo / 1.01 ** -n.r, 2) ELSE v END AS v FROM need n JOIN se USING (chart_id) LEFT JOIN sc ON sc.chart_id = n.chart_id AND sc.box_index = n.r),
ct AS (SELECT ct0.chart_id, trend, type, column_index, box_index, b.v AS box, anchor_column, a.v AS anchor_box, length, t.v AS target, round((t.v - b.v) * trend, 6) AS reward, round((b.v - s1.v) * trend, 6) AS risk_1, round((b.v - s2.v) * trend, 6) AS risk_2, round(q, 2) AS quality FROM ct0
  JOIN rv b ON b.chart_id = ct0.chart_id AND b.r = box_index JOIN rv a ON a.chart_id = ct0.chart_id AND a.r = ar JOIN rv t ON t.chart_id = ct0.chart_id AND t.r = tr JOIN rv s1 ON s1.chart_id = ct0.chart_id AND s1.r = r1 JOIN rv s2 ON s2.chart_id = ct0.chart_id AND s2.r = r2)"""


def counted(f):
    def run(spark, d):
        c, s, b = parts_of(spark, d)
        return f(s, b, c, PnfRules()).drop("ratio_1", "ratio_2")

    return run


QUERIES["pnf_counts_vertical"] = counted(K.vertical_counts)
ORACLES["pnf_counts_vertical"] = f"{COUNTS} SELECT * FROM ct WHERE type = 'vertical'"
QUERIES["pnf_counts_horizontal"] = counted(K.horizontal_counts)
ORACLES["pnf_counts_horizontal"] = f"{COUNTS} SELECT * FROM ct WHERE type <> 'vertical'"


@query("")
def pnf_counts_base(spark, d):
    rules = PnfRules(reversal=1, scaling="abs", boxsize=2.0)
    c, s, b = parts_of(spark, d, rules)
    return K.counts(s, b, c, rules)


#: How far targets lie against how far the stops do, by chart and direction.
@query(f"{COUNTS} SELECT chart_id, trend, type, count(*) AS n, round(avg(reward), 1) AS reward, round(avg(risk_1), 1) AS risk_1, round(avg(risk_2), 1) AS risk_2 FROM ct GROUP BY 1, 2, 3")
def pnf_risk_reward(spark, d):
    c, s, b = parts_of(spark, d)
    both = K.vertical_counts(s, b, c, PnfRules()).unionByName(K.horizontal_counts(s, b, c, PnfRules()))
    mean = lambda x: F.round(F.avg(x), 1).alias(x)
    return both.groupBy("chart_id", "trend", "type").agg(F.count("*").alias("n"), mean("reward"), mean("risk_1"), mean("risk_2"))


@query("")
def pnf_abs_grid(spark, d):
    return K.column_stats(K.cells(pnf(spark, d, PnfRules(scaling="abs", boxsize=2.0), run=10_000)))


@query("")
def pnf_log_grid(spark, d):
    return K.column_stats(K.cells(pnf(spark, d, PnfRules(scaling="log_compounding", boxsize=2.0), run=10_000)))


@query("")
def pnf_render(spark, d):
    return K.render(K.cells(pnf(spark, d)))


@query("")
def pnf_render_lines(spark, d):
    c = drawn(spark, d)
    return K.render(c, lines=K.trendlines(c, once(K.column_stats(c).drop("midpoint"), "stats")))


@query(
    "WITH b AS (SELECT o_orderpriority AS k, o_orderdate AS t, max(o_totalprice) AS h, min(o_totalprice) AS l, max_by(o_totalprice, o_orderkey) AS c FROM orders GROUP BY 1, 2), r AS (SELECT k, t, greatest(h - l, abs(h - p), abs(l - p)) AS tr, row_number() OVER (PARTITION BY k ORDER BY t DESC) AS n FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY t) AS p FROM b) WHERE p IS NOT NULL) SELECT k AS chart_id, round(avg(tr), 4) AS atr FROM r WHERE n <= 14 GROUP BY 1"
)
def true_range_atr(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    b = o.groupBy(F.col("o_orderpriority").alias("chart_id"), F.col("o_orderdate").alias("seq")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    return mean_true_range(b, 14).select("chart_id", F.round("atr", 4).alias("atr"))


@query("")
def live_replay(spark, d):
    from marketloom.streaming.candle_stream import replay

    return replay(S.from_events(spark, d), 3600)


@query("SELECT o_custkey AS k, string_agg(l, chr(10) ORDER BY o) AS text FROM (SELECT o_custkey, o_orderkey AS o, o_orderpriority AS l FROM orders) GROUP BY 1 HAVING sum(length(l) + 1) <= 3900")
def packed_messages(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("l"))
    return H.pack_lines(o, "k", "o", "l").select("k", "text")
