"""Candle histories: files, keep-last upserts, anti-joins and range plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.timebucket import chunk_days, ist_text

CANDLE_CSV = "symbol STRING, bucket_epoch BIGINT, ist_time STRING, bucket_close_ist STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"
RESPONSE = "s STRING, candles ARRAY<ARRAY<DOUBLE>>"


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key the one that came last. Partial maxima leave one row a key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), order).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, "_r.*").select(df.columns)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(df.columns)


def without_existing(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(existing.select(keys).distinct(), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old and new together; of rows of one key new ones win, of several new ones the last by `order`.

    Without order the last that stands in the input wins, which holds for files and not for rows that were shuffled.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    arrived = lambda df, turn: df.withColumn("_new", F.struct(F.lit(turn).alias("turn"), at.alias("at")))
    both = arrived(old, 0).unionByName(arrived(new, 1), allowMissingColumns=True)
    return keep_last(both, keys, "_new").drop("_new")


def read_candles(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Candles of a CSV folder, the last row of each (symbol, bucket): the file written last counts, in a file the later row. No folder, or an empty one, gives none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)
    if not found:
        return spark.createDataFrame([], CANDLE_CSV)
    df = spark.read.schema(CANDLE_CSV).option("header", True).csv(path)
    df = df.filter(F.col("symbol") == symbol) if symbol else df
    m = "_metadata"
    written = F.struct(F.col(f"{m}.file_modification_time"), F.col(f"{m}.file_name"), F.col(f"{m}.file_block_start"), F.monotonically_increasing_id())
    return keep_last(df.withColumn("_at", written), ["symbol", "bucket_epoch"], "_at").drop("_at")


def candle_rows(candles: DataFrame, seconds: int) -> DataFrame:
    """Candles as the rows of a candle file, with Indian times."""
    b = F.col("bucket_epoch")
    return candles.select("symbol", "bucket_epoch", ist_text(b).alias("ist_time"), ist_text(b + seconds).alias("bucket_close_ist"), "open", "high", "low", "close")


def append_candles(candles: DataFrame, path: str, seconds: int) -> None:
    candle_rows(candles, seconds).write.mode("append").option("header", True).csv(path)


def save_history(df: DataFrame, path: str) -> None:
    """Parquet by kind and symbol; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "symbol").parquet(path)


def load_history(spark: SparkSession, path: str, kind: str, symbol: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("kind") == kind) & (F.col("symbol") == symbol))


def parse_response(df: DataFrame, column: str, symbol: str, seconds: int | None = None, now: int | None = None) -> DataFrame:
    """Rows of history responses; those that are not ok give none. With seconds and now, only completed candles."""
    rows = df.select(F.from_json(column, RESPONSE).alias("_r"), F.col(symbol).alias("symbol")).filter(F.col("_r.s") == "ok")
    rows = rows.select("symbol", F.explode("_r.candles").alias("c"))
    names = ["timestamp", "open", "high", "low", "close", "volume"]
    cast = lambda i, n: F.get("c", F.lit(i)).cast("bigint" if n in ("timestamp", "volume") else "double").alias(n)
    rows = rows.select(*[cast(i, n) for i, n in enumerate(names)], "symbol")
    return completed(rows, "timestamp", seconds, now) if seconds and now is not None else rows


def completed(df: DataFrame, column: str, seconds: int, now: int) -> DataFrame:
    return df.filter(F.col(column) + seconds <= now)


def range_chunks(ranges: DataFrame, resolution: str) -> DataFrame:
    """(symbol, lo, hi) cut into requests as long as the resolution allows; an empty range gives none."""
    step = chunk_days(resolution) * 86_400
    starts = F.explode(F.sequence("lo", "hi", F.lit(step)))
    return ranges.filter("lo <= hi").select("symbol", starts.alias("chunk_from"), "hi").select("symbol", "chunk_from", F.least(F.col("chunk_from") + step - 1, "hi").alias("chunk_to"))


def warmup_ranges(candles: DataFrame, now: int, seconds: int, rows: int = 180, least: int = 900) -> DataFrame:
    """For each symbol what to fetch before now: from its last bucket on, or further back while it has too few rows."""
    have = candles.groupBy("symbol").agg(F.count("*").alias("n"), F.min("bucket_epoch").alias("first"), F.max("bucket_epoch").alias("last"))
    back = F.lit(now - max(least, rows * seconds))
    start = F.when(F.col("n") >= rows, F.col("last") + seconds).otherwise(F.least(back, F.col("first")))
    return have.select("symbol", start.cast("bigint").alias("lo"), F.lit(now).cast("bigint").alias("hi")).filter("lo <= hi")


def catch_up_ranges(candles: DataFrame, seconds: int) -> DataFrame:
    """For each symbol that lags behind the furthest one, the range up to it."""
    last = candles.groupBy("symbol").agg(F.max("bucket_epoch").alias("last"))
    target = candles.agg(F.max("bucket_epoch")).scalar()  # a subquery of one number
    return last.filter(F.col("last") < target).select("symbol", (F.col("last") + seconds).alias("lo"), target.alias("hi"))


def tail(df: DataFrame, n: int, order: str = "bucket_epoch") -> DataFrame:
    """The last n rows of each symbol."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(order)))
    return df.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def quotes(df: DataFrame, column: str = "value") -> DataFrame:
    """Symbol, open and last price of the entries of quote responses."""
    q = F.from_json(column, "d ARRAY<STRUCT<n: STRING, v: STRUCT<open_price: DOUBLE, lp: DOUBLE>>>")
    return df.select(F.explode(q["d"]).alias("q")).select(F.col("q.n").alias("symbol"), F.col("q.v.open_price").alias("open_price"), F.col("q.v.lp").alias("current_price"))


def index_spots(quotes_: DataFrame, names: dict[str, str]) -> DataFrame:
    """name, open_price and current_price of the indices of quotes() that `names` maps from their symbols; others are left out, missing prices are 0."""
    name = F.coalesce(*[F.when(F.col("symbol") == k, v) for k, v in names.items()])
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return quotes_.select(name.alias("name"), zero("open_price"), zero("current_price")).filter("name IS NOT NULL")


LEVELS = "ARRAY<STRUCT<price: DOUBLE, volume: BIGINT, ord: BIGINT>>"


def depth(df: DataFrame, column: str = "value") -> DataFrame:
    """The order books of depth responses, a row a symbol and level from 0: price, volume and orders of either side, the volume down to
    the level, and the spread of the level. A side that has fewer levels is null beyond them.
    """
    r = F.from_json(column, f"s STRING, d MAP<STRING, STRUCT<bids: {LEVELS}, ask: {LEVELS}>>")
    books = df.select(F.monotonically_increasing_id().alias("_id"), r.alias("_r")).filter("_r.s = 'ok'").select("_id", F.posexplode("_r.d").alias("_k", "symbol", "b"))
    sides = F.size("b.bids").alias("_bids"), F.size("b.ask").alias("_asks")
    rows = books.select("_id", "_k", "symbol", *sides, F.posexplode(F.arrays_zip(F.col("b.bids").alias("bid"), F.col("b.ask").alias("ask"))).alias("level", "z"))
    down = Window.partitionBy("_id", "_k").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = lambda side: F.when(F.col("level") < F.col(f"_{side}s"), F.sum(F.coalesce(F.col(f"z.{side}.volume"), F.lit(0))).over(down)).alias(f"{side}_upto")
    return rows.select(
        "symbol", "level", F.col("z.bid.price").alias("bid"), F.col("z.bid.volume").alias("bid_volume"), F.col("z.bid.ord").alias("bid_orders"), upto("bid"),
        F.col("z.ask.price").alias("ask"), F.col("z.ask.volume").alias("ask_volume"), F.col("z.ask.ord").alias("ask_orders"), upto("ask"),
        (F.col("z.ask.price") - F.col("z.bid.price")).alias("spread"),
    )


def price_for(book: DataFrame, quantity: int, side: str = "BUY") -> DataFrame:
    """For each symbol of depth() what `quantity` can be traded for: how much of it there is, its mean price, and the worst level's."""
    of, sign = ("ask", 1) if side == "BUY" else ("bid", -1)
    taken = F.greatest(F.lit(0), F.least(F.col(f"{of}_volume"), quantity - (F.col(f"{of}_upto") - F.col(f"{of}_volume"))))
    rows = book.withColumn("_n", F.coalesce(taken, F.lit(0)))
    worst = sign * F.max(F.when(F.col("_n") > 0, sign * F.col(of)))
    out = rows.groupBy("symbol").agg(F.sum("_n").alias("filled"), F.sum(F.col("_n") * F.col(of)).alias("_v"), worst.alias("worst"))
    return out.select("symbol", "filled", F.when(F.col("filled") > 0, F.col("_v") / F.col("filled")).alias("mean_price"), "worst")


def pack_lines(df: DataFrame, group: str, order: str, line: str, limit: int = 3900) -> DataFrame:
    """The lines of each group in messages of at most `limit` characters; a longer line is cut."""
    text = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(line, 1, limit).alias("l"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a, x):
        longer = F.when(a["open"] == "", x["l"]).otherwise(F.concat(a["open"], F.lit("\n"), x["l"]))
        fits = F.length(longer) <= limit
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, longer).otherwise(x["l"]).alias("open"))

    packed = F.aggregate(text, start, add, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda m: m != ""))
    return df.groupBy(group).agg(packed.alias("m")).select(group, F.posexplode("m").alias("message", "text"))
