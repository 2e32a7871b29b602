"""Candles from ticks and from candles, and the rules that keep their sequence whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from marketloom.functions.timebucket import session_bucket

KEY = ["symbol", "bucket_epoch"]


def ohlc(ticks: DataFrame, bucket: Column) -> DataFrame:
    """One candle a symbol and bucket: first and last by arrival, volume the number of ticks. Aggregates are pre-combined before the shuffle."""
    return ticks.groupBy("symbol", bucket.alias("bucket_epoch")).agg(
        F.min_by("ltp", "seq").alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", "seq").alias("close"), F.count("*").alias("volume")
    )


def session_ohlc(ticks: DataFrame, seconds: int) -> DataFrame:
    return ohlc(ticks, session_bucket(F.col("e"), F.col("symbol"), seconds))


def without_partial_first(candles: DataFrame, ticks: DataFrame) -> DataFrame:
    """Drops a symbol's first candle if its first tick came after the bucket's start."""
    first = ticks.groupBy("symbol").agg(F.min_by("e", "seq").alias("_first"))
    least = Window.partitionBy("symbol")
    df = candles.join(first, "symbol").withColumn("_least", F.min("bucket_epoch").over(least))
    return df.filter((F.col("bucket_epoch") != F.col("_least")) | (F.col("_first") <= F.col("bucket_epoch"))).drop("_first", "_least")


def rollup(candles: DataFrame, source: int, target: int, strict: bool = True) -> DataFrame:
    """Candles of `target` seconds; strict: only where every source bucket is there."""
    bucket = session_bucket(F.col("bucket_epoch"), F.col("symbol"), target)
    out = candles.groupBy("symbol", bucket.alias("_b")).agg(
        F.min_by("open", "bucket_epoch").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket_epoch").alias("close"),
        F.sum("volume").alias("volume"), F.count_distinct("bucket_epoch").alias("_n"),
    )
    return (out.filter(F.col("_n") == target // source) if strict else out).drop("_n").withColumnRenamed("_b", "bucket_epoch")


def minute_from_5s(candles: DataFrame) -> DataFrame:
    """Minutes of exactly twelve aligned 5 s buckets; volume 0."""
    b = F.col("bucket_epoch")
    out = candles.filter(F.pmod(b, F.lit(5)) == 0).groupBy("symbol", (b - F.pmod(b, F.lit(60))).alias("minute")).agg(
        F.min_by("open", "bucket_epoch").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket_epoch").alias("close"),
        F.count_distinct("bucket_epoch").alias("_n"),
    )
    return out.filter("_n = 12").select("symbol", F.col("minute").alias("bucket_epoch"), "open", "high", "low", "close", F.lit(0).cast("bigint").alias("volume"))


def repaired_minutes(five: DataFrame, one: DataFrame, lo: int, hi: int) -> DataFrame:
    """Minutes of [lo, hi] that the 5 s candles can build and the 1 min candles lack."""
    wanted = five.filter((F.col("bucket_epoch") >= lo) & (F.col("bucket_epoch") < hi + 60))
    return minute_from_5s(wanted).join(one.select(KEY), KEY, "left_anti")


def gaps(candles: DataFrame, seconds: int, same_day: bool = True) -> DataFrame:
    """symbol, gap_from, gap_to, missing: runs of buckets that lie between two candles, of one Indian day if asked for."""
    w = Window.partitionBy("symbol").orderBy("bucket_epoch")
    day = lambda c: F.floor((c + 19_800) / 86_400)
    b, p = F.col("bucket_epoch"), F.col("_p")
    df = candles.select("symbol", "bucket_epoch", F.lag("bucket_epoch").over(w).alias("_p")).filter(b - p > seconds)
    df = df.filter(day(b) == day(p)) if same_day else df
    return df.select("symbol", (p + seconds).alias("gap_from"), (b - seconds).alias("gap_to"), F.expr(f"(bucket_epoch - _p) DIV {seconds} - 1").alias("missing"))


def missing_buckets(candles: DataFrame, seconds: int) -> DataFrame:
    """Each missing bucket between two candles of a symbol and day."""
    return gaps(candles, seconds).select("symbol", F.explode(F.sequence("gap_from", "gap_to", F.lit(seconds))).alias("bucket_epoch"))


def expected_missing(candles: DataFrame, symbols: DataFrame, lo: int, hi: int, seconds: int) -> DataFrame:
    """Buckets of [lo, hi] that symbols lack."""
    expected = symbols.select("symbol", F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"), F.lit(seconds))).alias("bucket_epoch"))
    return expected.join(candles.select(KEY), KEY, "left_anti")


def contiguous_prefix(candles: DataFrame, seconds: int, most: int = 500) -> DataFrame:
    """The unbroken run from each symbol's first candle, of it the newest `most`."""
    w = Window.partitionBy("symbol").orderBy("bucket_epoch")
    broken = F.coalesce((F.col("bucket_epoch") - F.lag("bucket_epoch").over(w) != seconds).cast("int"), F.lit(0))
    df = candles.withColumn("_b", broken).withColumn("_b", F.sum("_b").over(w)).filter("_b = 0").drop("_b")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bucket_epoch")))
    return df.withColumn("_k", rank).filter(F.col("_k") <= most).drop("_k")


def closed(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows of a candle file as closed candles, as streams give them: of `seconds`, complete, without volume."""
    price = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return rows.select("symbol", F.col("bucket_epoch").cast("bigint").alias("bucket_epoch"), F.lit(seconds).alias("timeframe_seconds"), *price, F.lit(0).cast("bigint").alias("volume"), F.lit(True).alias("is_complete"))


def backfilled(candles: DataFrame, history: DataFrame, seconds: int) -> DataFrame:
    """candles and, `filled`, the history's (symbol, timestamp, prices) for gaps that it can close: all of a gap's buckets, or none of them.

    A history's repeated rows count once, the last by its own order being unknown the one of the greatest prices.
    """
    fields = ["open", "high", "low", "close", "volume"]
    wanted = gaps(candles, seconds).select("symbol", "gap_from", "missing", F.explode(F.sequence("gap_from", "gap_to", F.lit(seconds))).alias("bucket_epoch"))
    have = history.groupBy("symbol", F.col("timestamp").alias("bucket_epoch")).agg(F.max(F.struct(*fields)).alias("_h"))
    met = wanted.join(have, KEY)
    whole = met.groupBy("symbol", "gap_from").agg(F.count("*").alias("_n"), F.first("missing").alias("missing")).filter("_n = missing").select("symbol", "gap_from")
    rows = met.join(whole, ["symbol", "gap_from"], "left_semi").select(*KEY, "_h.*")
    return candles.select(*KEY, *fields).withColumn("filled", F.lit(False)).unionByName(rows.withColumn("filled", F.lit(True)))


def counted(rows: DataFrame, name: str, **counts: Column):
    """rows, observed, and what they are observed by: how many there are and how many hold each of `counts`, known when rows were computed."""
    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), watch


def last_bucket(candles: DataFrame) -> DataFrame:
    return candles.groupBy("symbol").agg(F.max("bucket_epoch").alias("last_bucket"), F.count("*").alias("n"))


def quality_flags(ticks: DataFrame, seconds: int, bucket: Column, gap: int = 2, outages: DataFrame | None = None) -> DataFrame:
    """Candles with first and last tick time and why they are partial: opened late, ticks further apart than `gap` seconds, or, first of all,
    an outage (reason, from_epoch, to_epoch, and symbol, null for all symbols) that touches the bucket. Outages are few."""
    w = Window.partitionBy("symbol", "bucket_epoch").orderBy("seq")
    df = ticks.withColumn("bucket_epoch", bucket).withColumn("_g", F.col("e") - F.lag("e").over(w))
    out = df.groupBy(KEY).agg(F.min("e").alias("first_tick"), F.max("e").alias("last_tick"), F.max("_g").alias("widest"), F.count("*").alias("volume"))
    reason = F.when(F.col("first_tick") - F.col("bucket_epoch") > gap, "late_start").when(F.col("widest") > gap, "tick_gap")
    if outages is not None:
        o = F.broadcast(outages.select(F.col("symbol").alias("_s"), F.col("reason").alias("_why"), F.col("from_epoch").alias("_a"), F.col("to_epoch").alias("_z")))
        touched = (F.col("_s").isNull() | (F.col("_s") == F.col("symbol"))) & (F.col("_a") < F.col("bucket_epoch") + seconds) & (F.col("_z") >= F.col("bucket_epoch"))
        out = out.join(o, touched, "left").groupBy(*[c for c in out.columns]).agg(F.min_by("_why", "_a").alias("_why"))
        reason = F.coalesce(F.col("_why"), reason)
    out = out.withColumn("partial_reason", F.coalesce(reason, F.lit(""))).withColumn("is_partial", F.col("partial_reason") != "").drop("widest")
    return out.drop("_why")


def reconcile(candles: DataFrame, history: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each symbol: matched buckets, those whose prices differ, and whether candles lack the symbol."""
    c, h = candles.alias("c"), history.alias("h")
    both = c.join(h, (F.col("c.symbol") == F.col("h.symbol")) & (F.col("c.bucket_epoch") == F.col("h.timestamp")))
    differ = F.col("c.open") != F.col("h.open")
    for f in ("high", "low", "close"):
        differ = differ | (F.col(f"c.{f}") != F.col(f"h.{f}"))
    counts = both.groupBy(F.col("c.symbol").alias("symbol")).agg(F.count("*").alias("matched"), F.count_if(differ).alias("mismatched"))
    have = candles.select("symbol").distinct().withColumn("_have", F.lit(True))
    out = symbols.select("symbol").distinct().join(counts, "symbol", "left").join(have, "symbol", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("symbol", zero("matched"), zero("mismatched"), F.when(F.col("_have"), "ok").otherwise("missing").alias("status"))
