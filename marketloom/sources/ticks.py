"""Ticks: parsing, validity, and views of the test tables as ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.timebucket import epoch

FIELDS = ["ltp", "prev_close_price", "ch", "chp", "high_price", "low_price", "open_price"]
MESSAGE = "symbol STRING, " + ", ".join(f"{f} DOUBLE" for f in FIELDS) + ", exch_feed_time BIGINT, type STRING"


def parse(messages: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as ticks; what is missing becomes 0 or empty."""
    m = F.from_json(column, MESSAGE)
    df = messages.withColumn("_m", m)
    text = lambda f: F.coalesce(F.col(f"_m.{f}"), F.lit("")).alias(f)
    number = lambda f, zero: F.coalesce(F.col(f"_m.{f}"), F.lit(zero)).alias(f)
    rest = [c for c in messages.columns if c != column]
    return df.select(*rest, text("symbol"), *[number(f, 0.0) for f in FIELDS], number("exch_feed_time", 0).cast("bigint").alias("exch_feed_time"), text("type"))


def valid(symbol: Column, e: Column, price: Column) -> Column:
    return (F.trim(F.coalesce(symbol, F.lit(""))) != "") & (e > 0) & (price > 0)


def from_events(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """symbol, e, ltp, seq: the valid ticks of the events table."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.select(F.col(symbol).cast("string").alias("symbol"), epoch("ts").alias("e"), F.col("value").alias("ltp"), F.col("event_id").alias("seq"))
    return df.filter(valid(F.col("symbol"), F.col("e"), F.col("ltp")))


def latest(ticks: DataFrame) -> DataFrame:
    """The last tick of each symbol, by arrival."""
    return ticks.groupBy("symbol").agg(F.max_by("ltp", "seq").alias("ltp"), F.max_by("e", "seq").alias("e"), F.max("seq").alias("seq"))
