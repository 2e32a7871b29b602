"""Instrument files: symbol masters by exchange and segment, dated caches, constituents of indices and sectors, small states."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.instruments import INSTRUMENT, members, parse_master

#: Columns of a symbol master, all read as text; files have no header and at least 18 of them.
MASTER = ", ".join(f"_c{i} STRING" for i in range(21))


def read_master(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Instruments of symbol files, by keys such as NSE_CM or BSE_FO; `source_file` names the file of each."""
    parts = []
    for key, path in files.items():
        segment = key.rpartition("_")[2].upper()
        if segment not in ("CM", "FO"):
            raise ValueError(f"unsupported exchange: {key!r}")
        parts.append(parse_master(spark.read.schema(MASTER).csv(path), segment).withColumn("source_file", F.lit(key)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{INSTRUMENT}, source_file STRING")


def save_cache(instruments: DataFrame, path: str, as_of: str) -> None:
    """The instruments of a day (YYYYMMDD), as JSON; a day that is saved again is replaced."""
    instruments.withColumn("as_of", F.lit(as_of)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").json(path)


def load_cache(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The instruments saved for a day; rows that cannot be read, or have no kind or symbol, are skipped."""
    df = spark.read.schema(f"{INSTRUMENT}, as_of STRING").option("mode", "PERMISSIVE").json(path)
    return df.filter((F.col("as_of") == as_of) & F.col("kind").isNotNull() & F.col("symbol").isNotNull()).drop("as_of")


def daily(spark: SparkSession, path: str, as_of: str, fetch) -> DataFrame:
    """The day's cache; fetched by fetch() and saved first where there is none."""
    try:
        have = load_cache(spark, path, as_of)
        if have.limit(1).count():
            return have
    except Exception as e:  # no cache was ever saved
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save_cache(fetch(), path, as_of)
    return load_cache(spark, path, as_of)


def read_constituents(spark: SparkSession, files: dict[str, str], fallback: dict[str, list[str]] | None = None) -> DataFrame:
    """sector, symbol of constituent files with a column Symbol; a sector whose file lacks it, or holds none, takes its fallback."""
    parts = []
    for sector, path in files.items():
        try:
            df = spark.read.option("header", True).csv(path)
            rows = members(df, F.lit(sector), F.col("Symbol")) if "Symbol" in df.columns else None
        except Exception as e:  # a file that is not there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = None
        if rows is None or not rows.limit(1).count():
            rows = spark.createDataFrame([(sector, s) for s in (fallback or {}).get(sector, [])], "sector string, symbol string")
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "sector string, symbol string")


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small JSON state, as one row."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    """The state saved at path, or an empty one."""
    try:
        rows = spark.read.text(path).limit(1).collect()
        return json.loads(rows[0][0]) if rows else {}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, ValueError):
            return {}
        raise
