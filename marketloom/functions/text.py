"""Casts that never fail, code tables and symbol formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of exchanges and segments in instrument files.
EXCHANGES = {"10": "NSE", "12": "BSE"}
SEGMENTS = {"10": "CM", "11": "FO"}


def to_double(c: Column) -> Column:
    """0 for what is blank or no number."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("double"), F.lit(0.0))


def to_long(c: Column) -> Column:
    """As to_double, cut to a whole number."""
    return to_double(c).cast("bigint")


def mapped(c: Column, table: dict) -> Column:
    """The code's name, or the code itself where it has none."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], c)


def to_broker(symbol: Column) -> Column:
    return F.concat(F.lit("NSE:"), F.upper(F.trim(symbol)), F.lit("-EQ"))


def from_broker(symbol: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(symbol), "^NSE:", ""), "-EQ$", "")


def plain(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def epoch_seconds(c: Column) -> Column:
    """Epochs above 9,999,999,999 are milliseconds."""
    return F.when(c > 9_999_999_999, F.floor(c / 1000)).otherwise(c).cast("bigint")
