"""Buckets anchored to the trading session in Indian time, as column expressions over epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indian time is ahead of UTC by so many seconds; sessions open at 09:15, commodities at 09:00, and end at 15:30.
IST, OPEN, OPEN_MCX, CLOSE, DAY = 19_800, 33_300, 32_400, 55_800, 86_400


def epoch(ts) -> Column:
    """Whole seconds of a timestamp, one without a zone being UTC."""
    return F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def plain_bucket(e: Column, seconds: int) -> Column:
    return e - F.pmod(e, F.lit(seconds))


def session_anchor(e: Column, symbol: Column) -> Column:
    """The session's opening on the Indian day of e."""
    local = e + IST
    opens = F.when(symbol.startswith("MCX:"), OPEN_MCX).otherwise(OPEN)
    return local - F.pmod(local, F.lit(DAY)) + opens - IST


def session_bucket(e: Column, symbol: Column, seconds: int) -> Column:
    """Start of the bucket of e; what comes before the opening belongs to the first bucket of its day."""
    anchor = session_anchor(e, symbol)
    return anchor + F.floor(F.greatest(e - anchor, F.lit(0)) / seconds) * seconds


def market_hours(e: Column, utc: bool = False) -> Column:
    """Whether e falls between opening and close, both included; by UTC clock if asked for."""
    return F.pmod(e if utc else e + IST, F.lit(DAY)).between(OPEN, CLOSE)


def ist_text(e: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(e), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss")


def completed_end(now: Column, symbol: Column, seconds: int) -> Column:
    """The last second that completed bars cover: at most the close, and the second before the opening while no bar is complete."""
    anchor = session_anchor(now, symbol)
    done = session_bucket(now, symbol, seconds) - 1
    return F.when(now < anchor + seconds, anchor - 1).otherwise(F.least(done, anchor + (CLOSE - OPEN)))


# Seconds of the resolutions that histories come in.
RESOLUTIONS = {
    "5S": 5, "10S": 10, "15S": 15, "30S": 30, "45S": 45, "1": 60, "2": 120, "3": 180, "5": 300, "10": 600, "15": 900, "20": 1200, "30": 1800,
    "45": 2700, "60": 3600, "120": 7200, "180": 10_800, "240": 14_400, "D": 86_400, "1D": 86_400, "1W": 604_800, "1M": 2_592_000,
}


def resolution_seconds(name: str) -> int:
    try:
        return RESOLUTIONS[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown resolution: {name!r}") from None


def chunk_days(name: str) -> int:
    """How many days one request for a resolution may span."""
    seconds = resolution_seconds(name)
    return 30 if seconds < 60 else 100 if seconds < DAY else 366
