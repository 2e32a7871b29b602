"""Instruments: symbol files, expiry calendars, option chains, subscription plans and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.text import EXCHANGES, SEGMENTS, mapped, plain, to_double, to_long

# Index names with the spot symbol, the exchange of their options and the step of their strikes.
INDICES = [
    ("NIFTY", "NSE:NIFTY50-INDEX", "NSE", 50), ("BANKNIFTY", "NSE:NIFTYBANK-INDEX", "NSE", 100), ("FINNIFTY", "NSE:FINNIFTY-INDEX", "NSE", 50),
    ("MIDCPNIFTY", "NSE:MIDCPNIFTY-INDEX", "NSE", 25), ("SENSEX", "BSE:SENSEX-INDEX", "BSE", 100), ("BANKEX", "BSE:BANKEX-INDEX", "BSE", 100),
]


def parse_master(rows: DataFrame, segment: str) -> DataFrame:
    """Instruments of header-less symbol files: columns _c0, _c1, ... as CSV gives them. segment: CM (cash) or FO (derivatives).

    Rows of fewer than 18 columns, or without a ticker, are left out; numbers that cannot be read are 0.
    """
    if segment not in ("CM", "FO"):
        raise ValueError(f"unsupported segment: {segment!r}")
    if len(rows.columns) < 18:
        return rows.sparkSession.createDataFrame([], INSTRUMENT)
    c = [F.col(x) for x in rows.columns]
    text = lambda i: F.trim(F.coalesce(c[i], F.lit("")))
    df = rows.filter(c[17].isNotNull() & (text(9) != ""))
    option = F.upper(text(16)).isin("CE", "PE")
    if segment == "CM":
        kind = F.when(text(9).endswith("-INDEX"), "index_spot").otherwise("equity")
    else:
        kind = F.when(option, "option").otherwise("future")
    own = segment == "FO"
    only = lambda e, kind_: e.cast(kind_) if own else F.lit(None).cast(kind_)
    return df.select(
        kind.alias("kind"), text(9).alias("symbol"), text(1).alias("display_name"), mapped(text(10), EXCHANGES).alias("exchange_code"), mapped(text(11), SEGMENTS).alias("segment_code"),
        text(0).alias("token"), text(2).alias("short_symbol"), to_long(c[3]).cast("int").alias("lot_size"), to_double(c[4]).alias("tick_size"), text(5).alias("isin"),
        only(text(14), "string").alias("underlying_symbol"), only(to_long(c[8]), "bigint").alias("expiry_epoch"),
        F.when(F.lit(own) & option, to_double(c[15])).alias("strike"), F.when(F.lit(own) & option, F.upper(text(16))).alias("option_type"),
    )


INSTRUMENT = (
    "kind STRING, symbol STRING, display_name STRING, exchange_code STRING, segment_code STRING, token STRING, short_symbol STRING, lot_size INT, tick_size DOUBLE, isin STRING, "
    "underlying_symbol STRING, expiry_epoch BIGINT, strike DOUBLE, option_type STRING"
)


def search(instruments: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The first `limit` instruments by symbol whose symbol or name holds the query, in either case; none for a blank query."""
    q = query.strip().lower()
    hit = F.lower("symbol").contains(q) | F.lower("display_name").contains(q)
    return instruments.filter(hit if q else F.lit(False)).orderBy("symbol").limit(limit)


def of_underlying(instruments: DataFrame, name: str) -> DataFrame:
    """Instruments whose symbol, name or underlying holds the name, by letters and digits alone."""
    q = plain(F.lit(name))
    holds = lambda c: F.coalesce(plain(F.col(c)).contains(q), F.lit(False))
    return instruments.filter((q != "") & (holds("symbol") | holds("display_name") | holds("underlying_symbol")))


def expiries(options: DataFrame) -> DataFrame:
    """Distinct expiries of each underlying with their rank, whether they are the last of their month, and their rank among such."""
    days = options.filter("expiry_epoch > 0").select("underlying_symbol", "expiry_epoch").distinct()
    month = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("expiry_epoch"), "Asia/Kolkata"), "yyyy-MM")
    last = F.max("expiry_epoch").over(Window.partitionBy("underlying_symbol", "_m"))
    df = days.withColumn("_m", month).withColumn("is_monthly", F.col("expiry_epoch") == last)
    by = Window.partitionBy("underlying_symbol").orderBy("expiry_epoch")
    alike = Window.partitionBy("underlying_symbol", "is_monthly").orderBy("expiry_epoch")
    return df.select("underlying_symbol", "expiry_epoch", "is_monthly", F.row_number().over(by).alias("nth"), F.row_number().over(alike).alias("nth_of_kind"))


def nearest_expiry(options: DataFrame, now: int) -> DataFrame:
    """The first expiry on or after the Indian day of now, or the earliest of all."""
    today = now + 19_800 - (now + 19_800) % 86_400 - 19_800
    e = F.col("expiry_epoch")
    return options.filter(e > 0).groupBy("underlying_symbol").agg(F.coalesce(F.min(F.when(e >= today, e)), F.min(e)).alias("expiry_epoch"))


def chain(options: DataFrame, monthly: bool, nth: int, option_type: str | None = None) -> DataFrame:
    """Options of each underlying's nth weekly or monthly expiry."""
    chosen = expiries(options).filter((F.col("is_monthly") == monthly) & (F.col("nth_of_kind") == nth)).select("underlying_symbol", "expiry_epoch")
    df = options.join(chosen, ["underlying_symbol", "expiry_epoch"], "left_semi")
    return df.filter(F.col("option_type") == option_type) if option_type else df


def atm(options: DataFrame, spots: DataFrame) -> DataFrame:
    """For each underlying and expiry the strike nearest to its spot; of two as near the lower."""
    df = options.filter("strike > 0").join(spots.select("underlying_symbol", "spot"), "underlying_symbol")
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")
    return df.groupBy("underlying_symbol", "expiry_epoch").agg(F.min_by("strike", near).alias("atm_strike"))


def atm_pair(options: DataFrame, spots: DataFrame) -> DataFrame:
    """The call and the put at that strike."""
    at = options.join(atm(options, spots), ["underlying_symbol", "expiry_epoch"]).filter("strike = atm_strike")
    of = lambda t: F.min(F.when(F.col("option_type") == t, F.col("symbol")))
    return at.groupBy("underlying_symbol", "expiry_epoch", "atm_strike").agg(of("CE").alias("ce_symbol"), of("PE").alias("pe_symbol"))


def near_money(options: DataFrame, spots: DataFrame, option_type: str, side: str, k: int = 5) -> DataFrame:
    """The k options of a type next to the money of each underlying and expiry, out of it (OTM) or in it (ITM)."""
    above = (option_type == "CE") == (side == "OTM")
    df = options.filter(F.col("option_type") == option_type).join(atm(options, spots), ["underlying_symbol", "expiry_epoch"])
    df = df.filter(F.col("strike") > F.col("atm_strike") if above else F.col("strike") < F.col("atm_strike"))
    order = F.asc("strike") if above else F.desc("strike")
    rank = F.row_number().over(Window.partitionBy("underlying_symbol", "expiry_epoch").orderBy(order, "symbol"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def for_strikes(options: DataFrame, strikes: DataFrame, expiry_epoch: int | None = None) -> DataFrame:
    """Options at the strikes of their underlying, of one expiry or of all."""
    options = options if expiry_epoch is None else options.filter(F.col("expiry_epoch") == expiry_epoch)
    return options.join(strikes.select("underlying_symbol", "strike").distinct(), ["underlying_symbol", "strike"], "left_semi")


def strike_ladder(opens: DataFrame, n: int) -> DataFrame:
    """Strikes (name, step, open_price, current_price) from n steps below the open's to n above it, widened to the current one."""
    floor = lambda p: (F.floor(p / F.col("step")) * F.col("step")).cast("bigint")
    low, high = floor(F.col("open_price")) - F.col("step") * n, floor(F.col("open_price")) + F.col("step") * n
    now = floor(F.col("current_price"))
    return opens.select("name", F.explode(F.sequence(F.least(low, now), F.greatest(high, now), F.col("step").cast("bigint"))).alias("strike"))


def with_index(df: DataFrame, name: str = "name") -> DataFrame:
    """df with the spot symbol, option exchange and strike step of the index it names; names that are none have nulls."""
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s).alias("spot_symbol"), F.lit(e).alias("option_exchange"), F.lit(k).alias("step")) for n, s, e, k in INDICES])
    found = F.get(F.filter(table, lambda x: x["n"] == F.upper(F.trim(F.col(name)))), F.lit(0))
    return df.withColumns({c: found[c] for c in ("spot_symbol", "option_exchange", "step")})


def strikes_of(options: DataFrame, expiry_epoch: int | None = None) -> DataFrame:
    """Different strikes of each underlying, of one expiry or of all."""
    df = options if expiry_epoch is None else options.filter(F.col("expiry_epoch") == expiry_epoch)
    return df.filter("strike IS NOT NULL").select("underlying_symbol", "strike").distinct()


def expansion(subscribed: DataFrame, quotes: DataFrame, n: int) -> DataFrame:
    """New strikes of each name whose current strike has left the subscribed range: n steps around it, those not yet subscribed.

    A name's subscribed strikes meet its quote as one array, by a merge join: the planner can't tell how many strikes a ladder gives, and would
    broadcast them all.
    """
    now = (F.floor(F.col("current_price") / F.col("step")) * F.col("step")).cast("bigint")
    have = subscribed.groupBy("name").agg(F.min("strike").alias("_lo"), F.max("strike").alias("_hi"), F.collect_set("strike").alias("_had"))
    left = quotes.withColumn("_now", now).hint("merge").join(have.hint("merge"), "name").filter((F.col("_now") < F.col("_lo")) | (F.col("_now") > F.col("_hi")))
    step = F.col("step").cast("bigint")
    around = F.sequence(F.col("_now") - step * n, F.col("_now") + step * n, step)
    return left.select("name", F.explode(F.filter(around, lambda x: ~F.array_contains("_had", x))).alias("strike"))


def members(constituents: DataFrame, sector: Column, symbol: Column) -> DataFrame:
    """sector, symbol: trimmed, without blanks and repeats."""
    s = F.trim(symbol)
    return constituents.select(sector.alias("sector"), s.alias("symbol")).filter("symbol IS NOT NULL AND symbol <> ''").distinct()
