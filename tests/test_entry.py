import duckdb
import pytest

import __spark_entry__ as entry

FAST = ["ohlc_session_1h", "rollup_lenient", "gap_ranges", "trades_reverse", "sl_tp_exit", "gap_backfill", "pnf_counts_vertical", "expiry_calendar", "atm_pair", "strike_ladder", "pnf_cells", "pnf_breakouts", "depth_levels", "depth_price", "symbol_search", "minute_from_5s", "repair_minutes"]


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]}) _q")
    assert mine == sorted(str(tuple(r)) for r in cur.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
