"""Charts that are folded by runs of bars equal those that one task folds."""

import random

import numpy as np
import pandas as pd
import pytest

from marketloom.operators.pnf import columns as P
from marketloom.operators.pnf import parallel as Q
from tests.test_pnf import bars_of

NAMES = "chart_id string, seq long, open double, high double, low double, close double"


def charts(rng, n_charts, n_bars, step):
    rows = []
    for c in range(n_charts):
        bars = bars_of(rng, n_bars, step)
        if c % 2:
            bars = [(s, *map(round, x)) for s, *x in bars]  # ties, and bars that close where they open
        rows += [(f"c{c}", 7 * s + c, *map(float, x)) for s, *x in bars]
    rows += [("one", 5, 10.0, 11.0, 9.0, 10.0), ("flat", 1, 10.0, 10.0, 10.0, 10.0), ("flat", 900, 10.0, 10.0, 10.0, 10.0), ("none", 1, None, None, None, None)]
    return [r if rng.random() > 0.01 else (*r[:2], None, *r[3:]) for r in rows]


def same(spark, rows, rules, run):
    df = spark.createDataFrame(rows, NAMES).repartition(3)
    one, many = ([tuple(r) for r in P.columns(df, rules, run=k).orderBy("chart_id", "column_index").collect()] for k in (None, run))
    assert one == many
    return one


@pytest.mark.parametrize("method", list(P.METHODS))
def test_grid_runs_equal_one_task(spark, method):
    rng = random.Random(method)
    for scaling, reversal, size, step, run in (("abs", 3, 1.0, 3, 25), ("log_compounding", 1, 1.0, 3, 7), ("atr", 2, 1.0, 1, 40)):
        rows = [r for r in charts(rng, 4, 260, step) if scaling != "atr" or r[0] != "flat"]  # it has no range
        got = same(spark, rows, P.PnfRules(method, reversal, size, scaling), run)
        assert len(got) > 20


@pytest.mark.parametrize("method", list(P.METHODS))
def test_frozen_runs_equal_one_task(spark, method):
    rng = random.Random(method)
    rows = [r for r in charts(rng, 4, 260, 0.3) if None not in r]
    assert len(same(spark, rows, P.PnfRules(method, 2, 0.5), 50)) > 8


def test_no_bars(spark):
    for rules in (P.PnfRules(), P.PnfRules("ohlc", scaling="abs")):
        assert same(spark, [("none", 1, None, None, None, None)], rules, 10) == []
        assert P.columns(spark.createDataFrame([], NAMES), rules, run=10).count() == 0


def test_quiet_bars_never_act():
    rng = random.Random(8)
    for _ in range(400):
        rules = P.PnfRules(rng.choice(list(P.METHODS)), rng.choice([1, 2, 3]), rng.choice([0.25, 1, 5]))
        scale = rng.choice([0.05, 1, 40])
        bars = [(s, *(max(0.01, round(x * scale, 2)) for x in b)) for s, *b in bars_of(rng, rng.randrange(1, 150), rng.choice([0.02, 0.2, 1, 5]))]
        rows = pd.DataFrame([("c", s, o, max(o, h, l, c), min(o, h, l, c), c) for s, o, h, l, c in bars], columns=["chart_id", "seq", "open", "high", "low", "close"])
        whole = P.FrozenChart("c", rules)
        want, kept, step = whole.step(rows) + whole.end(), [], rng.choice([1, 10, 60, 200])
        for a in range(0, len(rows), step):
            quiet = Q.Quiet(rules, list(rows.columns[1:]))
            quiet.step(rows.iloc[a : a + step])
            kept += quiet.end()
        rest = P.FrozenChart("c", rules)
        assert rest.step(pd.DataFrame(kept, columns=rows.columns)) + rest.end() == want


def test_calm_charts_lose_most_bars():
    rng = np.random.default_rng(4)
    close = np.round(100 + np.cumsum(rng.normal(0, 0.01, 20_000)), 2)
    quiet = Q.Quiet(P.PnfRules(), ["seq", "close"])
    quiet.step(pd.DataFrame({"chart_id": "c", "seq": np.arange(20_000), "close": close}))
    assert len(quiet.end()) < 4000


def test_functions_hold_few_states():
    """Whatever the number of bars, a run's function has a few rows, and lanes meet."""
    rng = np.random.default_rng(5)
    grid, rules = np.arange(0, 400, 1.0), P.PnfRules("cl", 3, 1.0, "abs")
    turns = Q.Turns(rules, grid)
    price = 200 + np.cumsum(rng.normal(0, 0.5, 5000))
    table = Q.function(turns, turns.of(*[price] * 4), turns.base(100.0, 100.0))
    assert len(table) < 40 and len({f[3:5] for f in table}) == 1
