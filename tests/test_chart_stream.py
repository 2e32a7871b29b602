"""A chart in parts equals the whole."""

import random

import pytest

from marketloom.operators.pnf import columns as P
from marketloom.streaming import chart_stream as L
from tests.test_pnf import bars_of
from tests.test_streams import put, rocksdb, run, stream  # noqa: F401

BARS = "chart_id string, seq long, open double, high double, low double, close double"


@pytest.mark.parametrize("rules", [P.PnfRules("h/l"), P.PnfRules("ohlc", 1, 1.0, "abs")], ids=["frozen", "grid"])
def test_a_chart_in_ten_parts_equals_the_whole(spark, tmp_path, rules):
    rng = random.Random(10)
    rows = [(c, *b[:1], *map(float, b[1:])) for c in ("a", "b") for b in bars_of(rng, 200)]
    span = (min(r[4] for r in rows), max(r[3] for r in rows))
    df = spark.createDataFrame(rows, BARS)
    span_ = None if rules.scaling == "log" else span
    whole = []
    for c in ("a", "b"):
        chart = L.new_chart(c, rules, span_)
        whole += chart.step(df.filter(f"chart_id = '{c}'").orderBy("seq").toPandas())  # without the open column
    parts = [[r for r in rows if k * 20 <= r[1] < k * 20 + 20] for k in range(10)]
    plain = lambda rs: sorted((r[0], r[1], r[2], r[3], r[4], list(r[5]), list(r[6]), list(r[7]), [tuple(s) for s in r[8]]) for r in rs)
    for k, part in enumerate(parts):
        put(spark, part, BARS, tmp_path / "bars", k)
        if k in (3, 9):  # a restart between
            run(L.live_columns(stream(spark, BARS, tmp_path / "bars"), rules, span_), tmp_path / "out", tmp_path / "check")
    assert plain(spark.read.parquet(str(tmp_path / "out")).collect()) == plain(whole) and len(whole) > 10
    # A stored chart goes on in a stream.
    states = L.chart_states(df.filter("seq < 100"), rules, span_)
    for k, part in enumerate(parts[5:]):
        put(spark, part, BARS, tmp_path / "rest", k)
    run(L.live_columns(stream(spark, BARS, tmp_path / "rest"), rules, span_, states), tmp_path / "out2", tmp_path / "check2")
    late = plain(spark.read.parquet(str(tmp_path / "out2")).collect())
    assert late == plain(whole)[0:0] + [x for x in plain(whole) if x in late] and len(late) >= 5
    first = {c: min(x[1] for x in late if x[0] == c) for c in ("a", "b")}
    assert late == [x for x in plain(whole) if x[1] >= first[x[0]]]


def test_grid_charts_need_their_span():
    with pytest.raises(ValueError):
        L.new_chart("a", P.PnfRules(scaling="abs"), None)
