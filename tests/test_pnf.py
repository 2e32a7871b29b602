"""Charts against versions that go box by box over a dense grid."""

import math
import random

import numpy as np
import pytest

from marketloom.functions.folds import once
from marketloom.operators.pnf import cells as K
from marketloom.operators.pnf.columns import METHODS, PnfRules, columns, dated, mean_true_range, scale, title


def bars_of(rng, n, step=3.0):
    out, price = [], 100.0
    for i in range(n):
        o = price
        c = max(20.0, o + rng.choice([-2, -1, -1, 0, 0, 1, 1, 2]) * rng.random() * step)
        if rng.random() < 0.1:
            c = o
        h, l = max(o, c) + rng.choice([0, 0, 1]) * rng.random() * step, max(10.0, min(o, c) - rng.choice([0, 0, 1]) * rng.random() * step)
        out.append((i, *(round(x, 2) for x in (o, h, l, c))))
        price = c
    return out


def drawn(spark, bars, rules, chart="c"):
    df = spark.createDataFrame([(chart, *map(float, b[:0]), b[0], *b[1:]) for b in bars], "chart_id string, seq long, open double, high double, low double, close double")
    return columns(df, rules)


def ohlc_by_force(bars):
    out, was = [], []
    for n, (i, o, h, l, c) in enumerate(bars):
        rising, falling = [o, l, h, c], [o, h, l, c]
        if c > o:
            prices = rising
        elif c < o:
            prices = falling
        elif c == l:
            prices = falling
        elif c == h:
            prices = rising
        elif h + l != 2 * c:
            prices = falling if h + l > 2 * c else rising
        elif n <= 1:
            prices = falling
        elif bars[n - 1][4] == c:
            prices = was
        else:
            prices = falling if bars[n - 1][4] < c else rising
        was = prices
        out += [(i, p) for p in prices]
    return out


def grid_by_force(boxes, bars, rules):
    """Matrix of marks and bars, and the series, one box at a time."""
    r, method = rules.reversal, rules.method
    if method == "ohlc":
        steps = [(i, p, p, p, p) for i, p in ohlc_by_force(bars)]
    elif method == "cl":
        steps = [(i, c, c, c, c) for i, o, h, l, c in bars]
    else:
        steps = [(i, h, l, *((c, c) if method == "hlc" else (h, l))) for i, o, h, l, c in bars]
    high, low = steps[0][1:3]
    over = min(k for k, b in enumerate(boxes) if b >= high)
    over -= boxes[over] != high
    under = max(k for k, b in enumerate(boxes) if b <= low)
    for first in range(1, len(steps)):
        if steps[first][1] >= boxes[over + 1]:
            at, trend = over, 1
            break
        if steps[first][2] <= boxes[under - 1]:
            at, trend = under, -1
            break
    else:
        return {}, []
    column, filled = 0, 1
    mark, series = {(0, at): (trend, steps[0][0])}, [(steps[0][0], boxes[at], 0, trend, 1)]
    for i, h, l, up_test, down_test in steps[first:]:
        climb = trend > 0 and up_test >= boxes[at + 1]
        fall = trend < 0 and down_test <= boxes[at - 1]
        back = down_test <= boxes[at - r] if trend > 0 else up_test >= boxes[at + r]
        old, was = at, filled
        if (climb or fall) and not (method == "l/h" and back):
            while trend > 0 and h >= boxes[at + 1] or trend < 0 and l <= boxes[at - 1]:
                at += trend
                filled += 1
            hit = range(min(old, at), max(old, at) + 1)
        elif back:
            trend = -trend
            while trend > 0 and h >= boxes[at + 1] or trend < 0 and l <= boxes[at - 1]:
                at += trend
            filled = abs(at - old)
            if r == 1 and was == 1:
                filled += 1
            else:
                column += 1
            hit = range(at, old) if trend < 0 else range(old + 1, at + 1)
        else:
            continue
        for b in hit:
            mark[column, b] = (trend, i)
        series.append((i, boxes[at], column, trend, filled))
    return {(c, boxes[b]): v for (c, b), v in mark.items()}, series


@pytest.mark.parametrize("method", list(METHODS))
def test_grid_columns_equal_brute_force(spark, method):
    rng = random.Random(method)
    for scaling, size in (("abs", 2.0), ("log_compounding", 1.5), ("cla", 1.0), ("abs", 0.5)):
        for reversal in (1, 2, 3):
            bars, rules = bars_of(rng, 250), PnfRules(method, reversal, size, scaling)
            low, high = (min(b[4] for b in bars), max(b[4] for b in bars)) if method == "cl" else (min(b[3] for b in bars), max(b[2] for b in bars))
            marks, series = grid_by_force(scale(low, high, rules).tolist(), bars, rules)
            df = drawn(spark, bars, rules)
            got = {(r.column_index, r.box_value): (r.trend, r.action_seq) for r in K.cells(df).collect()}
            assert got == marks and len(marks) > 20, (scaling, reversal)
            # Of several steps in one bar the series keeps the order of the steps.
            assert sorted((r.seq, r.box_value, r.column_index, r.trend, r.filled_boxes) for r in K.time_series(df).collect()) == sorted(series)


def test_scales():
    assert scale(100, 103, PnfRules(scaling="abs", boxsize=2.0), 2).tolist() == [96.0, 98.0, 100.0, 102.0, 104.0, 106.0]
    cla = scale(10, 58, PnfRules(scaling="cla", boxsize=1.0), 1)
    assert cla[0] == 9.8 and {13.6, 14.0, 28.0, 29.0, 58.0} <= set(cla.tolist()) and 13.8 not in cla and 28.5 not in cla and 59.0 not in cla and cla[-1] == 60.0
    log = scale(9, 120, PnfRules(scaling="log_compounding", boxsize=5.0), 1)
    assert all(abs(b / a - 1.05) < 2e-3 for a, b in zip(log, log[1:])) and all(round(x, 2) == x for x in log if x >= 100)


def frozen_by_force(bars, rules):
    """The step-frozen fold in exact fractions."""
    from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

    cent, part = Decimal("0.01"), Decimal(str(rules.boxsize / 100))
    d = lambda x: Decimal(str(x)).quantize(cent, ROUND_HALF_UP)
    values = lambda ref, n: [(ref + (1 if n > 0 else -1) * k * ref * part).quantize(cent, ROUND_HALF_UP) for k in range(1, abs(n) + 1)]
    count = lambda p, ref: int((abs(p - ref) / (ref * part)).to_integral_value(ROUND_FLOOR)) * (1 if p >= ref else -1)
    out, ref = [], None
    for i, *x in bars:
        o, h, l, c = map(d, x)
        prices = {"cl": [c], "h/l": [h, l], "l/h": [l, h], "hlc": [h, l, c], "ohlc": [o, l, h, c] if o <= c else [o, h, l, c]}[rules.method]
        if not out:
            for p in prices:
                if ref is None:
                    ref = p
                elif abs(n := count(p, ref)) >= rules.reversal:
                    out.append([1 if n > 0 else -1, i, values(ref, n)])
                    break
            continue
        trend, _, boxes = out[-1]
        if rules.method == "hlc":
            n = count(c, boxes[-1]) * trend
            prices = [h if trend > 0 else l] if n >= 1 else [l if trend > 0 else h] if -n >= rules.reversal else []
        for p in prices:
            n = count(p, boxes[-1])
            if n * trend >= 1:
                out[-1] = [trend, i, boxes + values(boxes[-1], n)]
                break
            if -n * trend >= rules.reversal:
                out.append([-trend, i, values(boxes[-1], n)])
                break
    return [(t, i, [float(b) for b in boxes]) for t, i, boxes in out]


@pytest.mark.parametrize("method", list(METHODS))
def test_frozen_columns_equal_brute_force(spark, method):
    rng = random.Random(method)
    for reversal, size in ((3, 1.0), (1, 0.5), (2, 1.5)):
        bars, rules = bars_of(rng, 300), PnfRules(method, reversal, size)
        got = [(r.trend, r.end_seq, r.boxes) for r in drawn(spark, bars, rules).orderBy("column_index").collect()]
        assert got == frozen_by_force(bars, rules) and len(got) > 5


def test_chart_input(spark):
    bad = [(0, 5.0, 6.0, 4.0, 7.0)]
    for method, bars in (("hlc", bad), ("ohlc", bad), ("h/l", [(0, 5.0, 4.0, 6.0, 5.0)]), ("cl", [(0, 1.0, 1.0, 1.0, -1.0)])):
        with pytest.raises(Exception, match="must"):
            drawn(spark, bars, PnfRules(method)).count()
    assert title(PnfRules("cl", 3, 1.0, "log")) == "Point & Figure (log|cl) 1.0% x 3" and title(PnfRules(scaling="cla"), "A") == "Point & Figure (cla|cl) 1.0@50 x 3 | A"
    df = spark.createDataFrame([("a", "2024-01-03", 1.0), ("a", "2024-01-02", 2.0), ("b", "2024-01-02 10:00:00", 1.0), ("b", "2024-01-02 09:00:00", 1.0), ("x", "soon", 1.0), ("x", "2024-01-01", 2.0)], "chart_id string, date string, close double")
    got = {(r.chart_id, r.date): (r.seq, r.time_step, r.ts is None) for r in dated(df).collect()}
    assert got["a", "2024-01-02"] == (0, "D", False) and got["a", "2024-01-03"] == (1, "D", False) and got["b", "2024-01-02 10:00:00"] == (1, "m", False)
    assert got["x", "soon"][1:] == (None, True) and {got["x", "soon"][0], got["x", "2024-01-01"][0]} == {0, 1}
    bars = spark.createDataFrame([("a", i, 10.0 + i, 8.0 + i, 9.0 + 2 * i) for i in range(6)], "chart_id string, seq long, high double, low double, close double")
    true = [max(2.0, abs(10.0 + i - (9.0 + 2 * (i - 1))), abs(8.0 + i - (9.0 + 2 * (i - 1)))) for i in range(1, 6)]
    assert mean_true_range(bars).first().atr == pytest.approx(sum(true) / 5) and mean_true_range(bars, 2).first().atr == pytest.approx(sum(true[-2:]) / 2)
    gaps = spark.createDataFrame([("a", i, None if i % 3 == 0 else 100.0 + 9 * (i % 5)) for i in range(40)], "chart_id string, seq long, close double")
    full = gaps.filter("close IS NOT NULL")
    for scaling in ("log", "abs"):
        a, b = (sorted(map(str, columns(x, PnfRules(scaling=scaling)).collect())) for x in (gaps, full))
        assert a == b and a


# Breakouts, signals, lines and counts over a dense matrix.


def matrix_of(spark, rng, rules, n=260, step=4.0):
    cells = K.cells(drawn(spark, bars_of(rng, n, step), rules)).collect()
    m = np.zeros((max(r.box_index for r in cells) + 1, max(r.column_index for r in cells) + 1), int)
    for r in cells:
        m[r.box_index, r.column_index] = r.trend
    return spark.createDataFrame(cells), m, {r.box_index: r.box_value for r in cells}


def breakouts_by_force(m):
    out = []
    for (b, c), t in np.ndenumerate(m):
        if not t or c < 1 or m[b, c - 1] or not 0 <= b - t < len(m):
            continue
        line = m[b - t, : c + 1]
        foes = [k for k in range(c + 1) if line[k] == -t]
        own = [k for k in range(c + 1) if line[k] == t and k > (foes[-1] if foes else -1)]
        if len(own) < 2:
            continue
        left = [k for k in range(c) if m[b, k]]
        z = left[-1] if left else 0
        at, before = m[b, z], m[b, z - 1] if z else 0
        kind = "reversal" if z and not (at == t and before != -t) and not (at == before == -t and t == 1) else "resistance" if z and at == t else "fulcrum" if z else "conti" if at in (0, t) else "reversal"
        outer = own[-1] - z + 1
        for p in range(max(1, len(own) - 1)):
            out.append((t, kind, c, b, len(own) - p, own[-1] - own[p] + 1, outer))
    return sorted(out, key=lambda x: (x[2], x[3], x[4]))


def ends_of(m):
    rows = [np.flatnonzero(m[:, c]) for c in range(m.shape[1])]
    return [int(r[-1]) + 1 for r in rows], [int(r[0]) + 1 for r in rows], [int(np.sign(m[r[0], c])) for c, r in enumerate(rows)]


def signals_by_force(m, reversal=3):
    """Detectors in turn, each over what the ones before have left; tops and bottoms are numbered from 1."""
    hi, lo, tr = ends_of(m)
    n, marks = len(hi), breakouts_by_force(m)
    tall = [h - l + 1 for h, l in zip(hi, lo)]
    out = {}
    span = lambda c, k: (max(hi[max(0, c - k) : c]), min(lo[max(0, c - k) : c]))
    for t, _, c, b, hits, width, _ in marks:
        if width == 3:
            k, i = 1, c - 2
            while i > 0 and abs(tall[i] - tall[i + 1] - 2) <= 1 and abs(hi[i] - hi[i + 1] - 1) <= 1:
                k, i = k + 1, i - 1
            if k > 3:
                out[c] = (14 if t > 0 else 15, b, k, *span(c, k))
    for c in range(1, n - 1):
        if tall[c] / tall[c + 1] > 0.5:
            if tr[c] == 1 and hi[c] > hi[c - 2] + 3:
                out[c + 1] = (21, lo[c + 1], 3, hi[c], lo[c - 1])
            if tr[c] == -1 and lo[c] < lo[c - 2] - 3:
                out[c + 1] = (22, hi[c + 1] - 1, 3, hi[c - 1], lo[c])
    for t, _, c, b, hits, width, _ in marks:
        if (hits, width) == (3, 5) and c + 1 < n and tall[c + 1] >= reversal:
            if t == 1 and hi[c] - hi[c - 2] == 1:
                out[c + 1] = (17, lo[c + 1], 6, *span(c + 1, 5))
            if t == -1 and lo[c - 2] - lo[c] == 1:
                out[c + 1] = (18, hi[c + 1], 6, *span(c + 1, 5))
    for first in (False, True):
        for a, x in zip(marks, marks[1:]):
            if x[4:6] == (2, 3) and a[0] == x[0] and x[2] - a[2] == 2 and (not first or a[4:6] == (3, 5)):
                out[x[2]] = ((10 if first else 8) + (x[0] < 0), x[3], 7 if first else 5, *span(x[2], 6 if first else 4))
    for t, _, c, b, hits, width, _ in marks:
        if (hits, width) == (2, 3):
            own, other = (lo, hi) if t > 0 else (hi, lo)
            i = c - 1
            while i - 2 > 0 and own[i] == own[i - 2] - t and other[i - 1] == other[i - 3] - t:
                i -= 2
            if i < c - 1:
                out[c] = (12, b, c - i + 1, hi[c], lo[i - 2]) if t > 0 else (13, b, c - i + 1, hi[i - 2], lo[c])
    for code, some, more in ((19, [(3, 7), (3, 9)], -1), (4, [(3, 5)], 0), (6, [(4, 7)], 0), (2, [(2, 3)], 0)):
        for t, _, c, b, hits, width, _ in marks:
            if (hits, width) in some and not (code == 2 and c in out):
                top, bottom = span(c, width + more)
                out[c] = (code + (t < 0), b, width, hi[c] if t > 0 else top, lo[c] if t < 0 else bottom)
    for c in range(2, n):
        if c not in out and tr[c] == 1 and hi[c] > hi[c - 2]:
            out[c] = (0, hi[c], 3, hi[c], lo[c - 1])
        elif c not in out and tr[c] == -1 and lo[c] < lo[c - 2]:
            out[c] = (1, lo[c], 3, hi[c - 1], lo[c])
    return out


def test_breakouts_and_signals_equal_brute_force(spark):
    rng, seen, charts = random.Random(31), set(), {}
    for k in range(5):
        bars = bars_of(rng, 700, [4.0, 6.0, 3.0, 2.0, 5.0][k])
        cols = columns(spark.createDataFrame([(str(k), *b) for b in bars], "chart_id string, seq long, open double, high double, low double, close double"), PnfRules("cl", 3, [1.0, 2.0, 1.0, 0.5, 2.0][k], "abs"))
        cells = K.cells(cols).collect()
        m = np.zeros((max(r.box_index for r in cells) + 1, max(r.column_index for r in cells) + 1), int)
        for r in cells:
            m[r.box_index, r.column_index] = r.trend
        charts[str(k)] = cells, m
    c = spark.createDataFrame([r for cells, _ in charts.values() for r in cells])
    s, b = once(K.column_stats(c)), once(K.breakouts(c))
    got, out = b.collect(), K.signals(s, b, cells_=c).collect()
    for k, (_, m) in charts.items():
        mine = sorted(((r.trend, r.type, r.column_index, r.box_index, r.hits, r.width, r.outer_width) for r in got if r.chart_id == k), key=lambda x: (x[2], x[3], x[4]))
        assert mine == breakouts_by_force(m)
        mine = {r.column_index: (r.code, r.box_index, r.width, r.top_index, r.bottom_index) for r in out if r.chart_id == k}
        assert mine == signals_by_force(m)
        seen |= {x[0] for x in mine.values()}
    assert len(seen) >= 10, sorted(seen)


def dense(columns_):
    """Cells of columns (trend, low, high)."""
    m = np.zeros((max(h for _, _, h in columns_) + 1, len(columns_)), int)
    for c, (t, l, h) in enumerate(columns_):
        m[l : h + 1, c] = t
    return m


def cells_of(spark, m, chart="c"):
    rows = [(chart, int(c), float(b + 1), int(b), int(t), int(10 * c)) for (b, c), t in np.ndenumerate(m) if t]
    return spark.createDataFrame(rows, "chart_id string, column_index int, box_value double, box_index int, trend int, action_seq long")


BY_HAND = {
    "Bullish Triangle": [(1, 0, 12), (-1, 1, 11), (1, 2, 10), (-1, 3, 9), (1, 4, 8), (-1, 5, 7), (1, 6, 9)],
    "Bearish Triangle": [(-1, 4, 16), (1, 5, 15), (-1, 6, 14), (1, 7, 13), (-1, 8, 12), (1, 9, 11), (-1, 7, 10)],
    "Bull Trap": [(1, 0, 5), (-1, 2, 4), (1, 3, 5), (-1, 2, 4), (1, 3, 6), (-1, 3, 5)],
    "Bear Trap": [(-1, 4, 9), (1, 5, 7), (-1, 4, 6), (1, 5, 7), (-1, 3, 6), (1, 4, 6)],
    "Bullish Catapult": [(1, 0, 5), (-1, 2, 4), (1, 3, 5), (-1, 2, 4), (1, 3, 8), (-1, 5, 7), (1, 6, 9)],
    "Ascending Triple Top Breakout": [(1, 0, 5), (-1, 3, 4), (1, 4, 7), (-1, 4, 6), (1, 5, 9)],
    "Bullish Signal Reversed": [(1, 8, 15), (-1, 9, 14), (1, 10, 14), (-1, 8, 13), (1, 9, 13), (-1, 7, 12), (1, 8, 12), (-1, 6, 11), (1, 7, 13)],
    "Quadruple Top Breakout": [(1, 0, 5), (-1, 2, 4), (1, 3, 5), (-1, 2, 4), (1, 3, 5), (-1, 2, 4), (1, 3, 6)],
    "Spread Triple Top Breakout": [(1, 0, 5), (-1, 2, 4), (1, 3, 5), (-1, 1, 4), (1, 2, 4), (-1, 1, 3), (1, 2, 6)],
    "High Pole": [(1, 0, 5), (-1, 2, 4), (1, 3, 10), (-1, 4, 9)],
    "Low Pole": [(-1, 6, 12), (1, 7, 10), (-1, 1, 9), (1, 2, 7)],
}


def test_detectors_by_hand(spark):
    ms = {label: dense(x) for label, x in BY_HAND.items()}
    c = cells_of(spark, next(iter(ms.values())), "").filter("chart_id <> ''")
    for label, m in ms.items():
        c = c.unionByName(cells_of(spark, m, label))
    c = once(c)
    out = K.signals(once(K.column_stats(c)), once(K.breakouts(c)), cells_=c).collect()
    for label, m in ms.items():
        mine = {r.column_index: (r.code, r.box_index, r.width, r.top_index, r.bottom_index) for r in out if r.chart_id == label}
        assert mine == signals_by_force(m), label
        assert K.SIGNALS.index(label) in {x[0] for x in mine.values()}, (label, mine)


def lines_by_force(m, least, marks=None):
    """Every line is followed box by box, then the chain is walked over columns."""
    hi, lo, tr = ends_of(m)
    n = m.shape[1]
    cell = lambda b, c: 0 <= b < len(m) and 0 <= c < n and m[b, c] != 0
    line, start = [0] * n, [0] * n
    for c in range(n):
        top, bottom = hi[c] - 1, lo[c] - 1
        if tr[c] == 1 and top > 0 or tr[c] == -1 and bottom > 0:
            sign = -tr[c]
            b, k = (top + 1 if sign < 0 else bottom - 1), c
            start[c] = b
            while k < n + least - 1:
                if marks is None and cell(b, k):
                    break
                if marks is not None and (any(x[0] == 1 and x[2] == k and x[3] >= b for x in marks) if sign < 0 else any(x[0] == -1 and x[2] == k and x[3] < b for x in marks)):
                    break
                b, k = b + sign, k + 1
            line[c] = sign * (k - c) if k - c >= least else 0
    some = [c for c in range(n) if line[c]]
    outer = set()
    if some:
        at, turns = some[0], 0
        outer.add(at)
        while at + abs(line[at]) <= n - 1 and turns <= n:
            turns += 1
            span, sign = abs(line[at]), 1 if line[at] > 0 else -1
            across = {x: abs(line[x]) for x in range(at, at + span) if line[x] * sign < 0}
            for x in sorted(across):
                same = min(y for y in across if across[y] == across[x])
                b = start[same] - (1 if sign < 0 else 0)
                if any(cell(b - sign * j, same + j) for j in range(at + span - same)):
                    del across[x]
            if across:
                reach = {x: x - at + 1 + v for x, v in across.items()}
                if max(reach.values()) > span:
                    at = min(x for x in reach if reach[x] == max(reach.values()))
                    outer.add(at)
                else:
                    for x in range(at + 1, at + span - 1):
                        line[x] = 0
                continue
            at = next((x for x in range(at + span, n) if line[x]), None)
            if at is None:
                break
            outer.add(at)
    out = set()
    for c in range(n):
        size = abs(line[c])
        size -= (least - 1) * (size + c >= n)
        if line[c] and size:
            out.add(("external" if c in outer else "internal", "bullish support" if line[c] > 0 else "bearish resistance", size, c, start[c]))
    return out


def test_trendlines_equal_brute_force(spark):
    rng, kinds = random.Random(32), set()
    for k in range(3):
        rules = PnfRules("cl", [3, 1, 2, 3, 1][k], [1.0, 2.0, 1.0, 3.0, 1.0][k], "abs")
        c, m, _ = matrix_of(spark, rng, rules, 400, [4.0, 5.0, 3.0, 8.0, 3.0][k])
        if rules.reversal == 1:
            m = np.where(m != 0, m, 0)
        s, b = once(K.column_stats(c)), once(K.breakouts(c))
        for least in (4, 6)[: 1 + (k == 0)]:
            for weak in (False, True):
                got = K.weak_trendlines(c, s, b, least) if weak else K.trendlines(c, s, least)
                got = {(r.bounded, r.type, r.length, r.column_index, r.box_index) for r in got.collect()}
                want = lines_by_force(m, least, breakouts_by_force(m) if weak else None)
                assert got == want, (k, least, weak, sorted(got - want)[:5], sorted(want - got)[:5])
                kinds |= {(weak, *x[:2]) for x in got}
    assert len(kinds) >= 7


def counts_by_force(m, value, rules, least=5):
    out = set()
    step = rules.boxsize
    v = lambda b: value[b] if b in value else value[0] + b * step  # noqa: E731  an even scale
    for t, kind, c, b, hits, width, outer in breakouts_by_force(m):
        for w, one in ((width, False), (outer, True)):
            if one != (rules.reversal == 1):
                continue
            part = m[:, c - w + 1 : c + 1] if t > 0 else m[::-1, c - w + 1 : c + 1]  # rows in the breakout's direction
            row = lambda k: k if t > 0 else len(m) - 1 - k
            box = row(b)
            filled = [k for k in range(len(m)) if part[k].any()]
            foot, body = filled[0], part[filled[0] : box]
            share = np.count_nonzero(body) / ((w - 1) * (len(body) - 1) + len(body))
            real = lambda k: v(k if t > 0 else len(m) - 1 - k)

            def add(kind, anchor, length, target, stop1, stop2, column, q):
                reward, r1, r2 = (t * (real(target) - real(box)), t * (real(box) - real(stop1)), t * (real(box) - real(stop2)))
                if kind.startswith("horizontal (base)") and reward < 0:
                    reward = 0.0
                out.add((t, kind, c, b, column, length, round(real(anchor), 6), round(real(target), 6), round(reward, 6), round(r1, 6), round(r2, 6), round(q, 2)))

            second = min(k for k in range(len(m)) if part[k, -2])
            if not one:
                if body[0, 0] == t:
                    n = int(np.count_nonzero(part[:, 0]))
                    add("vertical", foot - 1, n, foot - 1 + n * rules.reversal, second - 1, foot - 1, c - w + 1, share)
                if kind == "reversal" and w >= least:
                    add("horizontal R>1", foot, w, foot + w * rules.reversal, second - 1, foot - 1, c - w + 1 + int(np.flatnonzero(body[0])[-1]), share)
            elif kind == "reversal" and w >= least:
                number = [np.count_nonzero(part[k]) for k in range(len(m))]
                base, own = number.index(max(number)), min(k for k in range(len(m)) if part[k, -1])
                add("horizontal (base) R=1", base, w, base + w, base - 1, foot - 1, c, max(number) / w)
                add("horizontal (signal) R=1", own, w, own + w, own - 1, foot - 1, c, share)
    return out


def test_counts_equal_brute_force(spark):
    rng = random.Random(33)
    for k, (reversal, size) in enumerate([(3, 1.0), (2, 2.0), (1, 1.0), (1, 2.0)]):
        rules = PnfRules("cl", reversal, size, "abs")
        cells = K.cells(drawn(spark, [(i, o + 900, h + 900, l + 900, c + 900) for i, o, h, l, c in bars_of(rng, 300, 4.0)], rules)).collect()
        m = np.zeros((max(r.box_index for r in cells) + 1, max(r.column_index for r in cells) + 1), int)
        for r in cells:
            m[r.box_index, r.column_index] = r.trend
        c, value = spark.createDataFrame(cells), {r.box_index: r.box_value for r in cells}
        s, b = once(K.column_stats(c)), once(K.breakouts(c))
        df = K.base_counts(s, b, c, rules) if reversal == 1 else K.vertical_counts(s, b, c, rules).unionByName(K.horizontal_counts(s, b, c, rules))
        two = lambda x: math.floor(x * 100 + 0.5) / 100
        got = {(r.trend, r.type, r.column_index, r.box_index, r.anchor_column, r.length, round(r.anchor_box, 6), round(r.target, 6), r.reward, r.risk_1, r.risk_2): r.quality for r in df.collect()}
        want = {x[:-1]: x[-1] for x in counts_by_force(m, value, rules)}
        assert set(got) == set(want) and len(want) > 10, (k, sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3])
        assert all(abs(got[x] - want[x]) <= 0.011 for x in want) and two(0.005) == 0.01
        assert K.counts(s, b, c, rules).count() <= df.count()


def test_indicators_equal_brute_force(spark):
    rng = random.Random(34)
    c = K.cells(drawn(spark, bars_of(rng, 400, 4.0), PnfRules("cl", 3, 1.0, "abs")))
    rows = K.column_stats(c).orderBy("column_index").collect()
    mid = [r.midpoint for r in rows]
    want, last = [None] * 4, sum(mid[:5]) / 5
    want.append(last)
    for x in mid[5:]:
        last += (x - last) / 3
        want.append(last)
    got = [r.ema_5 for r in K.ema(K.column_stats(c), 5).orderBy("column_index").collect()]
    assert got[:4] == want[:4] and got[4:] == pytest.approx(want[4:])
    high, low = [r.high_value for r in rows], [r.low_value for r in rows]
    falls = high[0] > high[2]
    sar, ep, flag, acc = (high[0], low[0], -1, 0.02) if falls else (low[0], high[0], 1, 0.02)
    stops = [sar * flag]
    for h, l in zip(high[1:], low[1:]):
        to = sar + acc * (ep - sar)
        sar = ep if (flag > 0 and to > l) or (flag < 0 and to < h) else to
        new = 1 if sar < h else -1 if sar > l else flag
        was, ep = ep, max(ep, h) if new > 0 else min(ep, l)
        acc = 0.02 if new != flag else acc if acc == 0.2 or ep == was else acc + 0.02
        flag = new
        stops.append(sar * flag)
    assert [r.psar for r in K.psar(K.column_stats(c), 0.02, 0.2).orderBy("column_index").collect()] == pytest.approx(stops)
    assert all(r.psar is None for r in K.psar(K.column_stats(c).filter("column_index < 2"), 0.02, 0.2).collect())


def test_text_chart_and_series_prices(spark):
    m = dense([(1, 0, 3), (-1, 1, 2), (1, 2, 4)])
    c = cells_of(spark, m)
    assert [r.text for r in K.render(c, 3).orderBy("line").collect()] == [". . X", "X . X", "X O X", "X O .", "X . ."]
    bars = [(i, p, p, p, p) for i, p in enumerate([100.0, 105.0, 101.0, 106.0, 108.0])]
    cols = drawn(spark, bars, PnfRules("cl", 3, 1.0, "abs"))
    cells = K.cells(cols)
    out = K.multiple_prices(K.time_series(cols), cells, K.breakouts(cells), 2, 1).collect()
    assert [(r.column_index, r.seq, r.price) for r in out] == [(2, 3, 106.0)]


def text_by_force(m, lines, columns):
    """The text chart of a dense grid with its outer lines."""
    shown = np.array([["." if x == 0 else "X" if x > 0 else "O" for x in row] for row in m], object)
    for bounded, kind, length, c, r in lines:
        for k in range(length if bounded == "external" else 0):
            at = r + k if kind == "bullish support" else r - k
            if c + k < m.shape[1] and 0 <= at < m.shape[0] and m[at, c + k] == 0:
                shown[at, c + k] = "*"
    n = min(columns, m.shape[1])
    pad = ". " * (columns - n)
    return [pad + " ".join(shown[r, -n:]) for r in range(m.shape[0] - 1, -1, -1) if m[r, -n:].any()]


def test_text_charts_show_outer_lines(spark):
    rng, stars = random.Random(41), 0
    for columns_ in (200, 12, 30):
        c, m, _ = matrix_of(spark, rng, PnfRules("cl", 3, 1.0, "abs"), 300, 5.0)
        lines = once(K.trendlines(c, once(K.column_stats(c)), 4))
        got = [r.text for r in K.render(c, columns_, lines).orderBy("line").collect()]
        assert got == text_by_force(m, [(r.bounded, r.type, r.length, r.column_index, r.box_index) for r in lines.collect()], columns_)
        stars += sum(t.count("*") for t in got)
    assert stars > 10


def test_breakouts_shuffle_cells_once_in_groups_of_rows(spark):
    rng = random.Random(41)
    cells = once(K.cells(drawn(spark, bars_of(rng, 500, 4.0), PnfRules("h/l", 2, 1.0, "abs"))))
    rows = cells.collect()
    m = np.zeros((max(r.box_index for r in rows) + 1, max(r.column_index for r in rows) + 1), int)
    for r in rows:
        m[r.box_index, r.column_index] = r.trend
    want = breakouts_by_force(m)
    for size in (1, 40, 2**20):
        df = K.breakouts(cells, size=size)
        assert sorted((r.trend, r.type, r.column_index, r.box_index, r.hits, r.width, r.outer_width) for r in df.collect()) == sorted(want) and len(want) > 50, size
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_breakouts_of_some_hits_are_those_of_all(spark):
    rng = random.Random(43)
    cells = once(K.cells(drawn(spark, bars_of(rng, 500, 4.0), PnfRules("h/l", 2, 1.0, "abs"))))
    every = K.breakouts(cells).collect()
    for n in (2, 3):
        assert sorted(K.breakouts(cells, hits=n).collect()) == sorted(r for r in every if r.hits == n) != []
    outer = {(r.column_index, r.box_index): max(x.hits for x in every if (x.column_index, x.box_index) == (r.column_index, r.box_index)) for r in every}
    assert sorted(K.breakouts(cells, inner=False).collect()) == sorted(r for r in every if r.hits == outer[r.column_index, r.box_index])


def long_pattern(spark, trend):
    """A chart of 80,000 columns and one breakout over all of them."""
    n, top = 80_000, 100_000
    low = [(7 * i) % 50 + (0 if i == 0 else 3) for i in range(n)]
    spans = [(low[i], top - i % 11 - 20 * (i != n - 1)) for i in range(n)]
    spans = spans if trend == 1 else [(top - h, top - l) for l, h in spans]
    stats = spark.createDataFrame([("c", i, h, l, 9, trend if i % 2 == 0 else -trend) for i, (l, h) in enumerate(spans)], "chart_id string, column_index int, high int, low int, height int, trend int")
    box = top - 40 if trend == 1 else 40
    marks = spark.createDataFrame([("c", trend, "reversal", n - 1, box, 2, n, 9, 1)], K.MARK)
    cells = spark.createDataFrame([("c", 0, r, 100.0 + r / 1000) for r in range(top + 1)], "chart_id string, column_index int, box_index int, box_value double")
    foot = np.array([l if trend == 1 else -h for l, h in spans])
    head = np.array([h if trend == 1 else -l for l, h in spans])
    h = trend * box - int(foot.min())
    quality = int(np.maximum(0, np.minimum(head, trend * box - 1) - foot + 1).sum()) / ((n - 1) * (h - 1) + h)
    return stats, marks, cells, n, foot, round(quality, 2)


@pytest.mark.parametrize("trend", [1, -1])
def test_horizontal_counts_of_long_patterns(spark, trend):
    stats, marks, cells, n, foot, quality = long_pattern(spark, trend)
    (r,) = K.horizontal_counts(stats, marks, cells, PnfRules()).collect()
    assert r.quality == quality and r.length == n and r.anchor_column == int(np.flatnonzero(foot == foot.min())[-1])
    assert r.target == (math.inf if trend == 1 else 0.0) and r.reward == (math.inf if trend == 1 else round(r.box, 6))


def test_least_rows_and_filled_rows_between_columns():
    rng = np.random.default_rng(5)
    for n in (1, 31, 64, 700):
        foot = rng.integers(-40, 40, n)
        head, first, last, row = foot + rng.integers(0, 30, n), rng.integers(0, n, 300), rng.integers(0, n, 300), rng.integers(-60, 90, 300)
        first, last = np.minimum(first, last), np.maximum(first, last)
        assert K.least_between(foot, first, last).tolist() == [foot[a : b + 1].min() for a, b in zip(first, last)]
        to = np.where(np.arange(300) % 7 == 0, -1, last)
        assert K.filled_below(foot, head, to, row).tolist() == [int(np.maximum(0, np.minimum(head[: b + 1], r - 1) - foot[: b + 1] + 1).sum()) for b, r in zip(to, row)]


@pytest.mark.parametrize("trend", [1, -1])
def test_vertical_counts_of_long_patterns(spark, trend):
    from pyspark.sql import functions as F

    stats, marks, cells, n, foot, quality = long_pattern(spark, trend)
    (r,) = K.vertical_counts(stats, marks, cells, PnfRules()).collect()
    assert foot[0] == foot.min() and (r.quality, r.length, r.anchor_column) == (quality, 9, 0)
    assert "_filled" in K._patterns(stats, marks, "width", begins=True).columns and not K._patterns(stats.withColumn("trend", -F.col("trend")), marks, "width", begins=True).count()


def test_risk_of_counts_that_reach_beyond_all_numbers(spark):
    """A query over both counts averages rewards; those of the longest patterns are infinite, as in SQL."""
    from pyspark.sql import functions as F

    stats, marks, cells, *_ = long_pattern(spark, 1)
    both = K.vertical_counts(stats, marks, cells, PnfRules()).unionByName(K.horizontal_counts(stats, marks, cells, PnfRules()))
    got = {r.type: r.reward for r in both.groupBy("type").agg(F.round(F.avg("reward"), 1).alias("reward")).collect()}
    assert got["horizontal R>1"] == math.inf and math.isfinite(got["vertical"])


def test_lines_meet_boxes_in_runs_of_any_size(spark):
    rng = random.Random(47)
    c = once(K.cells(drawn(spark, bars_of(rng, 500, 4.0), PnfRules("h/l", 2, 1.0, "abs"))))
    s = once(K.column_stats(c))
    from pyspark.sql import functions as F

    lines = s.select("chart_id", "column_index", F.when(F.col("trend") == -1, 1).otherwise(-1).alias("sign"), F.when(F.col("trend") == 1, F.col("high") + 1).otherwise(F.col("low") - 1).alias("start"))
    boxes = {(r.column_index, r.box_index) for r in c.collect()}
    n = max(c for c, _ in boxes) + 1
    want = {}
    for r in lines.collect():
        meets = [next((k for k in range(r.column_index + 1, n) if (k, r.start - low + r.sign * (k - r.column_index)) in boxes), None) for low in (0, int(r.sign > 0))]
        if any(k is not None for k in meets):
            want[r.column_index] = tuple(meets)
    for size in (1, 60, 2**20, 2**40):
        df = K._met(c, s, lines, size)
        assert {r.column_index: (r.stop, r.touch) for r in df.collect()} == want and len(want) > 20, size


def test_rendering_looks_at_the_shown_columns_alone(spark):
    from pyspark.sql import functions as F

    c = once(K.cells(drawn(spark, bars_of(random.Random(48), 400, 4.0), PnfRules("h/l", 2, 1.0, "abs"))))
    last = c.agg(F.max("column_index")).first()[0]
    lines = spark.createDataFrame([("c", "external", "bullish support", 10**9, 0, 0), ("c", "external", "bearish resistance", 10, last - 3, 8)], K.LINE)
    df = K.render(c, 5, lines)  # a line of a thousand million steps: only those within five columns are made
    short = K.render(c, 5, lines.filter("length = 10")).collect()
    assert sorted(df.collect()) == sorted(short) and any("*" in r.text for r in short)


def test_follow_ups_sort_only_columns_that_can_follow(spark):
    rng = random.Random(53)
    marks = {}
    for _ in range(700):
        c, b = rng.randrange(900), rng.randrange(4)
        h = rng.choice([2, 2, 3])
        marks["c", c, b, h] = (rng.choice([1, -1]), rng.choice([3, 5]))
    ordered, want = sorted(marks), []
    for was, at in zip(ordered, ordered[1:]):
        (t0, w0), (t, w) = marks[was], marks[at]
        if t == t0 and at[1] - was[1] == 2 and (at[3], w) == (2, 3):
            want.append((at[1], 8 if t == 1 else 9, at[2], 5, 2))
            want += [(at[1], 10 if t == 1 else 11, at[2], 7, 2)] if (was[3], w0) == (3, 5) else []
    df = K.follow_ups(spark.createDataFrame([(c, t, "conti", k, b, h, w, 1, 0) for (c, k, b, h), (t, w) in marks.items()], K.MARK))
    assert sorted(tuple(r)[1:] for r in df.collect()) == sorted(want) and len(want) > 10
    assert "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()
