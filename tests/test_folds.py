"""Ordered folds against plain readings of their rules."""

import datetime as dt
import math
from statistics import median

import numpy as np
import pytest

from tapeloom.operators import folds
from tapeloom.plans import charts, registry

DATA = "/root/testdata/sf0.001"


def test_state_goes_on_over_batches(spark):
    class Count:
        def __init__(self):
            self.seen = []

        def add(self, t, v):
            assert not self.seen or self.seen[-1] <= t
            self.seen.append(t)
            if v % 1000 == 0:
                yield len(self.seen), float(v)

        def end(self):
            return [(len(self.seen), -1.0)]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(5000).selectExpr("if(id % 50 = 0, id % 3, 7) k", "(id * 7919) % 5000 t", "id v").repartition(6)
        got = sorted(map(tuple, folds.ordered_fold(df, "k", ["t"], ["t", "v"], lambda _: Count(), "k long, n int, v double").collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = {}
    for i in range(5000):
        rows.setdefault(i % 3 if i % 50 == 0 else 7, []).append(((i * 7919) % 5000, i))
    want = []
    for k, r in rows.items():
        want += [(k, n, float(v)) for n, (_, v) in enumerate(sorted(r), 1) if v % 1000 == 0] + [(k, len(r), -1.0)]
    assert got == sorted(want)
    assert folds.ordered_fold(df.limit(0), "k", ["t"], ["t", "v"], lambda _: Count(), "k long, n int, v double").count() == 0


def plain_boxes(rows, step, reversal, log, most=25_000):
    """Box by box, as the rule reads."""
    f = (lambda p: math.log(max(p, 1e-6))) if log else float
    opened, high, low, close = rows[0]
    up = close >= opened
    at = math.ceil(f(high) / step) * step if up else math.floor(f(low) / step) * step
    out, column = [(0, up, at)], 0
    for _, high, low, _ in rows[1:]:
        high, low = f(high), f(low)
        top, bottom = math.floor(high / step) * step, math.ceil(low / step) * step
        if up and high >= at + step:
            moves = [(column, True, top)]
        elif up and low <= at - reversal * step and at - bottom >= step:
            moves = [(column + 1, False, bottom)]
        elif not up and low <= at - step:
            moves = [(column, False, bottom)]
        elif not up and high >= at + reversal * step and top - at >= step:
            moves = [(column + 1, True, top)]
        else:
            moves = []
        for column, up, to in moves:
            while (at < to if up else at > to) and len(out) < most:
                at += step if up else -step
                out.append((column, up, at))
    return [(c, u, math.exp(p) if log else p) for c, u, p in out[:most]]


def bars(seed, n, spread=0.05):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(size=n) * spread))
    opened = close * np.exp(rng.normal(size=n) * spread)
    high, low = np.maximum(close, opened) * (1 + rng.random(n) * spread), np.minimum(close, opened) * (1 - rng.random(n) * spread)
    return [tuple(map(float, r)) for r in zip(opened, high, low, close)]


@pytest.mark.parametrize("log", [False, True])
@pytest.mark.parametrize("most", [25_000, 20])
def test_point_figure(log, most):
    for seed in range(8):
        rows = bars(seed, 200)
        step = math.log(1.05) if log else 1.5
        chart, got = folds.PointFigure(3, log, most), []
        for r in rows:
            got += chart.add(step, *r)
        got += chart.end()
        flat = [(c, u, p) for c, u, levels in got for p in levels]
        assert flat == plain_boxes(rows, step, 3, log, most) and len(flat) > 15


def plain_zone(highs, lows):
    best, n = (0, 0, 0), len(highs)
    for start in range(n - 2):
        top, bottom, end = highs[start], lows[start], start + 1
        while end < n and highs[end] >= bottom and lows[end] <= top:
            top, bottom, end = max(top, highs[end]), min(bottom, lows[end]), end + 1
        if end - start > best[0]:
            best = (end - start, start, end)
    return (float(median(lows[best[1] : best[2]])), float(median(highs[best[1] : best[2]]))) if best[0] >= 3 else (0.0, 0.0)


def test_charts_of_the_bars(spark):
    q = registry.queries()
    spans = [tuple(r) for r in charts._spans(spark, DATA).select("code", "number", "high", "low", "boxes", "step").collect()]
    zones = {r.code: r for r in q["e49_congestion"](spark, DATA).collect()}
    signals = {r.code: r.signal for r in q["j23_breakouts"](spark, DATA).collect()}
    for code in {s[0] for s in spans}:
        own = sorted(s[1:] for s in spans if s[0] == code)
        highs, lows, step = [s[1] for s in own], [s[2] for s in own], own[0][4]
        low, high = plain_zone(highs, lows) if len(own) >= 5 and sum(s[3] for s in own) >= 10 else (0.0, 0.0)
        assert np.allclose((zones[code].zone_low, zones[code].zone_high), (low, high), atol=1e-5)
        assert signals[code] == plain_breakout(highs, lows, step)


def plain_breakout(highs, lows, step):
    n = len(highs)
    if n < 12:
        return "none"
    pairs = [(i, j) for i in range(n - min(n, 15), n) for j in range(i + 3, n - 1)]
    late = lambda j: range(max(j + 1, n - 4), n)
    if any(abs(highs[i] - highs[j]) <= step * 0.3 and any(highs[k] > max(highs[i], highs[j]) + step * 2 for k in late(j)) for i, j in pairs):
        return "double_top_buy"
    if any(abs(lows[i] - lows[j]) <= step * 0.3 and any(lows[k] < min(lows[i], lows[j]) - step * 2 for k in late(j)) for i, j in pairs):
        return "double_bottom_sell"
    return "none"


def test_breakouts_match_all_pairs(spark):
    rng = np.random.default_rng(6)
    charts_, rows = {}, []
    for code in range(120):
        n = int(rng.integers(8, 40))
        low = rng.integers(0, 12, n) * 0.5
        high = low + rng.integers(1, 9, n) * 0.5
        charts_[code] = list(high), list(low)
        rows += [(code, i, float(h), float(l), 1.0) for i, (h, l) in enumerate(zip(high, low))]
    found = charts.breakouts(spark.createDataFrame(rows, "code long, number int, high double, low double, step double"))
    got = {r.code: r.signal for r in found.collect()}
    assert got == {c: plain_breakout(h, l, 1.0) for c, (h, l) in charts_.items()} and len(set(got.values())) == 3
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in text and "Cartesian" not in text


def plain_strokes(rows, gap=4):
    """All merged bars first, then all turning points, then strokes."""
    merged, rising = [], True
    for date, high, low in rows:
        if merged and (high >= merged[-1][0] and low <= merged[-1][1] or high <= merged[-1][0] and low >= merged[-1][1]):
            h, l, hd, ld = merged[-1]
            if rising:
                merged[-1] = (max(h, high), max(l, low), date if high > h else hd, date if low > l else ld)
            else:
                merged[-1] = (min(h, high), min(l, low), date if high < h else hd, date if low < l else ld)
            continue
        if merged:
            rising = high > merged[-1][0]
        merged.append((high, low, date, date))
    turns = []
    for i in range(1, len(merged) - 1):
        (h0, l0, *_), (h1, l1, hd, ld), (h2, l2, *_) = merged[i - 1 : i + 2]
        if h1 > max(h0, h2):
            turns.append((i, hd, h1, True))
        elif l1 < min(l0, l2):
            turns.append((i, ld, l1, False))
    points = []
    for t in turns:
        if not points:
            points.append(t)
        elif t[3] == points[-1][3]:
            if (t[2] > points[-1][2]) == t[3] and t[2] != points[-1][2]:
                points[-1] = t
        elif t[0] - points[-1][0] >= gap and (t[2] > points[-1][2]) == t[3] and t[2] != points[-1][2]:
            points.append(t)
    return [(a[1], a[2], b[1], b[2], b[3]) for a, b in zip(points, points[1:])]


def test_strokes():
    seen = 0
    for seed in range(40):
        rng = np.random.default_rng(seed)
        mid = np.cumsum(rng.integers(-3, 4, 150)) + 100
        rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), float(m + rng.integers(0, 4)), float(m - rng.integers(0, 4))) for i, m in enumerate(mid)]
        fold, got = folds.Strokes(), []
        for r in rows:
            got += fold.add(*r)
        got += fold.end()
        assert got == plain_strokes(rows)
        seen += len(got)
    assert seen > 100
    empty = folds.Strokes()
    assert not list(empty.add(dt.date(2000, 1, 1), 2.0, 1.0)) and not list(empty.add(dt.date(2000, 1, 2), 2.0, 1.0)) and not list(empty.end())


def test_rows_of_a_code_stay_together_over_a_bucketed_table(spark):
    from tapeloom.sources import market as m

    class Each:
        def add(self, date):
            yield (date,)

        def end(self):
            return ()

    got = [tuple(r) for r in folds.ordered_fold(m.bars(spark, DATA), "code", ["date"], ["date"], lambda _: Each(), "code long, date date").collect()]
    assert all(a[0] != b[0] or a[1] < b[1] for a, b in zip(got, got[1:])) and len({c for c, _ in got}) == sum(a[0] != b[0] for a, b in zip(got, got[1:])) + 1


def test_strokes_of_the_bars(spark):
    from tapeloom.sources import market as m

    rows = [tuple(r) for r in m.bars(spark, DATA).where(charts._valid()).select("code", "date", "high", "low").collect()]
    got = sorted(map(tuple, registry.queries()["e61_strokes"](spark, DATA).collect()))
    want = [(c, *s) for c in {r[0] for r in rows} for s in plain_strokes(sorted(r[1:] for r in rows if r[0] == c))]
    assert got == sorted(want) and got


def test_stroke_summary_follows_the_strokes(spark):
    strokes = {}
    for r in registry.queries()["e61_strokes"](spark, DATA).collect():
        strokes.setdefault(r.code, []).append(r)
    for r in registry.queries()["e61_stroke_summary"](spark, DATA).collect():
        own = sorted(strokes.get(r.code, []), key=lambda s: s.end)
        assert r.strokes == len(own) and r.bars >= 10
        if own:
            last = own[-1]
            assert (r.direction, r.end, r.price) == (1 if last.up else -1, last.end, last.end_price)
            assert r.held_above == (len(own) > 2 and not last.up and last.end_price > own[-3].start_price)
        else:
            assert (r.direction, r.end, r.held_above) == (0, None, False)


def test_boxes_of_the_bars(spark):
    from tapeloom.sources import market as m

    rows = {}
    for r in m.bars(spark, DATA).orderBy("date").collect():
        rows.setdefault(r.code, []).append((r.open, r.high, r.low, r.close))
    got = {}
    for r in registry.queries()["e48_point_and_figure"](spark, DATA).collect():
        got.setdefault(r.code, []).append((r.number, r.box, r.up, r.level))
    for code, own in rows.items():
        want = plain_boxes(own, math.log(1 + charts.SIZE), charts.REVERSAL, True)
        have = sorted(got[code])
        assert [(n, u) for n, _, u, _ in have] == [(n, u) for n, u, _ in want] and np.allclose([p for *_, p in have], [p for *_, p in want])


def test_charts_take_a_code_once(spark):
    """Boxes need no exchange and no join over the written bars; breakouts read only the charts' ends again."""
    text = registry.queries()["e48_point_and_figure"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text
    ends = {tuple(r) for r in charts._spans(spark, DATA, charts.WITHIN).collect()}
    whole = charts._spans(spark, DATA).collect()
    last = {c: max(r.number for r in whole if r.code == c) for c in {r.code for r in whole}}
    assert ends == {tuple(r) for r in whole if r.number > last[r.code] - charts.WITHIN} and len(ends) < len(whole)
    assert "MapInArrow" not in registry.queries()["j23_breakouts"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
