"""Power law fits: planted parameters, a finer grid, windows and consensus."""

import numpy as np
import pytest

from tapeloom.operators import bubbles as lp


def planted(n, ahead, m, w, noise=0.0, seed=0):
    x = lp.design(n, np.array([[n - 1 + ahead, m, w]]))[0]
    return x @ np.array([5.0, -0.4, 0.03, -0.02]) + noise * np.random.default_rng(seed).normal(size=n)


@pytest.mark.parametrize("ahead, m, w", [(12.3, 0.45, 8.7), (40.0, 0.7, 11.2), (5.5, 0.3, 6.9)])
def test_planted_parameters_are_found(ahead, m, w):
    out = lp.fit(planted(150, ahead, m, w)[None])[0]
    assert abs(out[9] - ahead) < 0.05 * ahead and abs(out[1] - m) < 0.03 and abs(out[2] - w) < 0.1
    assert out[7] < 1e-4 and out[8] > 0.9999 and abs(out[3] - 5) < 0.1 and out[4] < 0


def test_no_worse_than_a_fine_grid():
    rng = np.random.default_rng(1)
    y = np.stack([planted(90, rng.uniform(2, 60), rng.uniform(0.2, 0.8), rng.uniform(6.5, 12.5), 0.01, k) for k in range(3)] + [np.cumsum(rng.normal(size=90)) * 0.02 for _ in range(3)])
    got = lp.fit(y)
    low, high = lp._bounds(90)
    fine = np.stack(np.meshgrid(np.linspace(low[0], high[0], 60), np.linspace(*lp.M, 12), np.linspace(*lp.W, 30), indexing="ij"), axis=-1).reshape(-1, 3)
    for series, row in zip(y, got):
        sse = min(lp.residual(np.repeat((series - series.mean())[None], len(p), axis=0), p).min() for p in np.array_split(fine, 30))
        assert row[7] ** 2 * 90 <= sse * (1 + 1e-9)
        assert lp.M[0] <= row[1] <= lp.M[1] and lp.W[0] <= row[2] <= lp.W[1] and 1 <= row[9] <= 100


def test_noise_takes_few_designs(monkeypatch):
    """Noise has many flat valleys: a fit stays no worse than any point of a grid, after some hundred designs, not thousands."""
    seen, plain = [], lp._projected
    monkeypatch.setattr(lp, "_projected", lambda y, p: (seen.append(len(p)), plain(y, p))[1])
    y = np.log(np.random.default_rng(5).uniform(900, 2000, size=(6, 120)))
    got = lp.fit(y)
    assert sum(seen) <= 400 * len(y)
    points, _ = lp._grid(120)
    for series, row in zip(y, got):
        centred = series - series.mean()
        sse = min(lp.residual(np.repeat(centred[None], len(p), axis=0), p).min() for p in np.array_split(points, 10))
        assert row[7] ** 2 * 120 <= sse * (1 + 1e-9)


def test_curvatures_are_those_of_what_is_left():
    """Slopes and whole curvatures against differences, so that steps near a valley's floor are Newton's."""
    rng = np.random.default_rng(6)
    y = rng.normal(size=(5, 40))
    y -= y.mean(axis=1, keepdims=True)
    p = np.column_stack([39 + rng.uniform(5, 60, 5), rng.uniform(0.2, 0.8, 5), rng.uniform(6.5, 12.5, 5)])
    left, slope, plain, whole = lp._projected(y, p)
    assert np.allclose(left, lp.residual(y[:, None], p[:, None])[:, 0], rtol=1e-9)
    for i, h in enumerate((1e-3, 1e-5, 1e-4)):
        step = h * np.eye(3)[i]
        (up, up_slope, *_), (down, down_slope, *_) = lp._projected(y, p + step), lp._projected(y, p - step)
        assert np.allclose(slope[:, i], -(up - down) / (4 * h), rtol=1e-4, atol=1e-6)
        assert np.allclose(whole[:, i], -(up_slope - down_slope) / (2 * h), rtol=1e-3, atol=1e-3 * np.abs(whole[:, i]).max())
    assert (np.linalg.eigvalsh(plain) > -1e-9).all() and (np.linalg.eigvalsh(whole)[:, 0] < 0).any()


def test_noise_takes_as_few_designs_as_newton_needs(monkeypatch):
    seen, plain = [], lp._projected
    monkeypatch.setattr(lp, "_projected", lambda y, p: (seen.append(len(p)), plain(y, p))[1])
    for n in (60, 180):
        seen.clear()
        y = np.log(np.random.default_rng(7).uniform(900, 2000, size=(20, n)))
        lp.fit(y)
        assert sum(seen) <= 100 * len(y)


def test_windows_read_a_code_once(spark):
    """A code's bars are gathered once and cut, not gathered again for each bar."""
    bars = spark.createDataFrame([("a", i, 1.0 + i) for i in range(10)], "code string, date int, close double")
    w = lp.windows(bars, [2, 4], step=3)
    assert "Window" not in w._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.date, r.at, r.length, r.prices) for r in w.collect())
    assert got == [(e, e + 1, n, [1.0 + i for i in range(e - n + 1, e + 1)]) for e in (3, 6, 9) for n in (2, 4)]


def test_windows_and_their_fits(spark):
    closes = np.exp(planted(100, 20, 0.5, 8, 0.01))
    rows = [("a", int(i), float(c)) for i, c in enumerate(closes)] + [("b", i, 1.0) for i in range(30)] + [("a", 1000, 0.0)]
    bars = spark.createDataFrame(rows, "code string, date int, close double").repartition(3)
    w = lp.windows(bars, [30, 60], step=10, last=3)
    assert sorted((r.code, r.date, r.length, len(r.prices)) for r in w.collect()) == sorted([*(("a", e, n, n) for e in (79, 89, 99) for n in (30, 60)), ("b", 29, 30, 30)])
    fits = {(r.code, r.date, r.length): r for r in lp.fitted(w).collect()}
    want = lp.fit(np.log(closes[30:90])[None])[0]
    assert np.allclose([fits["a", 89, 60][c] for c in ("tc", "m", "w", "rmse")], want[[0, 1, 2, 7]])
    assert fits["b", 29, 30].r2 == 0  # flat
    assert lp.fitted(w.limit(0)).count() == 0


def test_consensus(spark):
    rows = [("a", 1, 0.5, 8.0, -1.0, 0.5, 0.9, 10.0), ("a", 1, 0.5, 8.0, 1.0, 0.5, 0.8, 20.0), ("a", 1, 0.1, 8.0, -1.0, 0.5, 0.9, 1.0), ("b", 1, 0.5, 8.0, -1.0, 0.5, 0.4, 5.0)]
    got = lp.consensus(spark.createDataFrame(rows, "code string, date int, m double, w double, b double, c double, r2 double, days double"), 3).collect()
    (r,) = got
    assert (r.code, r.valid_windows, r.days, r.days_spread, r.positive, r.rebound_days) == ("a", 2, 15.0, 5.0, 0.5, 20.0)
    assert np.isclose(r.consensus, 2 / 3) and np.isclose(r.strength, 2 / 3 / 6)


def test_queries_follow_the_fits(spark):
    from tapeloom.plans import bubbles, registry
    from tapeloom.sources import market as m

    data = "/root/testdata/sf0.001"
    closes = {}
    for r in m.bars(spark, data).orderBy("date").collect():
        closes.setdefault(r.code, []).append((r.date, r.close))
    last = {r.code: r for r in registry.queries()["e16_power_law_fit"](spark, data).collect()}
    best = {(r.code, r.date): r for r in registry.queries()["e19_best_windows"](spark, data).collect()}
    agreed = {(r.code, r.date): r for r in registry.queries()["e20_window_consensus"](spark, data).collect()}
    assert set(last) == set(closes)
    for code in sorted(closes)[:3]:
        x = np.log([c for _, c in closes[code]])
        fit = lp.fit(x[-120:][None])[0]
        assert np.allclose([last[code].m, last[code].w, last[code].rmse, last[code].days], fit[[1, 2, 7, 9]], atol=1e-5)
        for back in (0, 20, 80):
            end = len(x) - back
            fits = {n: lp.fit(x[end - n : end][None])[0] for n in bubbles.LENGTHS}
            row, date = best[code, closes[code][end - 1][0]], closes[code][end - 1][0]
            n = min(fits, key=lambda n: (fits[n][7], n))
            assert row.length == n and abs(row.rmse - fits[n][7]) < 1e-5
            valid = [f for f in fits.values() if f[8] > 0.05 and lp.M[0] < f[1] < lp.M[1] and lp.W[0] < f[2] < lp.W[1]]
            assert ((code, date) in agreed) == bool(valid)
            if valid:
                assert agreed[code, date].valid_windows == len(valid) and abs(agreed[code, date].days - np.median([f[9] for f in valid])) < 1e-6
