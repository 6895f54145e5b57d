"""Symmetric cross-validation, bootstraps, long-run t and Chow tests against plain numpy."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import resample as rs


def panel(spark, x):
    rows = [(f"s{j}", i, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(rows, "strategy string, t int, x double")


def plain_splits(x, slices, free=0.025, year=252.0):
    parts = np.array_split(np.arange(len(x)), slices)

    def sharpe(rows):
        v = np.maximum(rows.var(axis=0, ddof=1), 1e-12)
        return np.sqrt(year) * (rows.mean(axis=0) - free / year) / np.sqrt(v)

    out = []
    for c in combinations(range(slices), slices // 2):
        inside = np.concatenate([parts[i] for i in c])
        outside = np.concatenate([parts[i] for i in range(slices) if i not in c])
        a, b = sharpe(x[inside]), sharpe(x[outside])
        k = int(a.argmax())
        out.append((sum(1 << i for i in c), k, a[k], b[k], (b <= b[k]).sum() / (x.shape[1] + 1)))
    return np.array(out)


@pytest.mark.parametrize("slices, days", [(8, 83), (16, 64)])
def test_overfitting(spark, slices, days):
    x = np.random.default_rng(slices).normal(size=(days, 5)) * 0.01
    x[x > 0.02] = 0
    want = plain_splits(x, slices)
    splits = rs.symmetric_splits(panel(spark, x), slices)
    got = np.array(sorted((r.id, int(r.strategy[1:]), r.best_in, r.best_out, r["rank"]) for r in splits.collect()))
    assert np.allclose(got, want[want[:, 0].argsort()], atol=1e-7)
    one = rs.overfitting(splits).first()
    assert one.splits == len(want) and np.isclose(one.pbo, (want[:, 4] <= 0.5).mean())
    beta, alpha = np.polyfit(want[:, 2], want[:, 3], 1)
    assert np.isclose(one.beta, beta) and np.isclose(one.alpha, alpha) and np.isclose(one.median_logit, np.median(np.log(want[:, 4] / (1 - want[:, 4]))))


def draw(*of, below):
    return int(hashlib.md5(":".join(map(str, of)).encode()).hexdigest()[:8], 16) % below


def test_moving_blocks(spark):
    x = np.random.default_rng(1).normal(size=47)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("a", 99, None), ("short", 0, 1.0), ("short", 1, float("nan"))]
    df = spark.createDataFrame(rows, "key string, t int, x double")
    found = [sorted(map(tuple, rs.moving_block_interval(df.repartition(n), 5, 200, seed=7).collect())) for n in (1, 6)]
    assert all(a[0] == b[0] and np.allclose(np.array(a[1:], float), np.array(b[1:], float), rtol=1e-12, equal_nan=True) for a, b in zip(*found))
    means = [np.concatenate([x[s : s + 5] for s in (draw(7, "a", d, j, below=43) for j in range(10))])[:47].mean() for d in range(200)]
    (key, n, mean, low, high), short = found[0]
    assert (key, n) == ("a", 47) and np.allclose((mean, low, high), (x.mean(), *np.quantile(means, [0.025, 0.975])))
    assert short == ("short", 1, 1.0, None, None)


def test_moving_blocks_cover_the_mean(spark):
    x = np.random.default_rng(8).normal(size=(60, 100)) + 1
    df = spark.createDataFrame([(f"k{i:02}", t, float(v)) for i, r in enumerate(x) for t, v in enumerate(r)], "key string, t int, x double")
    got = rs.moving_block_interval(df, 5, 300).collect()
    assert 0.75 <= np.mean([r.low <= 1 <= r.high for r in got]) <= 1


def test_fixed_blocks(spark):
    rng = np.random.default_rng(2)
    series = {"up": rng.normal(size=22) + 3, "none": rng.normal(size=9), "three": np.array([1.0, -2.0, 3.0]), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "key string, t int, x double").repartition(5)
    got = {r.key: r for r in rs.fixed_block_interval(df, 300, seed=3).collect()}
    for k, x in series.items():
        if len(x) < 3:
            assert tuple(got[k])[1:] == (2, 0.0, 0.0, 1.0, False)
            continue
        size = max(1, len(x) // 4)
        blocks = -(-len(x) // size)
        m = np.array([np.concatenate([x[b * size : (b + 1) * size] for b in (draw(3, k, d, j, below=blocks) for j in range(blocks))])[: len(x)].mean() for d in range(300)])
        low, high = np.percentile(m, [2.5, 97.5])
        zero = (m <= 0).mean() if x.mean() > 0 else (m >= 0).mean()
        assert np.allclose((got[k].low, got[k].high, got[k].p), (low, high, min(1, 2 * zero))) and got[k].significant == (low > 0 or high < 0)


def test_long_run_t(spark):
    rng = np.random.default_rng(3)
    series = {"a": np.cumsum(rng.normal(size=120)) * 0.1 + 1, "flat": np.full(30, 0.5), "few": rng.normal(size=9)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "key string, t int, x double").repartition(4)
    got = {r.key: r for r in rs.long_run_t(df, 5).collect()}
    x = series["a"]
    e, lags = x - x.mean(), max(4, int(4 * (120 / 100) ** (2 / 9)))
    v = ((e**2).mean() + sum(2 * (1 - i / (lags + 1)) * (e[i:] * e[:-i]).mean() for i in range(1, lags + 1))) / 120
    assert got["a"].lags == lags and np.isclose(got["a"].t, x.mean() / np.sqrt(v))
    assert got["flat"].t == 0 and (got["few"].mean, got["few"].t) == (0, 0)


def rest(y, x):
    z = np.column_stack([np.ones(len(x)), x])
    return ((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum()


def test_chow(spark):
    rng = np.random.default_rng(4)
    series = {}
    for code in range(3):
        x = rng.normal(size=80) * 100 + 1000
        y = 2 + 0.5 * x + rng.normal(size=80)
        if code:
            y[50:] += 0.4 * (x[50:] - 900) * (code - 1) + 3 * (code == 1)
        series[code] = x, y
    series[9] = np.ones(20), rng.normal(size=20)  # x doesn't vary
    series[10] = np.arange(6.0), np.arange(6.0)  # too short
    rows = [(c, i, float(a), float(b)) for c, (x, y) in series.items() for i, (a, b) in enumerate(zip(x, y))] + [(0, 999, None, 1.0)]
    scan = rs.chow_scan(spark.createDataFrame(rows, "code int, date int, x double, y double").repartition(3))
    got = {(r.code, r["at"]): r.f for r in scan.collect()}
    for c, (x, y) in series.items():
        n = len(x)
        want = {}
        for at in range(3, n - 2):
            u = rest(y[:at], x[:at]) + rest(y[at:], x[at:])
            want[at] = max(0, (rest(y, x) - u) / 2 / (u / (n - 4))) if n >= 8 else None
        for at, f in want.items():
            assert got[c, at] is None if f is None else np.isclose(got[c, at], f, rtol=1e-6, atol=1e-6), (c, at)
        if c < 3:
            first, last = max(4, int(0.15 * n)), min(n - 4, int(np.ceil(0.85 * n)))
            at = max(range(first, last), key=lambda a: want[a])
            r = next(r for r in rs.largest_break(scan).collect() if r.code == c)
            assert r.break_at == at and np.isclose(r.sup_f, want[at], rtol=1e-6) and r.broken == (want[at] > 15)


def test_f_tail(spark):
    """Against the distribution's own samples."""
    rng = np.random.default_rng(5)
    sample = (rng.chisquare(2, 200_000) / 2) / (rng.chisquare(30, 200_000) / 30)
    p = spark.range(1).select(rs.f_tail(F.lit(2.5), F.lit(30.0)).alias("p")).first().p
    assert abs((sample > 2.5).mean() - p) < 0.003


def test_adjusted_reads_a_family_once(spark, tmp_path):
    """Families of 60,000 in seconds: frames grow from one end, none shrinks towards the other."""
    from tapeloom.plans import registry

    spark.range(60_000).selectExpr("id AS p_partkey", "'b' AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    df = registry.queries()["k02_adjusted"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan.lower()
    rows = df.selectExpr("id", "bh").collect()
    n, p = len(rows), np.arange(60_000) * 7919 % 1000 / 1000
    order = np.lexsort((np.arange(n), p))
    want = np.empty(n)
    want[order] = np.minimum(np.minimum.accumulate((n * p[order] / np.arange(1, n + 1))[::-1])[::-1], 1)
    assert np.allclose([r.bh for r in sorted(rows)], want, atol=2e-6)
