"""Orthogonal factors, covariances, portfolios, ranks and weighted regressions against numpy."""

import numpy as np
import pandas as pd
import pytest

from tapeloom.operators import matrix as mx
from tapeloom.plans import matrices, registry

DATA = "/root/testdata/sf0.001"


def plain_orthogonal(f):
    whole = np.isfinite(f).all(axis=1)
    if whole.sum() < 2:
        return f
    c = f[whole] - f[whole].mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov(c.T))
    out = np.full_like(f, np.nan)
    x = c @ vectors @ np.diag(np.maximum(values, 1e-10) ** -0.5) @ vectors.T
    with np.errstate(invalid="ignore", divide="ignore"):
        out[whole] = x / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), np.nan)
    return out


def test_orthogonal_by_date(spark):
    rng = np.random.default_rng(0)
    rows = []
    for day in range(6):
        base = rng.normal(size=(40, 1))
        f = rng.normal(size=(40, 3)) + base
        if day == 1:
            f[3, 1], f[4, 0] = np.nan, np.inf
        if day == 2:
            f = f[:1]
        if day == 3:
            f[:, 2] = f[:, 1]  # of rank two
        if day == 4:
            f = f[:2]
        rows += [(day, i, *map(float, x)) for i, x in enumerate(f)]
    rows.append((9, 0, None, 1.0, 2.0))
    df = spark.createDataFrame(rows, "date int, i int, a double, b double, c double").repartition(5)
    got = mx.orthogonal(df, "date", ["a", "b", "c"]).toPandas().sort_values(["date", "i"])
    given = pd.DataFrame(rows, columns=["date", "i", "a", "b", "c"])
    for day, g in given.groupby("date"):
        want, have = plain_orthogonal(g[["a", "b", "c"]].to_numpy(float)), got[got.date == day][["a", "b", "c"]].to_numpy(float)
        assert np.allclose(have, want, equal_nan=True, atol=1e-3 if day in (3, 4) else 1e-9), day
        if day in (0, 5):
            assert np.abs(have.T @ have / len(have) - np.eye(3)).max() < 1e-9


def test_orthogonal_factors_query(spark):
    z = matrices.standardised(spark, DATA).toPandas()
    got = registry.queries()["c11_orthogonal_factors"](spark, DATA).toPandas()
    both = z.merge(got, on=["code", "date"], suffixes=("", "_got"))
    assert len(both) == len(z) == len(got)
    seen = 0
    for _, g in both.groupby("date"):
        f = g[list(matrices.PANEL)].to_numpy(float)
        if np.isfinite(f).all(axis=1).sum() > 5:  # of full rank
            assert np.allclose(g[[f"{c}_got" for c in matrices.PANEL]].to_numpy(float), plain_orthogonal(f), equal_nan=True, atol=1e-6)
            seen += 1
    assert seen


@pytest.mark.parametrize("block, periods", [(256, 512), (3, 7), (1, 1)])
def test_shrunk_covariance(spark, block, periods):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 9)) * rng.uniform(0.5, 2, 9) + 0.5 * rng.normal(size=(40, 1))
    x[rng.random(x.shape) < 0.2] = 0
    rows = [(f"c{j}", i, float(x[i, j])) for i in range(40) for j in range(9) if x[i, j]]
    got = mx.shrunk_covariance(spark.createDataFrame(rows, "code string, t int, x double").repartition(4), block, periods).toPandas()
    assert len(got) == 45 and (got.a <= got.b).all()
    want, plain = mx.constant_correlation(x), np.cov(x.T, bias=True)
    i, j = (got[c].str[1:].astype(int) for c in "ab")
    assert np.allclose(got.shrunk, want[i, j]) and np.allclose(got["cov"], plain[i, j]) and 0 <= got.delta[0] <= 1


def test_portfolios(spark):
    rng = np.random.default_rng(3)
    for n in (3, 8, 20):
        x = rng.normal(size=(200, n)) * rng.uniform(0.5, 3, n) + rng.normal(size=(200, 1))
        cov, mean = mx.constant_correlation(x), x.mean(axis=0) * 252
        project = lambda v: mx.onto_simplex(v, 0.0, 0.4)
        w = mx.least_volatile(cov)
        assert np.allclose(w, mx.descend(lambda w: w @ cov @ w, lambda w: 2 * cov @ w, np.full(n, 1 / n), project), atol=1e-6)
        # optimal where no pair of weights can trade
        g = 2 * cov @ w
        assert g[w > 1e-9].max() <= g[w < 0.4 - 1e-9].min() + 1e-8
        for target in np.linspace(mean.min(), mean.max(), 5):
            t = mx.least_volatile(cov, 0.0, 0.4, mean, target)
            assert abs(t.sum() - 1) < 1e-9 and t.min() >= 0 and t.max() <= 0.4 + 1e-12
            reach = np.clip(target, mx._extreme(-mean, 0, 0.4) @ mean, mx._extreme(mean, 0, 0.4) @ mean)
            assert abs(t @ mean - reach) < 1e-6 * max(1, abs(reach)) and t @ cov @ t >= w @ cov @ w - 1e-12
        rp = mx.risk_parity(cov)
        loss = lambda w: ((w * (cov @ w) / np.sqrt(w @ cov @ w) - 1 / n) ** 2).sum()
        assert abs(rp.sum() - 1) < 1e-9 and all(loss(rp) <= loss(project(rp + rng.normal(size=n) * s)) + 1e-10 for s in (1e-3, 1e-2, 0.1) for _ in range(50))
        best = mx.best_sharpe(cov, mean)
        sharpe = lambda w: (w @ mean - 0.025) / np.sqrt(w @ cov @ w)
        assert all(sharpe(best) >= sharpe(project(best + rng.normal(size=n) * s)) - 1e-8 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_floored():
    x = np.random.default_rng(4).normal(size=(5, 8))
    out = mx.floored(np.cov(x.T), 0.05)
    assert np.linalg.eigvalsh(out)[0] > 0.05 - 1e-9
    assert mx.floored(np.eye(3), 0.05) is not None and np.allclose(mx.floored(np.eye(3), 0.05), np.eye(3))


def test_portfolio_queries(spark):
    q = registry.queries()
    s = matrices.sector_returns(spark, DATA).toPandas().pivot(index="date", columns="sector", values="ret").fillna(0.0)
    cov = mx.constant_correlation(s.to_numpy())
    got = q["r24_floored_covariance"](spark, DATA).toPandas()
    at = {c: i for i, c in enumerate(s.columns)}
    want = mx.floored(cov, matrices.EIGEN)
    assert len(got) == len(at) * (len(at) + 1) // 2
    assert np.allclose(got["cov"], [want[at[a], at[b]] for a, b in zip(got.a, got.b)], rtol=1e-6, atol=1e-9)
    for name in ("r20_risk_parity", "r21_mean_variance"):
        for _, g in q[name](spark, DATA).toPandas().groupby("method"):
            assert abs(g.weight.sum() - 1) < 0.01 and g.weight.between(0, 0.4).all() and abs(g.contribution.sum() - g.volatility.iloc[0]) < 0.01 * g.volatility.iloc[0]
    f = q["r22_efficient_frontier"](spark, DATA).toPandas().sort_values("point")
    assert len(f) == 20 and (f.volatility >= np.sqrt(mx.least_volatile(cov) @ cov @ mx.least_volatile(cov)) - 1e-6).all()


def test_ranked_has_ties_and_skew(spark):
    values = [1.0] * 300 + [float(x) for x in range(200)] + [5.0] * 50
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(7)
    got = mx.ranked(df, "v", "r").toPandas().sort_values("i").r
    assert np.allclose(got, pd.Series(values).rank())


def test_weighted_residuals(spark):
    rng = np.random.default_rng(5)
    rows = [(d, f"s{k % 4}", k, float(rng.normal()), float(rng.normal()), float(rng.uniform(0.5, 2))) for d in range(3) for k in range(30)]
    rows += [(7, "one", 0, 1.0, 2.0, 1.0), (8, "one", 0, 1.0, 2.0, 1.0), (8, "one", 1, 3.0, 2.0, 1.0)]
    got = matrices.residuals(spark.createDataFrame(rows, "date int, sector string, k int, y double, x double, w double"), "y", "sector", "x", "w").toPandas()
    for _, g in got.groupby("date"):
        x = np.column_stack([np.ones(len(g)), pd.get_dummies(g.sector).to_numpy(float), g.x])
        root = np.sqrt(g.w.to_numpy())
        beta = np.linalg.lstsq(x * root[:, None], g.y * root, rcond=None)[0]
        rest = g.y - x @ beta
        assert np.allclose(g.residual, rest, atol=1e-9)
        total = (g.w * (g.y - np.average(g.y, weights=g.w)) ** 2).sum()
        assert np.allclose(g.r2, max(0, 1 - (g.w * rest**2).sum() / max(total, 1e-12)))
    assert got.where(got.date == 7).dropna().residual.abs().max() < 1e-12


def test_orthogonal_composite_query(spark):
    from tapeloom.sources import market as m

    f = registry.queries()["c11_orthogonal_factors"](spark, DATA).toPandas()
    total = sum(matrices.WEIGHTS.values())
    f["score"] = sum(f[c].fillna(0.0) * w / total for c, w in matrices.WEIGHTS.items())
    f = f.merge(m.securities(spark, DATA).select("code", "sector").toPandas(), on="code").merge(m.bars(spark, DATA).select("code", "date", "amount").toPandas(), on=["code", "date"])
    got = registry.queries()["c12_orthogonal_composite"](spark, DATA).toPandas()
    both = f.merge(got, on=["code", "date"])
    assert len(both) == len(got) == len(f) and np.allclose(both.score, both.composite_score)
    for _, g in list(both.groupby("date"))[::50]:
        x = np.column_stack([np.ones(len(g)), pd.get_dummies(g.sector).to_numpy(float), np.log(g.amount)])
        assert np.allclose(g.residual, g.score - x @ np.linalg.lstsq(x, g.score.to_numpy(), rcond=None)[0], atol=1e-6)


def test_covariance_ships_no_products(spark):
    """Pairs of blocks are dealt by their numbers: no matrix or product is in an exchange of the plan, and rows aren't gathered."""
    rows = [(c, t, float((c * 7 + t * 13) % 11)) for c in range(60) for t in range(20)]
    df = mx.shrunk_covariance(spark.createDataFrame(rows, "code long, t int, x double"), block=7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 60 * 61 // 2
    assert "FlatMapGroups" not in plan and "SortMergeJoin" not in plan and plan.count("MapInArrow") == 2
    assert not any("matrix" in line or "sums" in line for line in plan.splitlines() if "Exchange" in line)
