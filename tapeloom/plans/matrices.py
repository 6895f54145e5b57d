"""Orthogonal composites, correlations, covariances, portfolios, weighted regressions; with their SQL where it has an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import arrays
from tapeloom.functions import factors as fx
from tapeloom.functions.windows import over, rounded, rounded_sql
from tapeloom.operators import frames as op
from tapeloom.operators import matrix as mx
from tapeloom.plans.catalog import query
from tapeloom.sources import lake
from tapeloom.sources import market as m

r = rounded_sql
PANEL = ("f01_momentum_20d", "f03_volatility_20d", "f07_volume_ratio_5_20", "f11_close_rank_20d")
_PANEL_SQL = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, p AS (SELECT code, date, {', '.join(f'{fx.FACTORS[c][1]} AS {c}' for c in PANEL)} FROM enriched)"


def panel(spark, d, keep: tuple[str, ...] = ()) -> DataFrame:
    return arrays.by_code(m.bars(spark, d), {c: arrays.FACTORS[c] for c in PANEL}, keep)


def _z_sql(c: str) -> str:
    return f"({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_pop({c}) OVER (PARTITION BY date), 0)"


def standardised(spark, d, columns: tuple[str, ...] = PANEL) -> DataFrame:
    """Factors as z-scores of their date; without spread, null."""
    p = panel(spark, d)
    return p.select("code", "date", *(op.zscore(c, "date").alias(c) for c in columns))


_PAIR = PANEL[:2]
_A, _B = _PAIR


@query(
    "c11_orthogonal_pair",
    f"""{_PANEL_SQL}, z AS (SELECT code, date, {', '.join(f'{_z_sql(c)} AS {c}' for c in _PAIR)} FROM p),
g AS (SELECT date, count(*) AS n, avg({_A}) AS ma, avg({_B}) AS mb, var_samp({_A}) AS a, var_samp({_B}) AS d, covar_samp({_A}, {_B}) AS b FROM z WHERE {_A} IS NOT NULL AND {_B} IS NOT NULL GROUP BY date),
h AS (SELECT *, sqrt(greatest(a * d - b * b, 0)) AS s FROM g), k AS (SELECT *, sqrt(a + d + 2 * s) AS t FROM h),
x AS (SELECT code, z.date, n, {_A} AS za, {_B} AS zb, (({_A} - ma) * (d + s) - ({_B} - mb) * b) / (s * t) AS u, (({_B} - mb) * (a + s) - ({_A} - ma) * b) / (s * t) AS v FROM z LEFT JOIN k USING (date)),
y AS (SELECT code, date, n, za, zb, CASE WHEN n >= 5 THEN u / stddev_pop(u) OVER (PARTITION BY date) END AS u, CASE WHEN n >= 5 THEN v / stddev_pop(v) OVER (PARTITION BY date) END AS v FROM x)
SELECT code, date, {r('u')} AS u, {r('v')} AS v FROM y WHERE n >= 5""",
)
def orthogonal_pair(spark, d):
    """Two factors made orthogonal on dates with five complete rows or more; SQL has the closed root of a 2 x 2 matrix."""
    z = standardised(spark, d, _PAIR)
    complete = F.col(_A).isNotNull() & F.col(_B).isNotNull()
    n = F.count_if(complete).over(Window.partitionBy("date"))
    z = z.withColumn("n", n).where("n >= 5").drop("n")
    return mx.orthogonal(z, "date", list(_PAIR)).select("code", "date", rounded(F.col(_A)).alias("u"), rounded(F.col(_B)).alias("v"))


def _weighted(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum(weights.values())
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.coalesce(F.col(c), F.lit(0.0)) * (w / total)
    return z.withColumn("composite_score", score)


#: Weights of the panel's factors, by size of their information ratio as a study gives it.
WEIGHTS = dict(zip(PANEL, (0.4, 0.3, 0.2, 0.1)))


@query("c11_orthogonal_factors", None)
def orthogonal_factors(spark, d):
    """Four factors made orthogonal by date; tests hold it against numpy."""
    return mx.orthogonal(standardised(spark, d), "date", list(PANEL))


@query("c12_orthogonal_composite", None)
def orthogonal_composite(spark, d):
    """The composite of the orthogonal factors, neutral to sector and size."""
    p = m.dealt_by_date(spark, d, panel(spark, d, keep=("amount",)).where("date IS NOT NULL"))
    z = lake.written(p.select("code", "date", F.log("amount").alias("size"), *(op.zscore(c, "date").alias(c) for c in PANEL)), "scores")
    scored = _weighted(mx.orthogonal(z, "date", list(PANEL)), WEIGHTS).select("code", "date", "size", "composite_score")
    sized = m.dealt_by_date(spark, d, scored.join(m.securities(spark, d).select("code", "sector"), "code"))
    return residuals(sized.withColumn("w", F.lit(1.0)), "composite_score", "sector", "size", "w").select("code", "date", "composite_score", "residual")


_SCORE_SQL = " + ".join(f"coalesce(z_{c}, 0) * {w}" for c, w in WEIGHTS.items())


@query("c13_scored_frame", f"{_PANEL_SQL}, z AS (SELECT *, {', '.join(f'{_z_sql(c)} AS z_{c}' for c in PANEL)} FROM p) SELECT code, date, {', '.join(f'{r(c)} AS {c}' for c in PANEL)}, {r(_SCORE_SQL)} AS composite_score FROM z")
def scored_frame(spark, d):
    """The input's rows with their factors and their composite."""
    p = panel(spark, d).select("*", *(op.zscore(c, "date").alias(f"z_{c}") for c in PANEL))
    score = F.lit(0.0)
    for c, w in WEIGHTS.items():
        score = score + F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) * w
    return p.select("code", "date", *(rounded(F.col(c)).alias(c) for c in PANEL), rounded(score).alias("composite_score"))


# weighted cross-section regression
def residuals(rows: DataFrame, y: str, sector: str, x: str, w: str) -> DataFrame:
    """rows with residual and r2 of a weighted regression of y on sector dummies and x, by date.

    Sector dummies are taken out by weighted means of the sector, which leaves one slope; windows by date and sector,
    no matrices. Rows without y or x are left out. Where x doesn't vary within sectors, there is no slope."""
    rows = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(w).isNotNull())
    inner, day = Window.partitionBy("date", sector), Window.partitionBy("date")
    weight = F.col(w)
    apart = lambda c, win: F.col(c) - F.sum(weight * F.col(c)).over(win) / F.sum(weight).over(win)
    t = rows.withColumns({"y_": apart(y, inner), "x_": apart(x, inner), "yy_": apart(y, day)})
    sxx = F.sum(weight * F.col("x_") * F.col("x_")).over(day)
    slope = F.when(sxx > 1e-12, F.sum(weight * F.col("x_") * F.col("y_")).over(day) / sxx).otherwise(0.0)
    t = t.withColumn("residual", F.col("y_") - slope * F.col("x_"))
    rest, whole = F.sum(weight * F.col("residual") * F.col("residual")).over(day), F.sum(weight * F.col("yy_") * F.col("yy_")).over(day)
    return t.withColumn("r2", F.greatest(F.lit(0.0), 1 - rest / F.greatest(whole, F.lit(1e-12)))).drop("y_", "x_", "yy_")


@query(
    "k10_weighted_residuals",
    f"""{_PANEL_SQL}, {m.SECURITIES_SQL}, q AS (SELECT code, date, sector, {_A} AS y, ln(amount) AS x, sqrt(amount) AS w FROM p JOIN bars USING (code, date) JOIN securities USING (code) WHERE {_A} IS NOT NULL),
s AS (SELECT date, sector, sum(w * y) / sum(w) AS ys, sum(w * x) / sum(w) AS xs FROM q GROUP BY ALL),
b AS (SELECT date, sum(w * (x - xs) * (y - ys)) AS sxy, sum(w * (x - xs) * (x - xs)) AS sxx FROM q JOIN s USING (date, sector) GROUP BY date),
e AS (SELECT code, date, w, y, y - ys - CASE WHEN sxx > 1e-12 THEN sxy / sxx ELSE 0 END * (x - xs) AS residual FROM q JOIN s USING (date, sector) JOIN b USING (date)),
f AS (SELECT date, sum(w * y) / sum(w) AS ym FROM e GROUP BY date), g AS (SELECT date, greatest(0, 1 - sum(w * residual * residual) / greatest(sum(w * (y - ym) * (y - ym)), 1e-12)) AS r2 FROM e JOIN f USING (date) GROUP BY date)
SELECT code, date, {r('residual', 5)} AS residual, {r('r2')} AS r2 FROM e JOIN g USING (date)""",
)
def weighted_residuals(spark, d):
    p = panel(spark, d).select("code", "date", F.col(_A).alias("y"))
    b = m.bars(spark, d).select("code", "date", F.log("amount").alias("x"), F.sqrt("amount").alias("w"))
    q = p.join(b, ["code", "date"]).join(m.securities(spark, d).select("code", "sector"), "code")
    return residuals(q, "y", "sector", "x", "w").select("code", "date", rounded(F.col("residual"), 5).alias("residual"), rounded(F.col("r2")).alias("r2"))


# correlations
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in PANEL)
_PAIRS = [(a, b) for i, a in enumerate(PANEL) for b in PANEL[i:]]


@query("a13_factor_correlations", f"{_PANEL_SQL}, q AS (SELECT {_RANKS} FROM p WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PANEL)}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})')} AS corr FROM q" for a, b in _PAIRS))
def factor_correlations(spark, d):
    return mx.rank_correlations(panel(spark, d), list(PANEL)).select("a", "b", rounded(F.col("corr")).alias("corr"))


def sector_returns(spark, d) -> DataFrame:
    """(sector, date, ret): mean return of a sector's codes at a date."""
    e = fx.enriched(m.bars(spark, d)).where("ret IS NOT NULL").select("code", "date", "ret")
    return e.join(m.securities(spark, d).select("code", "sector"), "code").groupBy("sector", "date").agg(F.avg("ret").alias("ret"))


SECTOR_SQL = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, {m.SECURITIES_SQL}, sr AS (SELECT sector, date, avg(ret) AS ret FROM enriched JOIN securities USING (code) WHERE ret IS NOT NULL GROUP BY ALL)"


@query("a14_asset_correlations", f"{SECTOR_SQL} SELECT x.sector AS a, y.sector AS b, count(*) AS n, {r('covar_pop(x.ret, y.ret) / nullif(stddev_pop(x.ret) * stddev_pop(y.ret), 0)')} AS corr FROM sr x JOIN sr y ON x.date = y.date AND x.sector <= y.sector GROUP BY ALL")
def asset_correlations(spark, d):
    """Pairwise complete: pairs of sectors meet by date, a few hundred a date."""
    s = sector_returns(spark, d)
    x, y = s.select("date", F.col("sector").alias("a"), F.col("ret").alias("x")), s.select("date", F.col("sector").alias("b"), F.col("ret").alias("y"))
    c = op.correlation("x", "y")
    return x.join(y, "date").where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"), rounded(c).alias("corr"))


# covariance and portfolios
def monthly_returns(spark, d) -> DataFrame:
    """(code, t, x): log return between the last closes of a code's months."""
    last = m.bars(spark, d).groupBy("code", F.trunc("date", "month").alias("t")).agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("code").orderBy("t")
    return last.select("code", "t", F.log(F.col("close") / F.lag("close").over(w)).alias("x")).where("x IS NOT NULL")


@query(
    "r19_shrunk_covariance",
    f"""WITH {m.SQL}, c AS (SELECT code, CAST(date_trunc('month', date) AS DATE) AS t, arg_max(close, date) AS close FROM bars GROUP BY ALL),
x AS (SELECT code, t, ln(close / lag(close) OVER (PARTITION BY code ORDER BY t)) AS x FROM c), k AS (SELECT code, t, x FROM x WHERE x IS NOT NULL),
grid AS (SELECT code, t, coalesce(x, 0) AS x FROM (SELECT DISTINCT code FROM k) CROSS JOIN (SELECT DISTINCT t FROM k) LEFT JOIN k USING (code, t)),
z AS (SELECT code, t, x - avg(x) OVER (PARTITION BY code) AS x FROM grid),
s AS (SELECT a.code AS i, b.code AS j, avg(a.x * b.x) AS s, avg(a.x * a.x) AS vi, avg(b.x * b.x) AS vj, avg(a.x * a.x * b.x * b.x) AS q, avg(a.x * a.x * a.x * b.x) AS p, avg(a.x * b.x * b.x * b.x) AS u, count(*) AS n FROM z a JOIN z b ON a.t = b.t GROUP BY ALL),
o AS (SELECT *, sqrt(greatest(vi, 1e-16)) AS di, sqrt(greatest(vj, 1e-16)) AS dj FROM s), g AS (SELECT avg(least(1, greatest(-1, s / (di * dj)))) AS m FROM o WHERE i <> j),
f AS (SELECT max(n) AS n, sum((s - m * di * dj) ** 2) AS gamma, sum(q - s * s) AS pi, sum(0.5 * m * (dj / di * (p - vi * s) + di / dj * (u - vj * s))) AS rho FROM o, g WHERE i <> j),
e AS (SELECT CASE WHEN gamma < 1e-16 THEN 0 ELSE greatest(0, least(1, (pi - rho) / gamma / n)) END AS delta FROM f)
SELECT i AS a, j AS b, {r('s')} AS cov, {r('CASE WHEN i = j THEN s ELSE (1 - delta) * s + delta * m * di * dj END')} AS shrunk, {r('delta')} AS delta FROM o, g, e WHERE i <= j""",
)
def shrunk_covariance(spark, d):
    c = mx.shrunk_covariance(monthly_returns(spark, d))
    return c.select("a", "b", *(rounded(F.col(x)).alias(x) for x in ("cov", "shrunk", "delta")))


def sector_matrix(spark, d) -> DataFrame:
    """One row: the sectors, the number of dates, mean daily returns and the covariance of sectors, as arrays.

    The shrunk covariance comes from the blocks above; sectors are few, so the matrix is bounded by them."""
    s = sector_returns(spark, d).select(F.col("sector").alias("code"), F.col("date").alias("t"), F.col("ret").alias("x"))
    c = mx.shrunk_covariance(s)
    both = c.select("a", "b", "shrunk").unionByName(c.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "shrunk"))
    dates = s.agg(F.count_distinct("t").alias("t"))
    means = s.groupBy("code").agg(F.sum("x").alias("total")).crossJoin(F.broadcast(dates)).agg(F.sort_array(F.collect_list(F.struct("code", (F.col("total") / F.col("t")).alias("mean")))).alias("assets"))
    cov = both.agg(F.sort_array(F.collect_list(F.struct("a", "b", "shrunk"))).alias("cells"))
    return means.crossJoin(cov).select(F.transform("assets", lambda x: x["code"]).alias("assets"), F.transform("assets", lambda x: x["mean"] * 252).alias("mean"), F.transform("cells", lambda x: x["shrunk"]).alias("cov"))


def _solved(solve, schema: str):
    """mapInPandas over rows of a sector matrix: solve gives a table of each."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for row in g.itertuples(index=False):
                if len(row.assets) >= 2:
                    yield solve(row, np.array(row.mean), np.array(row.cov).reshape(len(row.assets), -1))

    return lambda df: df.mapInPandas(f, schema)


FREE, HIGH, EIGEN = 0.025, 0.4, 0.05


@query("r24_floored_covariance", None)
def floored_covariance(spark, d, floor: float = EIGEN):
    """Shrunk covariance of sectors with eigenvalues of at least `floor`, and the least one before; tests hold it against numpy."""

    def solve(row, mean, cov):
        k, out = len(row.assets), mx.floored(cov, floor)
        i, j = np.triu_indices(k)
        return pd.DataFrame({"a": [row.assets[x] for x in i], "b": [row.assets[x] for x in j], "cov": out[i, j], "least": np.linalg.eigvalsh(cov)[0]})

    return _solved(solve, "a string, b string, cov double, least double")(sector_matrix(spark, d))


def _portfolio(method: str, row, w: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    vol = float(np.sqrt(w @ cov @ w))
    ret = float(w @ mean)
    return pd.DataFrame({"method": method, "asset": list(row.assets), "weight": w.round(4), "contribution": (w * (cov @ w) / vol if vol > 0 else w * 0).round(6), "expected_return": ret, "volatility": vol, "sharpe": (ret - FREE) / vol if vol > 0 else 0.0})


_PORTFOLIO = "method string, asset string, weight double, contribution double, expected_return double, volatility double, sharpe double"


@query("r20_risk_parity", None)
def risk_parity(spark, d, high: float = HIGH):
    """Sector weights by risk parity; tests hold it against a search by another rule."""
    return _solved(lambda row, mean, cov: _portfolio("risk_parity", row, mx.risk_parity(cov, 0.0, high), mean, cov), _PORTFOLIO)(sector_matrix(spark, d))


@query("r21_mean_variance", None)
def mean_variance(spark, d, high: float = HIGH):
    """Sector weights of the best Sharpe ratio and of the least volatility, solved side by side."""

    def solve(row, mean, cov):
        w = mx.best_sharpe(cov, mean, FREE, 0.0, high) if row.method == "max_sharpe" else mx.least_volatile(cov, 0.0, high)
        return _portfolio(row.method, row, w, mean, cov)

    both = sector_matrix(spark, d).select("*", F.explode(F.array(F.lit("max_sharpe"), F.lit("min_volatility"))).alias("method"))
    return _solved(solve, _PORTFOLIO)(both.repartition(2, "method"))


@query("r22_efficient_frontier", None)
def efficient_frontier(spark, d, points: int = 20, high: float = HIGH):
    """The least volatility at returns from the lowest to the highest of an asset, a task a point."""

    def solve(row, mean, cov):
        target = float(mean.min() + (mean.max() - mean.min()) * row.point / (points - 1))
        w = mx.least_volatile(cov, 0.0, high, mean, target)
        vol = float(np.sqrt(w @ cov @ w))
        return pd.DataFrame({"point": [row.point], "target_return": [target], "expected_return": [float(w @ mean)], "volatility": [vol], "sharpe": [(float(w @ mean) - FREE) / vol if vol > 0 else 0.0]})

    each = sector_matrix(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return _solved(solve, "point int, target_return double, expected_return double, volatility double, sharpe double")(each.repartition(points, "point"))
