"""Accounting factors, growth, accounting-risk scores, earnings persistence, universe screens."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import rounded, rounded_sql as r
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m
from tapeloom.sources.accounts import accounts, accounts_sql

_A = f"WITH {accounts_sql()}"
_LAST = "OVER (PARTITION BY code ORDER BY period)"

#: Ratios of one row: name, SQL that both engines read.
RATIOS = {
    "f34_gross_profitability": "CASE WHEN assets > 0 THEN (revenue - 0.85 * gross) / assets END",
    "f35_accruals": "CASE WHEN assets > 0 THEN (net_income - ocf) / assets END",
    "f36_cash_ratio": "CASE WHEN net_income > 0 THEN ocf / net_income END",
    "z04_sloan_accruals": "least(greatest(least(greatest(coalesce((net_income - ocf) / nullif(assets, 0), 0), -1.0), 1.0) + CASE WHEN net_income > 0 AND ocf < 0 THEN 0.2 ELSE 0 END, -1.0), 1.5)",
    "z14_investment_drag": "coalesce(net_income / nullif(equity, 0), 0) - 0.0605 * coalesce(cip / nullif(assets, 0), 0)",
    "z02_dsri": f"least(greatest(coalesce(coalesce(receivables / nullif(revenue, 0), 0.15) / nullif(coalesce(lag(receivables) {_LAST} / nullif(lag(revenue) {_LAST}, 0), 0.15), 0), 1.0), 0.2), 5.0)",
    "z03_aqi": f"least(greatest(coalesce(coalesce(greatest(assets - current_assets - ppe, 0.0) / nullif(assets, 0), 0.2) / nullif(coalesce(greatest(lag(assets) {_LAST} - lag(current_assets) {_LAST} - lag(ppe) {_LAST}, 0.0) / nullif(lag(assets) {_LAST}, 0), 0.2), 0), 1.0), 0.2), 5.0)",
    "z05_depreciation": f"least(greatest(least(greatest(coalesce(coalesce(lag(depreciation) {_LAST} / nullif(lag(ppe) {_LAST} + lag(depreciation) {_LAST}, 0), 0.05) / nullif(coalesce(depreciation / nullif(ppe + depreciation, 0), 0.05), 0), 1.0), 0.2), 5.0) - 1 + 2 * least(greatest(coalesce(cip / nullif(assets, 0), 0), 0.0), 1.0), -0.8), 5.0)",
    "f48_income_growth": f"CASE WHEN lag(net_income) {_LAST} > 0 THEN net_income / lag(net_income) {_LAST} - 1 END",
    "f49_income_cagr3": f"CASE WHEN lag(net_income, 3) {_LAST} > 0 AND net_income > 0 THEN pow(net_income / lag(net_income, 3) {_LAST}, cast(1 as double) / 3) - 1 END",
}


def _ratio(name: str, expression: str) -> None:
    query(name, f"{_A} SELECT code, period, {r(expression)} AS value FROM accounts")(
        lambda spark, d: accounts(spark, d).select("code", "period", rounded(F.expr(expression)).alias("value"))
    )


for _name, _expression in RATIOS.items():
    _ratio(_name, _expression)

_CIP = "cip / nullif(assets, 0)"


def _quantile(x: str, q: float, *by: str) -> Column:
    return F.percentile(x, F.lit(q)).over(Window.partitionBy(*by))


@query("z07_winsorised", f"{_A}, x AS (SELECT code, period, {_CIP} AS x FROM accounts), e AS (SELECT period, count(x) AS n, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi, quantile_cont(x, 0.5) AS mid FROM x GROUP BY period) SELECT code, period, {r('CASE WHEN n < 4 THEN coalesce(x, 0) ELSE least(greatest(coalesce(x, mid), lo), hi) END')} AS value FROM x JOIN e USING (period)")
def winsorised(spark, d):
    """Between the 1st and the 99th percentile of the period; below four values as they are."""
    x = accounts(spark, d).select("code", "period", F.expr(_CIP).alias("x"))
    edges = x.groupBy("period").agg(F.count("x").alias("n"), F.percentile("x", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias("e"))
    inside = F.least(F.greatest(F.coalesce("x", F.col("e")[1]), F.col("e")[0]), F.col("e")[2])
    return x.join(edges, "period").select("code", "period", rounded(F.when(F.col("n") < 4, F.coalesce("x", F.lit(0.0))).otherwise(inside)).alias("value"))


_MID = "quantile_cont(x, 0.5) OVER (PARTITION BY period)"


@query("c15_mad_winsorised", f"{_A}, x AS (SELECT code, period, {_CIP} AS x FROM accounts), y AS (SELECT *, {_MID} AS mid FROM x), z AS (SELECT *, 5 * 1.4826 * quantile_cont(abs(x - mid), 0.5) OVER (PARTITION BY period) AS far FROM y) SELECT code, period, {r('CASE WHEN far = 0 THEN x ELSE least(greatest(x, mid - far), mid + far) END')} AS value FROM z")
def mad_winsorised(spark, d):
    """Within five scaled median deviations of the period's median."""
    x = accounts(spark, d).select("code", "period", F.expr(_CIP).alias("x"))
    mids = x.groupBy("period").agg(F.percentile("x", F.lit(0.5)).alias("mid"))
    y = x.join(mids, "period")
    far = y.groupBy("period").agg((5 * 1.4826 * F.percentile(F.abs(F.col("x") - F.col("mid")), F.lit(0.5))).alias("far"))
    mid, far_ = F.col("mid"), F.col("far")
    return y.join(far, "period").select("code", "period", rounded(F.when(far_ == 0, F.col("x")).otherwise(F.least(F.greatest("x", mid - far_), mid + far_))).alias("value"))


_Q = f"WITH {accounts_sql('quarter')}"
_PERSIST = f"{_Q}, a AS (SELECT code, period, net_income - 0.02 * coalesce(lag(equity) {_LAST}, equity) AS xa FROM accounts), b AS (SELECT *, lead(xa) {_LAST} AS ya FROM a), s AS (SELECT code, count(*) AS rows_, count(ya) AS n, regr_slope(ya, xa) AS slope, sqrt(greatest(regr_syy(ya, xa) - regr_sxy(ya, xa) * regr_slope(ya, xa), 0) / nullif(count(ya) - 2, 0) / nullif(regr_sxx(ya, xa), 0)) AS se FROM b GROUP BY code), p AS (SELECT code, CASE WHEN rows_ >= 4 AND n >= 4 AND slope IS NOT NULL THEN slope ELSE 0.45 END AS omega, CASE WHEN rows_ >= 4 AND n >= 4 AND slope IS NOT NULL THEN coalesce(nullif(se, 0), 0.15) ELSE 0.2 END AS se FROM s), g AS (SELECT quantile_cont(omega, 0.5) AS mid, greatest(0.0001, (CASE WHEN count(*) > 2 THEN var_pop(omega) ELSE 0.04 END) - avg(se * se)) AS tau FROM p)"


@query("z12_persistence", _PERSIST + f" SELECT code, {r('omega')} AS slope, {r('se')} AS std_err, {r('least(greatest((1 - se * se / (se * se + tau)) * omega + se * se / (se * se + tau) * mid, 0.15), 0.85)')} AS omega FROM p, g")
def persistence(spark, d):
    """Slope of abnormal earnings on the quarter before per code, shrunk to the median slope by its own error."""
    w = Window.partitionBy("code").orderBy("period")
    xa = accounts(spark, d, "quarter").select("code", "period", (F.col("net_income") - 0.02 * F.coalesce(F.lag("equity").over(w), "equity")).alias("xa"))
    b = xa.withColumn("ya", F.lead("xa").over(w))
    error = F.sqrt(F.greatest(F.regr_syy("ya", "xa") - F.regr_sxy("ya", "xa") * F.regr_slope("ya", "xa"), F.lit(0.0)) / F.nullif(F.count("ya") - 2, F.lit(0)) / F.nullif(F.regr_sxx("ya", "xa"), F.lit(0.0)))
    s = b.groupBy("code").agg(F.count("*").alias("rows_"), F.count("ya").alias("n"), F.regr_slope("ya", "xa").alias("slope"), error.alias("se"))
    fine = (F.col("rows_") >= 4) & (F.col("n") >= 4) & F.col("slope").isNotNull()
    p = s.select("code", F.when(fine, F.col("slope")).otherwise(0.45).alias("slope"), F.when(fine, F.coalesce(F.nullif("se", F.lit(0.0)), F.lit(0.15))).otherwise(0.2).alias("se"))
    spread = F.when(F.count("*") > 2, F.var_pop("slope")).otherwise(0.04)
    prior = p.agg(F.percentile("slope", F.lit(0.5)).alias("mid"), F.greatest(F.lit(0.0001), spread - F.avg(F.col("se") * F.col("se"))).alias("tau"))
    pull = F.col("se") * F.col("se") / (F.col("se") * F.col("se") + F.col("tau"))
    shrunk = F.least(F.greatest((1 - pull) * F.col("slope") + pull * F.col("mid"), F.lit(0.15)), F.lit(0.85))
    return p.join(F.broadcast(prior)).select("code", rounded(F.col("slope")).alias("slope"), rounded(F.col("se")).alias("std_err"), rounded(shrunk).alias("omega"))  # prior is one row


_LISTED = f"WITH {m.SQL}, master AS (SELECT code, min(date) AS ipo, CASE WHEN code % 10 = 0 THEN max(date) END AS gone FROM bars GROUP BY code), dates AS (SELECT DISTINCT CAST(date_trunc('year', date) AS DATE) AS as_of FROM bars)"


def _master(spark, d):
    b = m.bars(spark, d)
    master = b.groupBy("code").agg(F.min("date").alias("ipo"), F.when(F.col("code") % 10 == 0, F.max("date")).alias("gone"))
    return b, master


@query("v01_eligible", _LISTED + " SELECT as_of, code FROM dates, master WHERE ipo + 60 <= as_of AND (gone IS NULL OR as_of < gone)")
def eligible(spark, d):
    """Codes listed 60 days or more and not delisted, at each year's first day; a code explodes to its own years, without a join on ranges."""
    b, master = _master(spark, d)
    years = b.select(F.trunc("date", "year").alias("as_of")).distinct()
    latest = b.agg(F.max("date").alias("latest"))
    span = master.join(F.broadcast(latest)).select("code", "ipo", "gone", F.explode(F.sequence(F.trunc("ipo", "year"), F.trunc(F.coalesce("gone", "latest"), "year"), F.expr("interval 1 year"))).alias("as_of"))  # latest is one row
    return span.where((F.date_add("ipo", 60) <= F.col("as_of")) & (F.col("gone").isNull() | (F.col("as_of") < F.col("gone")))).select("as_of", "code").join(years, "as_of", "left_semi")


@query("v02_delisted", _LISTED + " SELECT code, gone FROM master WHERE gone <= DATE '2001-12-31'")
def delisted(spark, d):
    return _master(spark, d)[1].where("gone <= date'2001-12-31'").select("code", "gone")


@query("v05_screen", f"{_A}, x AS (SELECT code, period, net_income / nullif(equity, 0) AS roe, {_CIP} AS cip_ratio, net_income, ocf / nullif(assets, 0) AS cash FROM accounts), k AS (SELECT * FROM x WHERE NOT (roe < -0.02 OR (net_income < 0 AND cip_ratio > 0.12))), z AS (SELECT code, period, coalesce((cash - avg(cash) OVER w) / nullif(stddev_samp(cash) OVER w, 0), 0) + 0.5 * coalesce((roe - avg(roe) OVER w) / nullif(stddev_samp(roe) OVER w, 0), 0) AS score FROM k WINDOW w AS (PARTITION BY period)), n AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY round(score, 9) DESC, code) AS place, count(*) OVER (PARTITION BY period) AS n FROM z) SELECT period, code, place, {r('score')} AS score FROM n WHERE place <= least(40, greatest(10, CAST(floor(0.6 * n) AS BIGINT)))")
def screen(spark, d):
    """Weak or stalled balance sheets go; the rest is scored within its year, and an adaptive number of the best stays."""
    w = Window.partitionBy("period")
    x = accounts(spark, d).select("code", "period", "net_income", F.expr("net_income / nullif(equity, 0)").alias("roe"), F.expr(_CIP).alias("cip_ratio"), F.expr("ocf / nullif(assets, 0)").alias("cash"))
    k = x.where("NOT (roe < -0.02 OR (net_income < 0 AND cip_ratio > 0.12))")
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)), F.lit(0.0))
    s = k.select("code", "period", (z("cash") + 0.5 * z("roe")).alias("score"))
    n = s.select("*", F.row_number().over(w.orderBy(F.round("score", 9).desc(), "code")).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    return n.where("place <= least(40, greatest(10, cast(floor(0.6 * n) as bigint)))").select("period", "code", "place", rounded(F.col("score")).alias("score"))
