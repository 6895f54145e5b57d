"""The composite accounting-risk score and what follows from it, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import over, rounded, rounded_sql
from tapeloom.operators import frames as op
from tapeloom.plans import forensics
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m
from tapeloom.sources.accounts import accounts, accounts_sql

r = rounded_sql
#: Sectors and codes that are financial whatever their accounts say; deposits and borrowing that make a bank.
LABELS, KNOWN, LEAST_DEPOSITS, LEAST_BORROWED = ("NATION_3", "NATION_11"), (7, 57), 1e8, 1000.0
#: Interest below this part of cash, with short debt above that part of it, and this much cash.
INTEREST, DEBT, LEAST_CASH = 0.008, 0.3, 1e7
WEIGHTS = {"dsri": 0.20, "aqi": 0.15, "sloan": 0.25, "depi": 0.20, "cashtrap": 0.20}
_SCORES = {"dsri": "z02_dsri", "aqi": "z03_aqi", "sloan": "z04_sloan_accruals", "depi": "z05_depreciation"}

# what the accounts don't have, by fixed rules in both engines
_MORE = {
    "cash": "1000 * ocf", "short_debt": "200 * receivables", "interest": "1000 * ocf * (0.003 + 0.001 * (code % 10))", "borrowed": "CASE WHEN code % 13 = 0 THEN cip ELSE 0 END",
    "current_ratio": "CASE WHEN code % 26 = 0 THEN NULL ELSE current_assets / nullif(receivables, 0) END", "deposits": "CASE WHEN code % 31 = 0 THEN 100 * gross ELSE 0 END",
}


def _rows(spark, d) -> DataFrame:
    """Annual accounts with sector, raw scores and the columns above."""
    a = accounts(spark, d).select("*", *(F.expr(x).alias(c) for c, x in _MORE.items()), *(F.expr(forensics.RATIOS[x]).alias(c) for c, x in _SCORES.items()))
    return a.join(m.securities(spark, d).select("code", "sector"), "code")


def financial(sector: Column, code: Column, current_ratio: Column, borrowed: Column, deposits: Column) -> Column:
    """By label, by code, by borrowing from the central bank without a current ratio, or by an account that only banks have."""
    no_ratio = current_ratio.isNull() | F.isnan(current_ratio) | (current_ratio == 0)
    return sector.isin(*LABELS) | code.isin(*KNOWN) | (no_ratio & (F.coalesce(borrowed, F.lit(0.0)) > LEAST_BORROWED)) | (F.coalesce(deposits, F.lit(0.0)) > LEAST_DEPOSITS)


def cash_trap(cash: Column, interest: Column, debt: Column, exempt: Column) -> tuple[Column, Column]:
    """(score, flag): much cash that earns little beside short debt; 0 and false for financial codes."""
    rate, ratio = (F.coalesce(over(F.coalesce(x, F.lit(0.0)), F.coalesce(cash, F.lit(0.0))), F.lit(0.0)) for x in (F.greatest(interest, F.lit(0.0)), debt))
    flag = (rate < INTEREST) & (ratio > DEBT) & (F.coalesce(cash, F.lit(0.0)) > LEAST_CASH)
    score = ratio * (1 + F.greatest((0.015 - rate) / 0.015, F.lit(0.0))) + F.when(flag, 2.0).otherwise(0.0)
    return F.least(F.greatest(F.when(exempt, 0.0).otherwise(score), F.lit(0.0)), F.lit(10.0)), flag & ~exempt


_ROWS_SQL = f"""WITH {accounts_sql()}, {m.SECURITIES_SQL}, base AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _MORE.items())}, {', '.join(f'{forensics.RATIOS[x]} AS {c}' for c, x in _SCORES.items())} FROM accounts JOIN securities USING (code)),
fin AS (SELECT *, sector IN {LABELS} OR code IN {KNOWN} OR (coalesce(current_ratio, 0) = 0 AND coalesce(borrowed, 0) > {LEAST_BORROWED}) OR coalesce(deposits, 0) > {LEAST_DEPOSITS} AS is_fin,
  coalesce(greatest(coalesce(interest, 0), 0) / nullif(cash, 0), 0) AS rate, coalesce(short_debt / nullif(cash, 0), 0) AS ratio FROM base),
trap AS (SELECT *, NOT is_fin AND rate < {INTEREST} AND ratio > {DEBT} AND cash > {LEAST_CASH} AS flag,
  least(greatest(CASE WHEN is_fin THEN 0 ELSE ratio * (1 + greatest((0.015 - rate) / 0.015, 0)) + CASE WHEN rate < {INTEREST} AND ratio > {DEBT} AND cash > {LEAST_CASH} THEN 2 ELSE 0 END END, 0), 10) AS cashtrap FROM fin)"""


def _scored(spark, d) -> DataFrame:
    f = _rows(spark, d).withColumn("is_fin", financial(*map(F.col, ("sector", "code", "current_ratio", "borrowed", "deposits"))))
    score, flag = cash_trap(F.col("cash"), F.col("interest"), F.col("short_debt"), F.col("is_fin"))
    return f.select("*", score.alias("cashtrap"), flag.alias("flag"))


@query("z01_financial", f"{_ROWS_SQL} SELECT code, period, is_fin AS financial FROM trap")
def financial_codes(spark, d):
    return _scored(spark, d).select("code", "period", F.col("is_fin").alias("financial"))


@query("z06_cash_trap", f"{_ROWS_SQL} SELECT code, period, {r('cashtrap')} AS score, flag FROM trap")
def cash_traps(spark, d):
    return _scored(spark, d).select("code", "period", rounded(F.col("cashtrap")).alias("score"), "flag")


def _median(c: str, *by: str) -> Column:
    return F.percentile(c, F.lit(0.5)).over(Window.partitionBy(*by))


def sector_scores(tall: DataFrame) -> DataFrame:
    """(code, period, sector, name, x) with z: deviations from the sector's median by its scaled median deviation.

    Values are held within the 1st and 99th percentile of the period first. A sector of fewer than three rows is
    measured by the whole period, one without median deviation by its standard deviation. Between -5 and 5."""
    all_, own = ("period", "name"), ("period", "name", "sector")
    w = Window.partitionBy(*all_)
    edges = F.percentile("x", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).over(w)
    t = tall.withColumns({"e": edges, "n": F.count("x").over(w)})
    t = t.withColumn("c", F.when(F.col("n") < 4, F.coalesce("x", F.lit(0.0))).otherwise(F.least(F.greatest(F.coalesce("x", F.col("e")[1]), F.col("e")[0]), F.col("e")[2])))
    t = t.withColumns({"mid": _median("c", *all_), "own_mid": _median("c", *own), "k": F.count("*").over(Window.partitionBy(*own)), "dev": F.stddev_samp("c").over(w), "own_dev": F.stddev_samp("c").over(Window.partitionBy(*own))})
    t = t.withColumns({"far": F.abs(F.col("c") - F.col("mid")), "own_far": F.abs(F.col("c") - F.col("own_mid"))})
    t = t.withColumns({"mad": _median("far", *all_), "own_mad": _median("own_far", *own)})
    whole = F.when(F.col("mad") > 1e-4, 1.4826 * F.col("mad")).otherwise(F.when(F.col("dev") != 0, F.col("dev")).when(F.col("dev") == 0, 1.0))
    inner = F.when(F.col("own_mad") > 1e-4, 1.4826 * F.col("own_mad")).when(F.col("own_dev") > 1e-4, F.col("own_dev")).otherwise(whole)
    z = F.when(F.col("k") < 3, (F.col("c") - F.col("mid")) / whole).otherwise((F.col("c") - F.col("own_mid")) / inner)
    return t.select("code", "period", "sector", "name", "x", F.least(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(-5.0)), F.lit(5.0)).alias("z"))


def _tall(scored: DataFrame) -> DataFrame:
    return scored.select("code", "period", "sector", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in WEIGHTS))).alias("f")).select("code", "period", "sector", "f.*")


_Z_SQL = f"""{_ROWS_SQL}, tall AS (SELECT code, period, sector, unnest([{', '.join(f"'{c}'" for c in WEIGHTS)}]) AS name, unnest([{', '.join(WEIGHTS)}]) AS x FROM trap),
e AS (SELECT period, name, count(x) AS n, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.99) AS hi FROM tall GROUP BY ALL),
c AS (SELECT code, period, sector, name, x, CASE WHEN n < 4 THEN coalesce(x, 0) ELSE least(greatest(coalesce(x, mid), lo), hi) END AS c FROM tall JOIN e USING (period, name)),
g AS (SELECT period, name, median(c) AS mid, stddev_samp(c) AS dev FROM c GROUP BY ALL), gm AS (SELECT period, name, median(abs(c - mid)) AS mad FROM c JOIN g USING (period, name) GROUP BY ALL),
o AS (SELECT period, name, sector, median(c) AS mid, stddev_samp(c) AS dev, count(*) AS k FROM c GROUP BY ALL), om AS (SELECT period, name, sector, median(abs(c - mid)) AS mad FROM c JOIN o USING (period, name, sector) GROUP BY ALL),
s AS (SELECT c.code, c.period, c.sector, c.name, c.x, c.c, k, g.mid AS gmid, o.mid AS omid, om.mad AS omad, o.dev AS odev, CASE WHEN gm.mad > 1e-4 THEN 1.4826 * gm.mad WHEN g.dev = 0 THEN 1 ELSE g.dev END AS whole
  FROM c JOIN g USING (period, name) JOIN gm USING (period, name) JOIN o USING (period, name, sector) JOIN om USING (period, name, sector)),
z AS (SELECT code, period, sector, name, x, least(greatest(coalesce(CASE WHEN k < 3 THEN (c - gmid) / whole ELSE (c - omid) / CASE WHEN omad > 1e-4 THEN 1.4826 * omad WHEN odev > 1e-4 THEN odev ELSE whole END END, 0), -5), 5) AS z FROM s)"""


@query("z08_sector_scores", f"{_Z_SQL} SELECT code, period, name, {r('z', 5)} AS z FROM z")
def scores_by_sector(spark, d):
    return sector_scores(_tall(_scored(spark, d))).select("code", "period", "name", rounded(F.col("z"), 5).alias("z"))


def composite(spark, d) -> DataFrame:
    """Accounts with z, the weighted score (0 for financial codes), its percentile and limit among the others of the period, and a status.

    With fewer than five codes in a period the limit is 0.5, and the percentile a third of the score within 0 and 3."""
    rows = _scored(spark, d).select("code", "period", "sector", "is_fin", "flag", *WEIGHTS)
    weight = F.coalesce(*(F.when(F.col("name") == c, w) for c, w in WEIGHTS.items()))
    z = sector_scores(_tall(rows)).groupBy("code", "period").agg(F.sum(weight * F.col("z")).alias("z"))
    t = rows.join(z, ["code", "period"]).withColumn("z", F.when(F.col("is_fin"), 0.0).otherwise(F.round("z", 9)))
    w = Window.partitionBy("period", "is_fin")
    t = t.withColumn("codes", F.count("*").over(Window.partitionBy("period"))).withColumns({"place": op.average_rank("z", "period", "is_fin") / F.count("*").over(w), "cut": F.percentile("z", F.lit(0.75)).over(w)})
    enough = F.col("codes") >= 5
    t = t.withColumns({"percentile": F.when(F.col("is_fin") & enough, 0.0).when(enough, F.col("place")).otherwise(F.least(F.greatest("z", F.lit(0.0)), F.lit(3.0)) / 3), "cut": F.when(enough, F.col("cut")).otherwise(0.5)})
    black = ~F.col("is_fin") & ((F.col("z") > F.col("cut") + 1e-8) | F.col("flag"))
    status = F.when(F.col("is_fin"), "ISOLATED_EXEMPT").when(black, "INTERCEPTED_ALERT").otherwise("CLEAN_PASS")
    verdict = F.when(F.col("is_fin"), "exempt: financial").when(F.col("flag"), "alert: cash trap").when(black, "alert: score").otherwise("clean")
    return t.select("code", "period", "sector", "z", "percentile", "flag", black.alias("blacklisted"), status.alias("status"), verdict.alias("verdict"))


_BLACK = "NOT is_fin AND (z > cut + 1e-8 OR flag)"
_COMPOSITE_SQL = f"""{_Z_SQL}, w AS (SELECT code, period, sum(z * CASE name {' '.join(f"WHEN '{c}' THEN {w}" for c, w in WEIGHTS.items())} END) AS z FROM z GROUP BY ALL),
t AS (SELECT code, period, sector, is_fin, flag, CASE WHEN is_fin THEN 0.0 ELSE round(w.z, 9) END AS z, count(*) OVER (PARTITION BY period) AS codes FROM trap JOIN w USING (code, period)),
p AS (SELECT *, (rank() OVER (PARTITION BY period, is_fin ORDER BY z) + (count(*) OVER (PARTITION BY period, is_fin, z) - 1) / 2.0) / count(*) OVER (PARTITION BY period, is_fin) AS place, quantile_cont(z, 0.75) OVER (PARTITION BY period, is_fin) AS p75 FROM t),
q AS (SELECT *, CASE WHEN is_fin AND codes >= 5 THEN 0 WHEN codes >= 5 THEN place ELSE least(greatest(z, 0), 3) / 3 END AS percentile, CASE WHEN codes >= 5 THEN p75 ELSE 0.5 END AS cut FROM p),
v AS (SELECT *, {_BLACK} AS blacklisted, CASE WHEN is_fin THEN 'ISOLATED_EXEMPT' WHEN {_BLACK} THEN 'INTERCEPTED_ALERT' ELSE 'CLEAN_PASS' END AS status,
  CASE WHEN is_fin THEN 'exempt: financial' WHEN flag THEN 'alert: cash trap' WHEN {_BLACK} THEN 'alert: score' ELSE 'clean' END AS verdict FROM q)"""


@query("z09_composite", f"{_COMPOSITE_SQL} SELECT code, period, {r('z', 5)} AS z, {r('percentile * 100', 2)} AS percentile, flag, blacklisted, status, verdict FROM v")
def composite_verdicts(spark, d):
    c = composite(spark, d)
    return c.select("code", "period", rounded(F.col("z"), 5).alias("z"), rounded(F.col("percentile") * 100, 2).alias("percentile"), "flag", "blacklisted", "status", "verdict")


# valuation
RATE, MARGIN = 0.02, 0.17
_OMEGA_SQL = f"{forensics._PERSIST}, om AS (SELECT code, least(greatest((1 - se * se / (se * se + tau)) * omega + se * se / (se * se + tau) * mid, 0.15), 0.85) AS omega FROM p, g)"


@query(
    "z13_residual_income",
    f"""{_OMEGA_SQL}, y AS (SELECT * FROM ({_ROWS_SQL} SELECT code, period, net_income, equity, assets FROM base)),
x AS (SELECT y.*, coalesce(round(omega, 6), 0.45) AS o FROM y LEFT JOIN om USING (code))
SELECT code, period, {r(f'o / greatest(1 + {RATE} - o, {MARGIN}) * coalesce(least(greatest((net_income - {RATE} * equity) / nullif(assets, 0), -0.5), 0.5), 0) + 0.5 * o', 5)} AS value FROM x""",
)
def residual_income(spark, d):
    """Abnormal income over assets, worth more the longer it lasts, and half of the persistence."""
    a = accounts(spark, d).join(forensics.persistence(spark, d).select("code", "omega"), "code", "left")
    o = F.coalesce("omega", F.lit(0.45))
    density = F.coalesce(F.least(F.greatest(over(F.col("net_income") - RATE * F.col("equity"), F.col("assets")), F.lit(-0.5)), F.lit(0.5)), F.lit(0.0))
    return a.select("code", "period", rounded(o / F.greatest(1 + RATE - o, F.lit(MARGIN)) * density + 0.5 * o, 5).alias("value"))


def _share(x: str, *by: str) -> Column:
    """Average-tie rank among the known values, over their number."""
    return F.when(F.col(x).isNotNull(), op.average_rank(x, *by) / F.count(x).over(Window.partitionBy(*by)))


def _share_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY period, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY period, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY period) END"


@query(
    "z15_causal_alpha",
    f"""{_OMEGA_SQL}, y AS (SELECT * FROM ({_ROWS_SQL} SELECT code, period, round(cip / nullif(assets, 0), 9) AS drag, round(net_income / nullif(equity, 0), 9) AS roe FROM base)),
x AS (SELECT y.*, coalesce(round(omega, 6), 0.45) AS o FROM y LEFT JOIN om USING (code)) SELECT code, period, {r(f'coalesce({_share_sql("o")} - {_share_sql("drag")} + 1.5 * {_share_sql("roe")}, 0)')} AS value FROM x""",
)
def causal_alpha(spark, d):
    a = accounts(spark, d).select("code", "period", F.round(over(F.col("cip"), F.col("assets")), 9).alias("drag"), F.round(over(F.col("net_income"), F.col("equity")), 9).alias("roe"))
    a = a.join(forensics.persistence(spark, d).select("code", "omega"), "code", "left").withColumn("o", F.coalesce("omega", F.lit(0.45)))
    value = _share("o", "period") - _share("drag", "period") + 1.5 * _share("roe", "period")
    return a.select("code", "period", rounded(F.coalesce(value, F.lit(0.0))).alias("value"))


# screens
def _spread(x: str) -> Column:
    """Sample deviation, 1 where there is none."""
    s = F.stddev_samp(x).over(Window.partitionBy("period"))
    return F.when(s > 1e-8, s).otherwise(1.0)


@query(
    "v06_risk_filter",
    f"""WITH {accounts_sql()}, a AS (SELECT code, period, cip / greatest(assets, 0.01) AS x, net_income < 0 AS loss FROM accounts),
s AS (SELECT *, count(*) OVER w AS n, (x - avg(x) OVER w) / CASE WHEN stddev_samp(x) OVER w > 1e-8 THEN stddev_samp(x) OVER w ELSE 1 END AS zx FROM a WINDOW w AS (PARTITION BY period)),
z AS (SELECT *, round(0.6 * zx + CASE WHEN loss THEN 0.4 ELSE 0 END, 9) AS z FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY z) - 1 AS pos FROM z),
c AS (SELECT period, max(z) FILTER (pos = floor((n - 1) * 0.75 + 0.5)) AS cut FROM k GROUP BY period) SELECT code, period, {r('z')} AS z FROM k JOIN c USING (period) WHERE n < 10 OR z <= cut""",
)
def risk_filter(spark, d):
    """Three quarters of a period's codes by capital tied up and losses; the limit is the value nearest to the quantile. Fewer than ten all stay."""
    w = Window.partitionBy("period")
    a = accounts(spark, d).select("code", "period", (F.col("cip") / F.greatest("assets", F.lit(0.01))).alias("x"), F.when(F.col("net_income") < 0, 0.4).otherwise(0.0).alias("loss"))
    z = a.withColumn("z", F.round(0.6 * (F.col("x") - F.avg("x").over(w)) / _spread("x") + F.col("loss"), 9)).withColumn("n", F.count("*").over(w))
    at = F.floor((F.col("n") - 1) * 0.75 + 0.5)
    k = z.withColumn("at", F.row_number().over(w.orderBy("z")) - 1).withColumn("cut", F.max(F.when(F.col("at") == at, F.col("z"))).over(w))
    return k.where((F.col("n") < 10) | (F.col("z") <= F.col("cut"))).select("code", "period", rounded(F.col("z")).alias("z"))


@query(
    "v07_alpha_scores",
    f"""WITH {m.SQL}, {accounts_sql()}, a AS (SELECT code, period, CAST(period + INTERVAL 16 MONTH AS DATE) AS day, ocf / greatest(assets, 0.01) AS cfo FROM accounts),
b AS (SELECT a.*, p.close AS p0 FROM a ASOF JOIN bars p ON a.code = p.code AND a.day >= p.date), c AS (SELECT b.*, p.close AS p1 FROM b ASOF JOIN bars p ON b.code = p.code AND b.day - 60 >= p.date),
x AS (SELECT code, period, cfo, p0 / nullif(p1, 0) - 1 AS mom FROM c)
SELECT code, period, {r('0.5 * (mom - avg(mom) OVER w) / CASE WHEN stddev_samp(mom) OVER w > 1e-8 THEN stddev_samp(mom) OVER w ELSE 1 END + 0.5 * (cfo - avg(cfo) OVER w) / CASE WHEN stddev_samp(cfo) OVER w > 1e-8 THEN stddev_samp(cfo) OVER w ELSE 1 END')} AS score FROM x WINDOW w AS (PARTITION BY period)""",
)
def alpha_scores(spark, d):
    """Half momentum over 60 days to the end of the next April, half operating cash flow over assets, each by its period's mean and spread."""
    b = m.bars(spark, d).select("code", "date", "close")
    a = accounts(spark, d).select("code", "period", F.add_months("period", 16).alias("day"), (F.col("ocf") / F.greatest("assets", F.lit(0.01))).alias("cfo"))
    now = op.asof_left(a, b, "code", "day", "date", ["close"]).withColumnRenamed("close", "p0").withColumn("earlier", F.date_sub("day", 60))
    both = op.asof_left(now, b, "code", "earlier", "date", ["close"]).where("p0 IS NOT NULL AND close IS NOT NULL")
    x = both.select("code", "period", "cfo", (over(F.col("p0"), F.col("close")) - 1).alias("mom"))
    w = Window.partitionBy("period")
    part = lambda c: (F.col(c) - F.avg(c).over(w)) / _spread(c)
    return x.select("code", "period", rounded(0.5 * part("mom") + 0.5 * part("cfo")).alias("score"))
