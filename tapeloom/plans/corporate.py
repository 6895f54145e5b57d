"""Corporate actions from raw rows to adjusted prices, total returns; with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import by_code, over, rounded, rounded_sql
from tapeloom.operators import frames as op
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m

r = rounded_sql
_BARS = f"WITH {m.SQL}"
PRICES = ("open", "high", "low", "close")
#: Shares that rows of an action refer to.
PER = 10.0

# raw rows of codes divisible by 5, on the third of each year's January and, for those divisible by 15, a second time; by fixed rules in both engines
_RAW = {
    "category": "CASE WHEN copy = 1 AND code % 2 = 0 THEN 5 ELSE 1 END", "cash": "CASE WHEN code % 20 = 0 THEN NULL ELSE 0.5 * (1 + code % 4) END", "split": "CASE WHEN year(day) % 2 = 0 THEN 1.0 ELSE 0.0 END",
    "rights": "CASE WHEN code % 3 = 0 THEN 2.0 ELSE 0.0 END", "rights_price": "CASE WHEN code % 45 = 0 THEN 0.0 ELSE 5.0 END",
}
_EVENTS_SQL = f"""{_BARS}, years AS (SELECT DISTINCT code, CAST(date_trunc('year', date) AS DATE) + 2 AS day FROM bars WHERE code % 5 = 0), now AS (SELECT max(date) AS today FROM bars),
raw AS (SELECT code, day, {', '.join(f'{x} AS {c}' for c, x in _RAW.items())} FROM years, range(2) c(copy) WHERE copy = 0 OR code % 15 = 0),
clean AS (SELECT code, day, coalesce(cash, 0) / {PER} AS cash, coalesce(split, 0) / {PER} AS split, coalesce(rights, 0) / {PER} AS rights, coalesce(rights_price, 0) AS rights_price FROM raw, now
  WHERE category = 1 AND day <= today AND (coalesce(cash, 0) > 0 OR coalesce(split, 0) > 0 OR coalesce(rights, 0) > 0)),
events AS (SELECT code, day, sum(cash) AS cash, sum(split) AS split, sum(rights) AS rights, max(rights_price) AS rights_price FROM clean GROUP BY ALL)"""


def raw_actions(spark, d) -> DataFrame:
    years = m.bars(spark, d).where("code % 5 = 0").select("code", F.date_add(F.trunc("date", "year"), 2).alias("day")).distinct()
    copies = years.withColumn("copy", F.explode(F.when(F.col("code") % 15 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select("code", "day", *(F.expr(x).cast("int" if c == "category" else "double").alias(c) for c, x in _RAW.items()))


def clean_actions(raw: DataFrame, today: Column) -> DataFrame:
    """Dividends, splits and rights of a share, up to today; rows of other kinds, and rows without any of them, go."""
    known = raw.where((F.col("category") == 1) & F.col("day").isNotNull() & (F.col("day") <= today))
    amount = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.lit(0.0))
    per = known.select("code", "day", *((amount(c) / PER).alias(c) for c in ("cash", "split", "rights")), amount("rights_price").alias("rights_price"))
    return per.where("cash > 0 OR split > 0 OR rights > 0")


def actions_by_day(clean: DataFrame) -> DataFrame:
    return clean.groupBy("code", "day").agg(F.sum("cash").alias("cash"), F.sum("split").alias("split"), F.sum("rights").alias("rights"), F.max("rights_price").alias("rights_price"))


def _events(spark, d) -> DataFrame:
    raw = raw_actions(spark, d)
    today = m.bars(spark, d).agg(F.max("date").alias("today"))
    return actions_by_day(clean_actions(raw.crossJoin(F.broadcast(today)), F.col("today")))  # one row


@query("a06_clean_actions", f"{_EVENTS_SQL} SELECT code, day, {r('cash')} AS cash, {r('split')} AS split, {r('rights')} AS rights, {r('rights_price')} AS rights_price FROM clean")
def cleaned_actions(spark, d):
    today = m.bars(spark, d).agg(F.max("date").alias("today"))
    c = clean_actions(raw_actions(spark, d).crossJoin(F.broadcast(today)), F.col("today"))
    return c.select("code", "day", *(rounded(F.col(x)).alias(x) for x in ("cash", "split", "rights", "rights_price")))


@query("a05_actions_by_day", f"{_EVENTS_SQL} SELECT code, day, {r('cash')} AS cash, {r('split')} AS split, {r('rights')} AS rights, {r('rights_price')} AS rights_price FROM events")
def summed_actions(spark, d):
    return _events(spark, d).select("code", "day", *(rounded(F.col(x)).alias(x) for x in ("cash", "split", "rights", "rights_price")))


def _next_bars(bars: DataFrame, events: DataFrame) -> DataFrame:
    """events with the first bar on or after their day, if a bar came before it."""
    b = bars.select("code", "date", "close", F.lag("date").over(by_code()).alias("before"), lag_close().alias("pre_close"))
    met = op.asof_right(events, b, "code", "day", "date", ["date", "close", "before", "pre_close"])
    return met.where("date IS NOT NULL AND before IS NOT NULL")


def lag_close() -> Column:
    return F.lag("close").over(by_code())


_NEXT_SQL = f"{_EVENTS_SQL}, b AS (SELECT code, date, close, lag(date) OVER w AS before, lag(close) OVER w AS pre_close FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)), nxt AS (SELECT e.*, b.date, b.close, b.before, b.pre_close FROM events e ASOF JOIN b ON e.code = b.code AND e.day <= b.date)"


@query("j09_next_bar", f"{_NEXT_SQL} SELECT code, day, date AS next_date, {r('close')} AS next_close, before, {r('pre_close')} AS pre_close FROM nxt WHERE before IS NOT NULL")
def next_bar(spark, d):
    n = _next_bars(m.bars(spark, d), _events(spark, d))
    return n.select("code", "day", F.col("date").alias("next_date"), rounded(F.col("close")).alias("next_close"), "before", rounded(F.col("pre_close")).alias("pre_close"))


def action_factor(n: DataFrame) -> Column:
    """How much a bar's price fell by its action alone: the close before over what it is worth after, to the cent."""
    rights = F.when((F.col("rights") > 0) & (F.col("rights_price") <= 0), 0.0).otherwise(F.col("rights"))
    grown = 1 + F.col("split") + rights
    worth = F.floor((F.col("pre_close") - F.col("cash") + F.col("rights_price") * rights) / grown * 100 + 0.5) / 100
    return F.when(F.col("pre_close") <= 0, grown).when(worth <= 0, 1.0).otherwise(F.col("pre_close") / worth)


def factors(spark, d) -> DataFrame:
    """Bars with the running product of their actions' factors."""
    b = m.bars(spark, d)
    n = _next_bars(b, _events(spark, d))
    of = n.select("code", "date", action_factor(n).alias("f")).groupBy("code", "date").agg(F.product("f").alias("f"))
    w = by_code().rowsBetween(Window.unboundedPreceding, 0)
    return b.join(of, ["code", "date"], "left").withColumn("factor", F.product(F.coalesce("f", F.lit(1.0))).over(w)).drop("f")


_RIGHTS = "CASE WHEN rights > 0 AND rights_price <= 0 THEN 0 ELSE rights END"
_WORTH = f"(floor((pre_close - cash + rights_price * {_RIGHTS}) / (1 + split + {_RIGHTS}) * 100 + 0.5) / 100)"
_FACTORS_SQL = f"""{_NEXT_SQL}, f AS (SELECT code, date, product(CASE WHEN pre_close <= 0 THEN 1 + split + {_RIGHTS} WHEN {_WORTH} <= 0 THEN 1 ELSE pre_close / {_WORTH} END) AS f FROM nxt WHERE before IS NOT NULL GROUP BY ALL),
fb AS (SELECT bars.*, product(coalesce(f, 1)) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS factor FROM bars LEFT JOIN f USING (code, date)),
fr AS (SELECT *, factor / last_value(factor) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS back FROM fb)"""


@query("f51_action_factors", f"{_FACTORS_SQL} SELECT code, date, {r('factor')} AS factor FROM fb")
def action_factors(spark, d):
    return factors(spark, d).select("code", "date", rounded(F.col("factor")).alias("factor"))


def _ratios(spark, d) -> DataFrame:
    last = F.last("factor").over(by_code().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return factors(spark, d).withColumn("back", F.col("factor") / last)


@query("f52_factor_ratios", f"{_FACTORS_SQL} SELECT code, date, {r('back')} AS back_ratio, {r('factor')} AS forward_ratio FROM fr")
def factor_ratios(spark, d):
    return _ratios(spark, d).select("code", "date", rounded(F.col("back")).alias("back_ratio"), rounded(F.col("factor")).alias("forward_ratio"))


@query("f53_adjusted_prices", f"{_FACTORS_SQL} SELECT code, date, {', '.join(f'{r(f"{c} * back")} AS {c}' for c in PRICES)}, {r('back')} AS adj_factor FROM fr")
def adjusted_prices(spark, d):
    """All four prices in the money of the last bar, and the ratio."""
    return _ratios(spark, d).select("code", "date", *(rounded(F.col(c) * F.col("back")).alias(c) for c in PRICES), rounded(F.col("back")).alias("adj_factor"))


@query("j18_factor_join", f"{_FACTORS_SQL} SELECT code, date, {r('close')} AS close, CASE WHEN day(date) % 7 <> 0 THEN {r('factor')} END AS factor FROM fb")
def factor_join(spark, d):
    """Prices with the stored factor of their day; some days have none."""
    f = factors(spark, d).where("day(date) % 7 <> 0").select("code", "date", "factor")
    return m.bars(spark, d).join(f, ["code", "date"], "left").select("code", "date", rounded(F.col("close")).alias("close"), rounded(F.col("factor")).alias("factor"))


# total return
YIELD = 0.02
_TOTAL_SQL = f"""{_BARS}, e AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS place FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
t AS (SELECT *, first_value(close) OVER w * product(CASE WHEN place = 1 THEN 1 ELSE 1 + coalesce(ret, 0) + {YIELD} / 252 END) OVER w AS total FROM e WINDOW w AS (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING))"""


def total_return(spark, d) -> DataFrame:
    """Bars with `total`: the first close, grown by each bar's return and a day's dividend yield."""
    w = by_code().rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.row_number().over(by_code()) == 1, 1.0).otherwise(1 + F.coalesce(over(F.col("close"), lag_close()) - 1, F.lit(0.0)) + YIELD / 252)
    return m.bars(spark, d).withColumn("step", step).withColumn("total", F.first("close").over(w) * F.exp(F.sum(F.log("step")).over(w))).drop("step")


@query("f54_total_return", f"{_TOTAL_SQL} SELECT code, date, {', '.join(f'{r(f"{c} * total / close", 2)} AS {c}' for c in PRICES)} FROM t")
def total_return_bars(spark, d):
    return total_return(spark, d).select("code", "date", *(rounded(F.col(c) * F.col("total") / F.col("close"), 2).alias(c) for c in PRICES))


@query(
    "f55_dividend_spread",
    f"""{_TOTAL_SQL}, g AS (SELECT code, date_diff('day', min(date), max(date)) / 365.25 AS years, arg_max(close, date) / arg_min(close, date) AS a, arg_max(total, date) / arg_min(total, date) AS b FROM t GROUP BY code HAVING min(date) < max(date))
SELECT code, {r('years', 4)} AS years, {r('(pow(a, 1 / years) - 1) * 100', 4)} AS price_cagr, {r('(pow(b, 1 / years) - 1) * 100', 4)} AS total_cagr, {r('(pow(b, 1 / years) - pow(a, 1 / years)) * 100', 4)} AS spread, {r('b / a', 4)} AS wealth FROM g""",
)
def dividend_spread(spark, d):
    """What dividends add a year, and in all."""
    multiple = lambda c: F.max_by(c, "date") / F.min_by(c, "date")
    g = total_return(spark, d).groupBy("code").agg((F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), multiple("close").alias("a"), multiple("total").alias("b")).where("years > 0")
    a, b = (F.pow(c, 1 / F.col("years")) for c in "ab")
    return g.select("code", rounded(F.col("years"), 4).alias("years"), rounded((a - 1) * 100, 4).alias("price_cagr"), rounded((b - 1) * 100, 4).alias("total_cagr"), rounded((b - a) * 100, 4).alias("spread"), rounded(F.col("b") / F.col("a"), 4).alias("wealth"))


# calendars
@query("j10_settlement_days", f"{_BARS}, c AS (SELECT DISTINCT date FROM bars), f AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM bars), x AS (SELECT month, month + CAST((12 - dayofweek(month)) % 7 + 14 AS INTEGER) AS friday FROM f) SELECT month, friday, (SELECT min(date) FROM c WHERE date >= friday) AS settles FROM x")
def settlement_days(spark, d):
    """The third Friday of each month, moved on to the next date with trading."""
    days = m.bars(spark, d).select("date").distinct().withColumn("market", F.lit(1))
    fridays = days.select(F.trunc("date", "month").alias("month")).distinct().select("month", op.third_friday(F.col("month")).alias("friday"), F.lit(1).alias("market"))
    met = op.asof_right(fridays, days.withColumn("settles", F.col("date")), "market", "friday", "date", ["settles"])  # a row a date
    return met.select("month", "friday", "settles")


@query("f56_backtest_frame", f"{_BARS} SELECT code, date, {r('coalesce(lag(close) OVER w, open)')} AS pre_close, {r('coalesce(lag(v) OVER w, v)')} AS adv FROM (SELECT *, avg(volume) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING) AS v FROM bars) WINDOW w AS (PARTITION BY code ORDER BY date)")
def backtest_frame(spark, d):
    """What a replay needs beside the bars: the close before (the open on the first day) and the mean volume of 20 bars up to the one before."""
    b = m.bars(spark, d).withColumn("v", F.avg("volume").over(by_code().rowsBetween(-19, 0)))
    return b.select("code", "date", rounded(F.coalesce(lag_close(), F.col("open"))).alias("pre_close"), rounded(F.coalesce(F.lag("v").over(by_code()), F.col("v"))).alias("adv"))
