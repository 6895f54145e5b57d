"""Cleaning, corporate actions, recursive indicators, regimes, cross-section, sizing and signal rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import arrays
from tapeloom.functions import factors as fx
from tapeloom.functions.windows import by_code, gated, gated_sql, lag, lag_sql, over, rounded, rounded_sql, trailing
from tapeloom.operators import frames as op
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m

r = rounded_sql
_BARS = f"WITH {m.SQL}"
_RET = f"WITH {m.SQL}, {fx.ENRICHED_SQL}"
_BY = "OVER (PARTITION BY code ORDER BY date)"


def _enriched(spark, d) -> DataFrame:
    return fx.enriched(m.bars(spark, d))


# all factors and indicators at once: arrays over the rows of many codes, no exchange
@query("c06_all_factors", f"{_RET} SELECT code, date, {', '.join(f'{r(sql)} AS {name}' for name, (_, sql) in fx.FACTORS.items())} FROM enriched")
def all_factors(spark, d):
    made = arrays.by_code(m.bars(spark, d), {name: arrays.FACTORS[name] for name in fx.FACTORS})
    return made.select("code", "date", *(rounded(F.col(name)).alias(name) for name in fx.FACTORS))


# cleaning and normalisation
def clean_bars(rows: DataFrame) -> DataFrame:
    """Bars without a date or close go, missing volume is 0, missing prices are carried on, of a day the last row stays, high and low enclose the bar.

    Columns are found whatever their case, volume also as vol; one that is missing is an error, as made-up amounts would
    spoil what is computed from them. Values that are no numbers are null; an amount that is null stays so."""
    names = {c.lower(): c for c in rows.columns}
    names["volume"] = names.get("volume", names.get("vol"))
    missing = [c for c in ("code", "date", "seq", "open", "high", "low", "close", "volume", "amount") if not names.get(c)]
    if missing:
        raise ValueError(f"bars without {', '.join(missing)}")
    numbers = [F.expr(f"try_cast(`{names[c]}` AS double)").alias(c) for c in ("open", "high", "low", "close", "volume", "amount")]
    rows = rows.select(*(F.col(names[c]).alias(c) for c in ("code", "date", "seq")), *numbers)
    w = Window.partitionBy("code").orderBy("date", "seq")
    carried = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c)
    known = rows.where("code is not null and date is not null and close is not null")
    filled = known.select("code", "date", "seq", carried("open"), carried("high"), carried("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), "amount")
    last = op.first_in(filled, ["code", "date"], [F.desc("seq")]).drop("rank", "seq")
    top, bottom = F.greatest("high", "low"), F.least("high", "low")
    return last.select("code", "date", "open", F.greatest("open", "close", top).alias("high"), F.least("open", "close", bottom).alias("low"), "close", "volume", "amount")


#: Bars with faults by a fixed rule: gaps, high and low exchanged, lost volume, a second row of the day.
_FAULTS = {
    "open": "CASE WHEN code % 7 = 0 AND day(date) % 3 = 0 THEN NULL ELSE open END",
    "high": "CASE WHEN code % 5 = 0 THEN low ELSE high END",
    "low": "CASE WHEN code % 5 = 0 THEN high ELSE low END",
    "close": "CASE WHEN day(date) = 13 THEN NULL ELSE close END",
    "volume": "CASE WHEN day(date) % 4 = 0 THEN NULL ELSE volume END",
    "amount": "CASE WHEN day(date) % 6 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR(40)) END",
}
_DIRTY = f"dirty AS (SELECT code, date, 0 AS seq, {', '.join(f'{x} AS {c}' for c, x in _FAULTS.items())} FROM bars UNION ALL SELECT code, date, 1, open + 1, high + 1, low, close + 1, volume, CAST(amount AS VARCHAR) FROM bars WHERE day(date) % 5 = 0)"


@query(
    "p10_clean_bars",
    f"""{_BARS}, {_DIRTY}, k AS (SELECT * FROM dirty WHERE close IS NOT NULL),
f AS (SELECT code, date, seq, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low, close, coalesce(volume, 0) AS volume, TRY_CAST(amount AS DOUBLE) AS amount
  FROM k WINDOW w AS (PARTITION BY code ORDER BY date, seq ROWS UNBOUNDED PRECEDING)),
u AS (SELECT code, date, arg_max(row(open, high, low, close, volume, amount), seq) AS x FROM f GROUP BY code, date)
SELECT code, date, {r('x[1]')} AS open, {r('greatest(x[1], x[2], x[3], x[4])')} AS high, {r('least(x[1], x[2], x[3], x[4])')} AS low, {r('x[4]')} AS close, x[5] AS volume, {r('x[6]', 2)} AS amount FROM u""",
)
def cleaned(spark, d):
    b = m.bars(spark, d)
    dirty = b.select("code", "date", F.lit(0).alias("seq"), *(F.expr(x).alias(c) for c, x in _FAULTS.items()))
    again = b.where("day(date) % 5 = 0").select("code", "date", F.lit(1).alias("seq"), (F.col("open") + 1).alias("open"), (F.col("high") + 1).alias("high"), "low", (F.col("close") + 1).alias("close"), "volume", F.col("amount").cast("string").alias("amount"))
    return clean_bars(dirty.unionByName(again)).select("code", "date", *(rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "volume", rounded(F.col("amount"), 2).alias("amount"))


@query("p05_change_amplitude", f"{_BARS}, p AS (SELECT *, CASE WHEN lag(close) {_BY} > 0 THEN lag(close) {_BY} WHEN open > 0 THEN open END AS base FROM bars) SELECT code, date, {r('coalesce((close - base) / base * 100, 0)')} AS change_rate, {r('coalesce((high - low) / base * 100, 0)')} AS amplitude FROM p")
def change_amplitude(spark, d):
    b = m.bars(spark, d).withColumn("prev", lag("close"))
    base = F.when(F.col("prev") > 0, F.col("prev")).when(F.col("open") > 0, F.col("open"))
    percent = lambda x: rounded(F.coalesce(x / base * 100, F.lit(0.0)))
    return b.select("code", "date", percent(F.col("close") - base).alias("change_rate"), percent(F.col("high") - F.col("low")).alias("amplitude"))


@query("p14_date_slice", f"{_BARS} SELECT code, date, {r('close')} AS close FROM bars WHERE date >= DATE '1997-03-01' AND date <= DATE '1997-06-30'")
def date_slice(spark, d):
    return m.bars_between(spark, d, "1997-03-01", "1997-06-30").select("code", "date", rounded(F.col("close")).alias("close"))


@query("u01_union_aligned", f"{_BARS} SELECT code, date, {r('close')} AS close, NULL::DOUBLE AS revenue FROM bars WHERE code % 10 = 1 UNION ALL SELECT l_suppkey, CAST(l_shipdate AS DATE), NULL, {r('l_extendedprice * (1 - l_discount)')} FROM lineitem WHERE l_suppkey % 10 = 2")
def union_aligned(spark, d):
    a = m.bars(spark, d).where("code % 10 = 1").select("code", "date", rounded(F.col("close")).alias("close"))
    b = m.table(spark, d, "lineitem").where("l_suppkey % 10 = 2").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date"), rounded(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u02_last_per_year", f"{_BARS} SELECT code, CAST(year(date) AS INTEGER) AS year, {r('arg_max(close, date)')} AS close FROM bars GROUP BY ALL")
def last_per_year(spark, d):
    b = m.bars(spark, d).withColumn("year", F.year("date"))
    return op.first_in(b, ["code", "year"], [F.desc("date")]).select("code", "year", rounded(F.col("close")).alias("close"))


# corporate actions: codes divisible by 5, on the first day of a year; 1 percent in cash, a tenth in shares in even years
_ACTIONS = "actions AS (SELECT DISTINCT code, CAST(date_trunc('year', date) AS DATE) AS day, 0.99 / CASE WHEN year(date) % 2 = 0 THEN 1.1 ELSE 1.0 END AS factor FROM bars WHERE code % 5 = 0)"


def actions(bars: DataFrame) -> DataFrame:
    years = bars.where("code % 5 = 0").select("code", F.trunc("date", "year").alias("day")).distinct()
    return years.withColumn("factor", 0.99 / F.when(F.year("day") % 2 == 0, 1.1).otherwise(1.0))


@query("f53_adjusted_close", f"{_BARS}, {_ACTIONS} SELECT b.code, b.date, {r('b.close * coalesce((SELECT product(factor) FROM actions a WHERE a.code = b.code AND a.day > b.date), 1)')} AS adjusted FROM bars b")
def adjusted_close(spark, d):
    """A bar's close times the factors of all later actions: a running sum of logarithms from the end, no range join."""
    b = m.bars(spark, d)
    rows = b.select("code", "date", "close", F.lit(0.0).alias("f")).unionByName(actions(b).select("code", F.col("day").alias("date"), F.lit(None).cast("double").alias("close"), F.log("factor").alias("f")))
    later = Window.partitionBy("code").orderBy(F.desc("date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = Window.partitionBy("code", "date")
    return rows.withColumn("sum", F.sum("f").over(later) - F.sum("f").over(own)).where("close is not null").select("code", "date", rounded(F.col("close") * F.exp("sum")).alias("adjusted"))


# recursive indicators
def _recursion(x: str, a: str) -> str:
    return f"list_reduce(list_transform({x}, lambda v: [v]), lambda y, v: list_append(y, y[-1] * (1 - {a}) + {a} * v[1]))"


_RSI = f"CASE WHEN l[i] = 0 THEN 50 ELSE 100 - 100 / (1 + g[i] / l[i]) END"


@query(
    "w06_wilder_rsi",
    f"""{_RET}, s AS (SELECT code, list(date ORDER BY date) AS d, list(greatest(coalesce(delta, 0), 0.0) ORDER BY date) AS up, list(greatest(-coalesce(delta, 0), 0.0) ORDER BY date) AS down FROM enriched GROUP BY code),
e AS (SELECT code, d, {_recursion('up', '(1.0 / 14)')} AS g, {_recursion('down', '(1.0 / 14)')} AS l FROM s), x AS (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM e) SELECT code, d[i] AS date, {r(_RSI, 4)} AS rsi FROM x""",
)
def wilder_rsi(spark, d):
    e = op.exponential_mean(_enriched(spark, d).select("code", "date", fx.gain().alias("up"), fx.loss().alias("down")), {"g": ("up", 1 / 14), "l": ("down", 1 / 14)})
    return e.select("code", "date", rounded(F.when(F.col("l") == 0, 50.0).otherwise(100 - 100 / (1 + over(F.col("g"), F.col("l")))), 4).alias("rsi"))


@query(
    "w15_heikin_ashi",
    f"""{_BARS}, s AS (SELECT code, list(row(date, high, low, (open + high + low + close) / 4) ORDER BY date) AS b, list((open + close) / 2 ORDER BY date)[1] AS first FROM bars GROUP BY code),
e AS (SELECT code, b, {_recursion('list_prepend(first, list_transform(b[1:len(b) - 1], lambda v: v[4]))', '0.5')} AS o FROM s), x AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM e)
SELECT code, b[i][1] AS date, {r('o[i] + 1e-7', 4)} AS ha_open, {r('greatest(b[i][2], o[i], b[i][4]) + 1e-7', 4)} AS ha_high, {r('least(b[i][3], o[i], b[i][4]) + 1e-7', 4)} AS ha_low, {r('b[i][4] + 1e-7', 4)} AS ha_close FROM x""",
)
def heikin_ashi(spark, d):
    b = m.bars(spark, d).withColumn("c", F.expr("(open + high + low + close) / 4"))
    e = op.exponential_mean(b.select("code", "date", "high", "low", "c", F.coalesce(lag("c"), F.expr("(open + close) / 2")).alias("x")), {"o": ("x", 0.5)})
    value = lambda x, name: rounded(x + 1e-7, 4).alias(name)  # noqa: E731 (halves are frequent: a hair above them)
    return e.select("code", "date", value(F.col("o"), "ha_open"), value(F.greatest("high", "o", "c"), "ha_high"), value(F.least("low", "o", "c"), "ha_low"), value(F.col("c"), "ha_close"))


# entropy, volume trend, regimes
def entropy(x: str, n: int = 60, bins: int = 10):
    """Entropy in bits of the last n values over equal bins between their least and greatest; 0 where they are equal."""
    v = F.collect_list(x).over(trailing(n))

    def bits(w):  # a lambda binds the values with their limits, and the bins, so that each is computed once
        place = F.transform(w["v"], lambda y: F.least(F.floor((y - w["low"]) / (w["high"] - w["low"]) * bins), F.lit(bins - 1)))
        shares = F.transform(F.array(place), lambda q: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(q, lambda i: i == k)) / F.size(q)))
        total = F.aggregate(F.get(shares, F.lit(0)), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
        return F.when(w["high"] > w["low"], total).otherwise(0.0)

    bound = F.struct(v.alias("v"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    return F.when(F.size(v) >= n, F.get(F.transform(F.array(bound), bits), F.lit(0)))


_ENTROPY = """h AS (SELECT code, date, list(coalesce(ret, 0)) OVER (PARTITION BY code ORDER BY date ROWS 59 PRECEDING) AS v FROM enriched),
c AS (SELECT *, list_min(v) AS low, list_max(v) AS high FROM h),
b AS (SELECT code, date, len(v) AS n, low, high, list_transform(v, lambda y: least(floor((y - low) / nullif(high - low, 0) * 10), 9)) AS bins FROM c),
u AS (SELECT code, date, CASE WHEN n >= 60 THEN CASE WHEN high > low THEN list_entropy(bins) ELSE 0 END END AS entropy FROM b)"""


def _with_entropy(spark, d) -> DataFrame:
    return _enriched(spark, d).withColumn("ret0", F.coalesce("ret", F.lit(0.0))).withColumn("entropy", entropy("ret0"))


@query("w07_entropy", f"{_RET}, {_ENTROPY} SELECT code, date, {r('entropy')} AS entropy FROM u")
def market_entropy(spark, d):
    return _with_entropy(spark, d).select("code", "date", rounded(F.col("entropy")).alias("entropy"))


@query("w14_volume_trend", f"{_RET} SELECT code, {r('sum(volume * sign(coalesce(delta, 0))) / nullif(avg(volume), 0) / count(*)')} AS trend FROM enriched GROUP BY code")
def volume_trend(spark, d):
    return _enriched(spark, d).groupBy("code").agg(rounded(over(F.sum(F.col("volume") * F.signum(F.coalesce("delta", F.lit(0.0)))), F.avg("volume")) / F.count("*")).alias("trend"))


@query("e03_trend_regime", f"{_BARS}, a AS (SELECT code, date, close, {gated_sql('avg', 'close', 120)} AS slow, {gated_sql('avg', 'close', 60)} AS mid FROM bars) SELECT code, date, CASE WHEN slow IS NULL THEN 'range' WHEN close > slow * 1.02 AND mid > slow THEN 'bull' WHEN close < slow * 0.98 THEN 'bear' ELSE 'range' END AS regime FROM a")
def trend_regime(spark, d):
    slow, mid, close = F.col("slow"), F.col("mid"), F.col("close")
    means = arrays.by_code(m.bars(spark, d), {"slow": lambda g: g.mean(g.close, 120), "mid": lambda g: g.mean(g.close, 60)}, keep=("close",), reach=120)
    return means.select("code", "date", F.when(slow.isNull(), "range").when((close > slow * 1.02) & (mid > slow), "bull").when(close < slow * 0.98, "bear").otherwise("range").alias("regime"))


@query("f14_idiosyncratic_vol", f"{_RET}, x AS (SELECT code, date, ret - {gated_sql('avg', 'ret', 5)} AS own FROM enriched) SELECT code, date, {r('-1 * ' + gated_sql('stddev_samp', 'own', 20, 10) + ' * sqrt(252)')} AS value FROM x")
def idiosyncratic_vol(spark, d):
    own = _enriched(spark, d).withColumn("own", F.col("ret") - gated(F.avg, "ret", 5))
    return own.select("code", "date", rounded(-gated(F.stddev_samp, "own", 20, 10) * fx.YEAR).alias("value"))


# cross-section and aggregates
@query("a04_intraday_to_daily", "SELECT user_id AS code, CAST(ts AS DATE) AS date, round(arg_min(value, row(ts, event_id)), 6) AS open, round(arg_max(value, row(ts, event_id)), 6) AS close, round(sum(value), 4) AS amount, count(*) AS bars, round(coalesce(sum(value) FILTER (WHERE hour(ts) * 60 + minute(ts) >= 870), 0), 4) AS late FROM events GROUP BY ALL")
def intraday_to_daily(spark, d):
    e, order = m.table(spark, d, "events"), F.struct("ts", "event_id")
    late = F.coalesce(F.sum(F.when(F.hour("ts") * 60 + F.minute("ts") >= 870, F.col("value"))), F.lit(0.0))
    return e.groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("date")).agg(
        F.round(F.min_by("value", order), 6).alias("open"), F.round(F.max_by("value", order), 6).alias("close"), F.round(F.sum("value"), 4).alias("amount"), F.count("*").alias("bars"), F.round(late, 4).alias("late")
    )


_MOMENTUM = f"{_BARS}, p AS (SELECT code, date, {fx.change_sql('close', 20)} AS x FROM bars)"


def _momentum(spark, d) -> DataFrame:
    return m.bars(spark, d).select("code", "date", fx.change("close", 20).alias("x"))


@query("a11_cross_section", f"{_MOMENTUM} SELECT date, count(x) AS n, {r('avg(x)')} AS mean, {r('stddev_pop(x)')} AS std FROM p GROUP BY date")
def cross_section(spark, d):
    return _momentum(spark, d).groupBy("date").agg(F.count("x").alias("n"), rounded(F.avg("x")).alias("mean"), rounded(F.stddev_pop("x")).alias("std"))


@query("a10_sector_exposure", f"{_BARS}, {m.SECURITIES_SQL} SELECT sector, count(*) AS n, round(sum(amount), 2) AS amount FROM bars JOIN securities USING (code) GROUP BY sector")
def sector_exposure(spark, d):
    return m.bars(spark, d).join(m.securities(spark, d), "code").groupBy("sector").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


_LATEST = f"{_MOMENTUM}, {m.SECURITIES_SQL}, l AS (SELECT code, arg_max(coalesce(x, 0), date) AS x FROM p GROUP BY code)"


@query("t03_sector_then_global_top", f"{_LATEST}, k AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY x DESC, code) AS place FROM l JOIN securities USING (code)) SELECT code, sector, {r('x')} AS x FROM (SELECT * FROM k WHERE place <= 3 ORDER BY x DESC, code LIMIT 20)")
def sector_then_global_top(spark, d):
    latest = _momentum(spark, d).groupBy("code").agg(F.max_by(F.coalesce("x", F.lit(0.0)), "date").alias("x"))
    top = op.first_in(latest.join(m.securities(spark, d), "code"), ["sector"], [F.desc("x"), "code"], 3)
    return top.orderBy(F.desc("x"), "code").limit(20).select("code", "sector", rounded(F.col("x")).alias("x"))


@query("t10_quintiles", f"{_MOMENTUM}, q AS (SELECT date, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM p WHERE x IS NOT NULL GROUP BY date) SELECT code, date, CAST(1 + (x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT + (x > e[4])::INT AS INTEGER) AS bucket FROM p JOIN q USING (date) WHERE x IS NOT NULL")
def quintiles(spark, d):
    p = _momentum(spark, d).where("x is not null")
    edges = p.groupBy("date").agg(F.percentile("x", F.array(*map(F.lit, (0.2, 0.4, 0.6, 0.8)))).alias("e"))
    return p.join(edges, "date").select("code", "date", (1 + F.size(F.filter("e", lambda y: F.col("x") > y))).alias("bucket"))


@query("c15b_newey_west", f"{_MOMENTUM}, s AS (SELECT date, avg(x) AS v FROM p WHERE x IS NOT NULL GROUP BY date), c AS (SELECT date, v - avg(v) OVER () AS e, avg(v) OVER () AS mean, count(*) OVER () AS n FROM s), g AS (SELECT max(mean) AS mean, max(n) AS n, sum(e * e) / max(n) AS g0, " + ", ".join(f"sum(e * e{k}) / max(n) AS g{k}" for k in range(1, 5)) + " FROM (SELECT *, " + ", ".join(f"lag(e, {k}) OVER (ORDER BY date) AS e{k}" for k in range(1, 5)) + f" FROM c)) SELECT n, {r('mean / sqrt((g0 + 2 * (0.8 * g1 + 0.6 * g2 + 0.4 * g3 + 0.2 * g4)) / n)', 5)} AS t FROM g")
def newey_west(spark, d):
    """Of the mean cross-section by date, four lags with Bartlett weights; one row a date reaches the window over all dates."""
    s = _momentum(spark, d).where("x is not null").groupBy("date").agg(F.avg("x").alias("v"))
    c = s.crossJoin(s.agg(F.avg("v").alias("mean"), F.count("*").alias("n"))).withColumn("e", F.col("v") - F.col("mean"))
    w = Window.orderBy("date")
    for k in range(1, 5):
        c = c.withColumn(f"e{k}", F.lag("e", k).over(w))
    g = c.agg(F.max("mean").alias("mean"), F.max("n").alias("n"), F.sum(F.col("e") * F.col("e")).alias("g0"), *(F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(1, 5)))
    variance = (F.col("g0") + 2 * sum((1 - k / 5) * F.col(f"g{k}") for k in range(1, 5))) / F.col("n")
    return g.select("n", rounded(F.col("mean") / F.sqrt(variance / F.col("n")), 5).alias("t"))


# names, ticks, lots, limits
@query("x07_lots", f"{_BARS} SELECT code, date, CAST(floor(volume * 37 / 100) * 100 AS BIGINT) AS down, CAST(ceil(volume * 37 / 100) * 100 AS BIGINT) AS up FROM bars")
def lots(spark, d):
    return m.bars(spark, d).select("code", "date", (F.floor(F.col("volume") * 37 / 100) * 100).alias("down"), (F.ceil(F.col("volume") * 37 / 100) * 100).alias("up"))


@query("x13_contract", r"SELECT c, regexp_extract(c, '^([A-Z]+)(\d{4})$', 1) AS variety, 2000 + CAST(regexp_extract(c, '^([A-Z]+)(\d{2})(\d{2})$', 2) AS INTEGER) AS year, CAST(regexp_extract(c, '^([A-Z]+)(\d{2})(\d{2})$', 3) AS INTEGER) AS month FROM (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'IF' ELSE 'IC' END || strftime(l_shipdate, '%y%m') AS c FROM lineitem)")
def contract(spark, d):
    c = m.table(spark, d, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "IF").otherwise("IC"), F.date_format("l_shipdate", "yyMM")).alias("c")).distinct()
    part = lambda k: F.regexp_extract("c", r"^([A-Z]+)(\d{2})(\d{2})$", k)
    return c.select("c", part(1).alias("variety"), (2000 + part(2).cast("int")).alias("year"), part(3).cast("int").alias("month"))


#: Daily limits by board; the main board's on the first day; days without any limit after listing.
_BOARDS, _FIRST_DAY, _FREE = {"gem": (1.2, 0.8), "main": (1.1, 0.9), "beijing": (1.3, 0.7)}, (1.44, 0.64), {"gem": 5, "beijing": 1}
_BOARD = "CASE code % 3 WHEN 0 THEN 'gem' WHEN 1 THEN 'main' ELSE 'beijing' END"
_LIMIT_OF = " ".join(f"WHEN '{k}' THEN {{}}" for k in _BOARDS)


def limits(board: Column, listed: Column) -> tuple[Column, Column]:
    """(highest, lowest) close over the close before that a board allows on the `listed`-th day; null where there is no limit."""
    free = F.coalesce(*(F.when((board == b) & (listed <= n), True) for b, n in _FREE.items()), F.lit(False))
    first = (board == "main") & (listed == 1)
    of = lambda i: F.when(free, None).when(first, _FIRST_DAY[i]).otherwise(F.coalesce(*(F.when(board == b, x[i]) for b, x in _BOARDS.items())))
    return of(0), of(1)


@query(
    "x22_limit_status",
    f"""{_BARS}, l AS (SELECT code, date, close, {_BOARD} AS board, row_number() OVER w AS listed, coalesce(lag(close) OVER w, open) AS pre FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
k AS (SELECT *, CASE WHEN board = 'gem' AND listed <= 5 OR board = 'beijing' AND listed <= 1 THEN NULL WHEN board = 'main' AND listed = 1 THEN 1.44::DOUBLE ELSE CASE board {_LIMIT_OF.format(*(x[0] for x in _BOARDS.values()))} END::DOUBLE END AS up,
  CASE WHEN board = 'gem' AND listed <= 5 OR board = 'beijing' AND listed <= 1 THEN NULL WHEN board = 'main' AND listed = 1 THEN 0.64::DOUBLE ELSE CASE board {_LIMIT_OF.format(*(x[1] for x in _BOARDS.values()))} END::DOUBLE END AS down, CASE WHEN pre >= 1 THEN 100 ELSE 1000 END AS tick FROM l)
SELECT code, date, board, coalesce(close / pre >= up - 0.001, false) AS limit_up, coalesce(close / pre <= down + 0.001, false) AS limit_down, coalesce(close / pre < up - 0.001, true) AS can_buy, coalesce(close / pre > down + 0.001, true) AS can_sell,
  floor(pre * up * tick + 0.5) / tick AS up_price, floor(pre * down * tick + 0.5) / tick AS down_price, {r('close / pre', 4)} AS ratio FROM k""",
)
def limit_status(spark, d):
    """Whether a close stands at its board's limit, within a thousandth. New listings have none for some days, or wider ones; the first day is measured from its open."""
    w = by_code()
    b = m.bars(spark, d).select("code", "date", "close", F.expr(_BOARD).alias("board"), F.row_number().over(w).alias("listed"), F.coalesce(F.lag("close").over(w), F.col("open")).alias("pre"))
    up, down = limits(F.col("board"), F.col("listed"))
    b = b.withColumns({"up": up, "down": down, "ratio": over(F.col("close"), F.col("pre")), "tick": F.when(F.col("pre") >= 1, 100).otherwise(1000)})
    said = lambda c, default: F.coalesce(c, F.lit(default))
    price = lambda c: F.floor(F.col("pre") * F.col(c) * F.col("tick") + 0.5) / F.col("tick")
    ratio = F.col("ratio")
    return b.select(
        "code", "date", "board", said(ratio >= F.col("up") - 0.001, False).alias("limit_up"), said(ratio <= F.col("down") + 0.001, False).alias("limit_down"), said(ratio < F.col("up") - 0.001, True).alias("can_buy"),
        said(ratio > F.col("down") + 0.001, True).alias("can_sell"), price("up").alias("up_price"), price("down").alias("down_price"), rounded(ratio, 4).alias("ratio"),
    )


@query("x31_half_life_mean", f"{_RET}, k AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) - 1 AS age FROM enriched WHERE ret IS NOT NULL) SELECT code, {r('sum(ret * pow(2, -age / 20.0)) / sum(pow(2, -age / 20.0))')} AS mean FROM k WHERE age < 250 GROUP BY code")
def half_life_mean(spark, d):
    age = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))) - 1
    k = _enriched(spark, d).where("ret is not null").withColumn("age", age).where("age < 250").withColumn("weight", F.exp(-F.col("age") * F.log(F.lit(2.0)) / 20))
    return k.groupBy("code").agg(rounded(F.sum(F.col("ret") * F.col("weight")) / F.sum("weight")).alias("mean"))


# risk and signals
_SCENARIOS = {"crash": -0.2, "correction": -0.1, "rally": 0.15}


@query("r07_stress", f"{_RET}, v AS (SELECT code, stddev_samp(ret) * sqrt(252) AS vol FROM enriched GROUP BY code) SELECT code, scenario, {r('(1 + shock) * (1 - 0.5 * vol) - 1')} AS loss FROM v, (VALUES {', '.join(f'({k!r}, {x})' for k, x in _SCENARIOS.items())}) s(scenario, shock)")
def stress(spark, d):
    v = _enriched(spark, d).groupBy("code").agg((F.stddev_samp("ret") * fx.YEAR).alias("vol"))
    cases = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), F.lit(x).alias("shock")) for k, x in _SCENARIOS.items())))
    return v.select("code", "vol", cases.alias("s")).select("code", "s.scenario", rounded((1 + F.col("s.shock")) * (1 - 0.5 * F.col("vol")) - 1).alias("loss"))


@query("r09_rolling_drawdown", f"{_BARS} SELECT code, date, {r(fx.worst_fall_sql('close', 60))} AS drawdown FROM bars")
def rolling_drawdown(spark, d):
    return m.bars(spark, d).select("code", "date", rounded(fx.worst_fall("close", 60)).alias("drawdown"))


@query("r13_kelly", f"{_RET}, k AS (SELECT code, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS p, avg(ret) FILTER (WHERE ret > 0) AS win, -avg(ret) FILTER (WHERE ret <= 0) AS loss FROM enriched WHERE ret IS NOT NULL GROUP BY code) SELECT code, {r('greatest(least(coalesce(p - (1 - p) / nullif(win / nullif(loss, 0), 0), 0), 1.0), 0.0)')} AS kelly FROM k")
def kelly(spark, d):
    up = F.col("ret") > 0
    k = _enriched(spark, d).where("ret is not null").groupBy("code").agg(F.avg(up.cast("double")).alias("p"), F.avg(F.when(up, F.col("ret"))).alias("win"), (-F.avg(F.when(~up, F.col("ret")))).alias("loss"))
    return k.select("code", rounded(F.greatest(F.least(F.coalesce(F.col("p") - over(1 - F.col("p"), over(F.col("win"), F.col("loss"))), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))).alias("kelly"))


@query("g13_consensus", f"WITH {m.SIGNALS_SQL}, c AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE direction > 0) AS up, count(*) FILTER (WHERE direction < 0) AS down FROM signals GROUP BY symbol) SELECT symbol, CASE WHEN up >= down THEN 'bullish' ELSE 'bearish' END AS side, {r('greatest(up, down) / n')} AS share, greatest(up, down) / n >= 0.6 AS reached FROM c")
def consensus(spark, d):
    s = op.majority(m.signals(spark, d), "symbol")
    share = F.greatest("up", "down") / F.col("n")
    return s.select("symbol", F.when(F.col("up") >= F.col("down"), "bullish").otherwise("bearish").alias("side"), rounded(share).alias("share"), (share >= 0.6).alias("reached"))


@query("g15_source_weights", f"WITH {m.SIGNALS_SQL}, p AS (SELECT source, avg(confidence) AS p FROM signals GROUP BY source) SELECT source, {r('greatest(0.1, p / sum(p) OVER ())')} AS weight FROM p")
def source_weights(spark, d):
    p = m.signals(spark, d).groupBy("source").agg(F.avg("confidence").alias("p"))
    return p.crossJoin(p.agg(F.sum("p").alias("all"))).select("source", rounded(F.greatest(F.lit(0.1), F.col("p") / F.col("all"))).alias("weight"))


@query("e01_liquidity_regime", f"""{_RET}, {_ENTROPY}, z AS (SELECT e.code, e.date, round(u.entropy, 9) AS entropy, {fx.FACTORS['w08_turnover_z'][1].replace('PARTITION BY code', 'PARTITION BY e.code').replace('ORDER BY date', 'ORDER BY e.date')} AS z FROM enriched e JOIN u ON e.code = u.code AND e.date = u.date),
k AS (SELECT *, (entropy - min(entropy) OVER w) / nullif(max(entropy) OVER w - min(entropy) OVER w, 0) AS place FROM z WINDOW w AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING))
SELECT code, date, CASE WHEN place < 0.2 - 1e-9 THEN 'FROZEN' WHEN abs(z) > 3 THEN 'STRESSED' ELSE 'NORMAL' END AS regime FROM k""")
def liquidity_regime(spark, d):
    w, x = trailing(60), F.col("entropy")
    e = _with_entropy(spark, d).withColumn("entropy", F.round("entropy", 9)).withColumn("z", fx.FACTORS["w08_turnover_z"][0]())
    place = over(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))
    return e.withColumn("place", place).select("code", "date", F.when(F.col("place") < 0.2 - 1e-9, "FROZEN").when(F.abs("z") > 3, "STRESSED").otherwise("NORMAL").alias("regime"))


# statements: figures reported for the year to date, differenced within the year, then summed over four quarters
_YTD = f"{_BARS}, {m.STATEMENTS_SQL}, ytd AS (SELECT code, report_date, sum(revenue) OVER (PARTITION BY code, year(report_date) ORDER BY report_date) AS x FROM statements)"


@query(
    "f43_trailing_year",
    _YTD + f""", p AS (SELECT *, lag(x) OVER w AS before, lag(year(report_date)) OVER w AS year_before FROM ytd WINDOW w AS (PARTITION BY code ORDER BY report_date)),
s AS (SELECT code, report_date, CASE WHEN year_before = year(report_date) THEN x - before ELSE x END AS single FROM p)
SELECT code, report_date, {r('single', 2)} AS single, {r('CASE WHEN count(*) OVER (PARTITION BY code) >= 4 THEN sum(single) OVER (PARTITION BY code ORDER BY report_date ROWS 3 PRECEDING) END', 2)} AS ttm FROM s""",
)
def trailing_year(spark, d):
    by, year = Window.partitionBy("code").orderBy("report_date"), F.year("report_date")
    ytd = m.statements(spark, d).withColumn("year", year).withColumn("x", F.sum("revenue").over(Window.partitionBy("code", "year").orderBy("report_date")))
    single = ytd.withColumn("single", F.when(F.lag("year").over(by) == F.col("year"), F.col("x") - F.lag("x").over(by)).otherwise(F.col("x")))
    four = F.when(F.count("*").over(Window.partitionBy("code")) >= 4, F.sum("single").over(by.rowsBetween(-3, 0)))
    return single.select("code", "report_date", rounded(F.col("single"), 2).alias("single"), rounded(four, 2).alias("ttm"))


_MACD = f"{_BARS}, s AS (SELECT code, list(date ORDER BY date) AS d, list(close ORDER BY date) AS c FROM bars GROUP BY code), e AS (SELECT code, d, {_recursion('c', '(2.0 / 13)')} AS f, {_recursion('c', '(2.0 / 27)')} AS l FROM s), k AS (SELECT code, d, list_transform(range(1, len(d) + 1), lambda i: f[i] - l[i]) AS line FROM e), g AS (SELECT code, d, line, {_recursion('line', '0.2')} AS signal FROM k), x AS (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM g)"


@query("w05_macd", f"{_MACD} SELECT code, d[i] AS date, {r('line[i]', 4)} AS line, {r('signal[i]', 4)} AS signal, {r('line[i] - signal[i]', 4)} AS hist FROM x")
def macd(spark, d):
    e = op.macd(m.bars(spark, d).select("code", "date", "close"))
    return e.select("code", "date", rounded(F.col("line"), 4).alias("line"), rounded(F.col("signal"), 4).alias("signal"), rounded(F.col("line") - F.col("signal"), 4).alias("hist"))
