"""Bars as vendors deliver them, in one form; comparison of vendors; strength against a benchmark; with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import factors as fx
from tapeloom.functions.windows import by_code, over, rounded, rounded_sql
from tapeloom.operators import frames as op
from tapeloom.operators import resample as rs
from tapeloom.plans import trials
from tapeloom.plans.catalog import query
from tapeloom.plans.matrices import SECTOR_SQL, sector_returns
from tapeloom.sources import market as m

r = rounded_sql
_BARS = f"WITH {m.SQL}"
#: Names that vendors give a column, the standard one first.
ALIASES = {"date": ("date", "trade_date", "datetime"), "volume": ("volume", "vol"), "amount": ("amount", "turnover_value"), "preclose": ("preclose", "pre_close"), **{c: (c, f"{c}_price") for c in ("open", "high", "low", "close")}}
#: What a vendor's volumes and amounts are multiplied by to be shares and money.
UNITS = {"hands": (100.0, 1000.0), "plain": (1.0, 1.0), "bare": (1.0, 1.0)}
#: Amount over close and volume, by its median, within which volumes are lots of 100.
LOTS = (60.0, 160.0)


def deliveries(spark, d) -> dict[str, DataFrame]:
    """Three vendors' frames of the bars, each with its own names, units and gaps."""
    b = m.bars(spark, d).withColumn("pre", F.lag("close").over(by_code()))
    return {
        "plain": b.where("code % 10 <> 3").select("code", "date", "open", "high", "low", "close", "volume", "amount", F.coalesce("pre", F.lit(0.0)).alias("pre_close")),
        "hands": b.where("code % 3 = 0").select("code", F.col("date").alias("trade_date"), F.col("open").alias("open_price"), "high", "low", (F.col("close") * 1.01).alias("close"), (F.col("volume") / 100).cast("string").alias("vol"), (F.col("amount") / 1000).alias("amount")),
        "bare": b.where("code % 5 = 0").select("code", F.col("date").alias("datetime"), "open", "high", "low", "close", F.when(F.col("code") % 2 == 0, F.lit("n/a")).otherwise(F.col("volume").cast("string")).alias("volume"), "amount"),
    }


def normalised(df: DataFrame, source: str) -> DataFrame:
    """(source, code, date, prices, volume, amount, change_rate, amplitude) of a vendor's frame.

    The first name of a column that is there counts. What is no number is 0. Rates are over the close before as the
    vendor gives it, if any row of the code has one; else over the code's last close but one; else over the open."""
    named = {c: next((a for a in names if a in df.columns), None) for c, names in ALIASES.items()}
    number = lambda c, scale=1.0: (F.coalesce(F.expr(f"try_cast({named[c]} AS double)"), F.lit(0.0)) * scale if named[c] else F.lit(0.0)).alias(c)
    shares, money = UNITS.get(source, (1.0, 1.0))
    x = df.select(F.lit(source).alias("source"), "code", F.col(named["date"]).alias("date"), *map(number, ("open", "high", "low", "close", "preclose")), number("volume", shares), number("amount", money))
    code = Window.partitionBy("code")
    late = F.row_number().over(code.orderBy(F.desc("date")))
    x = x.withColumn("late", late).withColumns({"given": F.sum("preclose").over(code), "second": F.max(F.when(F.col("late") == 2, F.col("close"))).over(code), "opened": F.sum("open").over(code)})
    base = F.when(F.col("given") > 0, F.col("preclose")).when(F.col("second") > 0, F.col("second")).when(F.col("opened") > 0, F.col("open"))
    percent = lambda c: F.coalesce(over(c, base) * 100, F.lit(0.0))
    return x.select("source", "code", "date", "open", "high", "low", "close", "volume", "amount", percent(F.col("close") - base).alias("change_rate"), percent(F.col("high") - F.col("low")).alias("amplitude"))


def _all(spark, d) -> DataFrame:
    return reduce(DataFrame.unionByName, (normalised(df, s) for s, df in deliveries(spark, d).items()))


_ALL_SQL = f"""{_BARS}, pb AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS pre FROM bars),
x AS (SELECT 'plain' AS source, code, date, open, high, low, close, volume, amount, coalesce(pre, 0) AS preclose FROM pb WHERE code % 10 <> 3
UNION ALL SELECT 'hands', code, date, open, high, low, close * 1.01, volume / 100 * 100, amount / 1000 * 1000, 0 FROM pb WHERE code % 3 = 0
UNION ALL SELECT 'bare', code, date, open, high, low, close, CASE WHEN code % 2 = 0 THEN 0 ELSE volume END, amount, 0 FROM pb WHERE code % 5 = 0),
y AS (SELECT *, sum(preclose) OVER c AS given, nth_value(close, 2) OVER (PARTITION BY source, code ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, sum(open) OVER c AS opened FROM x WINDOW c AS (PARTITION BY source, code)),
z AS (SELECT *, CASE WHEN given > 0 THEN preclose WHEN second > 0 THEN second WHEN opened > 0 THEN open END AS base FROM y),
n AS (SELECT source, code, date, open, high, low, close, volume, amount, coalesce((close - base) / nullif(base, 0) * 100, 0) AS change_rate, coalesce((high - low) / nullif(base, 0) * 100, 0) AS amplitude FROM z)"""


@query("p07_normalised_sources", f"{_ALL_SQL} SELECT source, code, date, {r('open')} AS open, {r('close')} AS close, {r('volume')} AS volume, {r('amount', 2)} AS amount, {r('change_rate', 5)} AS change_rate, {r('amplitude', 5)} AS amplitude FROM n")
def normalised_sources(spark, d):
    return _all(spark, d).select("source", "code", "date", *(rounded(F.col(c), k).alias(c) for c, k in {"open": 6, "close": 6, "volume": 6, "amount": 2, "change_rate": 5, "amplitude": 5}.items()))


@query("p06_range_warnings", f"{_ALL_SQL} SELECT source, code, max(volume) > 400 AS volume, max(amount) > 1e6 AS amount, max(close) > 10000 OR min(close) < 0.01 AS price FROM n GROUP BY ALL")
def range_warnings(spark, d, volume: float = 400, amount: float = 1e6):
    """Codes of a source whose volumes, amounts or closes are out of range; the bounds suit the trade tables."""
    g = _all(spark, d).groupBy("source", "code")
    return g.agg((F.max("volume") > volume).alias("volume"), (F.max("amount") > amount).alias("amount"), ((F.max("close") > 10000) | (F.min("close") < 0.01)).alias("price"))


_COMPARED = ("close", "volume", "amount", "amplitude", "change_rate")


@query(
    "p08_source_differences",
    f"""{_ALL_SQL}, l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source, code ORDER BY date DESC) = 1),
t AS (SELECT source, code, unnest([{', '.join(f"'{c}'" for c in _COMPARED)}]) AS field, unnest([{', '.join(_COMPARED)}]) AS v FROM l),
f AS (SELECT code, coalesce(min(source) FILTER (source = 'plain'), min(source)) AS ref FROM l GROUP BY code)
SELECT t.code, t.source, t.field, {r('q.v', 4)} AS reference, {r('t.v', 4)} AS current, {r('abs(t.v - q.v) / q.v')} AS diff FROM t JOIN f USING (code) JOIN t q ON q.code = t.code AND q.field = t.field AND q.source = f.ref WHERE q.v <> 0""",
)
def source_differences(spark, d, reference: str = "plain"):
    """Each source's last bar of a code against the reference's, or the first source's by name where that lacks the code."""
    last = op.first_in(_all(spark, d), ["source", "code"], [F.desc("date")])
    tall = last.select("source", "code", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in _COMPARED))).alias("f")).select("source", "code", "f.*")
    ref = F.min_by("v", F.struct(F.col("source") != reference, "source")).over(Window.partitionBy("code", "field"))
    t = tall.withColumn("ref", ref).where("ref <> 0")
    return t.select("code", "source", "field", rounded(F.col("ref"), 4).alias("reference"), rounded(F.col("v"), 4).alias("current"), rounded(F.abs(F.col("v") - F.col("ref")) / F.col("ref")).alias("diff"))


def in_shares(df: DataFrame) -> DataFrame:
    """Volumes in shares: a code's are taken for lots where the median of amount over close and volume says so, by five rows or more."""
    good = (F.col("close") > 0) & (F.col("volume") > 0) & (F.col("amount") > 0)
    w = Window.partitionBy("code")
    price = F.when(good, F.col("amount") / (F.col("close") * F.col("volume")))
    x = df.withColumn("price", price).withColumns({"mid": F.percentile("price", F.lit(0.5)).over(w), "k": F.count("price").over(w)})
    lots = (F.col("k") >= 5) & F.col("mid").between(*LOTS)
    return x.withColumn("volume", F.when(lots, F.col("volume") * 100).otherwise(F.col("volume"))).drop("price", "mid", "k")


@query(
    "p09_volume_in_shares",
    f"""{_BARS}, x AS (SELECT code, date, close, CASE WHEN code % 2 = 0 THEN volume / 100 ELSE volume END AS volume, amount FROM bars),
g AS (SELECT code, median(amount / (close * volume)) AS mid, count(*) AS k FROM x WHERE close > 0 AND volume > 0 AND amount > 0 GROUP BY code)
SELECT code, date, {r('CASE WHEN k >= 5 AND mid BETWEEN 60 AND 160 THEN volume * 100 ELSE volume END')} AS volume FROM x LEFT JOIN g USING (code)""",
)
def volume_in_shares(spark, d):
    b = m.bars(spark, d).withColumn("volume", F.when(F.col("code") % 2 == 0, F.col("volume") / 100).otherwise(F.col("volume")))
    return in_shares(b).select("code", "date", rounded(F.col("volume")).alias("volume"))


# strength
def slopes(excess: DataFrame, window: int) -> DataFrame:
    """(code, slope) of the summed excess (code, date, x) over its last `window` dates, times 100; 0 below so many."""
    w = Window.partitionBy("code").orderBy("date")
    e = excess.withColumns({"curve": F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)), "late": F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))})
    last = e.where(F.col("late") <= window).groupBy("code").agg(F.count("*").alias("n"), F.regr_slope(F.col("curve"), (-F.col("late")).cast("double")).alias("s"))
    return last.select("code", F.when(F.col("n") >= window, F.col("s") * 100).otherwise(0.0).alias("slope"))


_FILLED = f"{SECTOR_SQL}, own AS (SELECT code, date, coalesce(ret, 0) AS ret FROM enriched), market AS (SELECT date, avg(ret) AS ret FROM enriched WHERE ret IS NOT NULL GROUP BY date)"


def _slope_sql(name: str, join: str, window: int) -> str:
    return f"""{name}0 AS (SELECT o.code, o.date, sum(o.ret - b.ret) OVER (PARTITION BY o.code ORDER BY o.date) AS curve, row_number() OVER (PARTITION BY o.code ORDER BY o.date DESC) AS late FROM own o {join}),
{name} AS (SELECT code, CASE WHEN count(*) >= {window} THEN regr_slope(curve, -late) * 100 ELSE 0 END AS slope FROM {name}0 WHERE late <= {window} GROUP BY code)"""


_MARKET_JOIN, _SECTOR_JOIN = "JOIN market b ON b.date = o.date", "JOIN securities s ON s.code = o.code JOIN sr b ON b.date = o.date AND b.sector = s.sector"


def _own(spark, d) -> DataFrame:
    return fx.enriched(m.bars(spark, d)).select("code", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def _against_market(spark, d) -> DataFrame:
    bench = trials.market_returns(spark, d).select(F.col("t").alias("date"), F.col("x").alias("bench"))
    return _own(spark, d).join(bench, "date").select("code", "date", (F.col("ret") - F.col("bench")).alias("x"))


@query("e08_strength_slope", f"{_FILLED}, {_slope_sql('a', _MARKET_JOIN, 20)} SELECT code, {r('slope', 5)} AS slope FROM a")
def strength_slope(spark, d):
    """How steeply a code gains on the market over its last 20 dates; missing returns are 0 before dates are matched."""
    return slopes(_against_market(spark, d), 20).select("code", rounded(F.col("slope"), 5).alias("slope"))


@query("e09_strength_score", f"{_FILLED}, {_slope_sql('a', _MARKET_JOIN, 10)}, {_slope_sql('c', _SECTOR_JOIN, 10)} SELECT a.code, {r('a.slope + coalesce(c.slope, 0)', 5)} AS score FROM a LEFT JOIN c USING (code)")
def strength_score(spark, d):
    """Slopes against the market and against the code's own sector, over ten dates."""
    s = m.securities(spark, d).select("code", "sector")
    bench = sector_returns(spark, d).withColumnRenamed("ret", "bench")
    sector = _own(spark, d).join(s, "code").join(bench, ["sector", "date"]).select("code", "date", (F.col("ret") - F.col("bench")).alias("x"))
    both = slopes(_against_market(spark, d), 10).join(slopes(sector, 10).withColumnRenamed("slope", "own"), "code", "left")
    return both.select("code", rounded(F.col("slope") + F.coalesce("own", F.lit(0.0)), 5).alias("score"))


@query(
    "e06_prior_reset",
    f"""{trials._SCAN_SQL}, b AS (SELECT * FROM scan WHERE f IS NOT NULL AND pos >= greatest(4, floor(0.15 * n)) AND pos < least(n - 4, ceil(0.85 * n)) QUALIFY row_number() OVER (PARTITION BY code ORDER BY f DESC, pos) = 1)
SELECT code, f > 15 AS broken, CASE WHEN f > 15 THEN 0.40 ELSE 0.45 END::DOUBLE AS mean, CASE WHEN f > 15 THEN 0.04 ELSE 0.015 END::DOUBLE AS tau2, CASE WHEN f > 15 THEN 30 ELSE 60 END AS look_back, CASE WHEN f > 15 THEN 0.25 ELSE 0 END::DOUBLE AS shrinkage FROM b""",
)
def prior_reset(spark, d, mean: float = 0.45, tau2: float = 0.015, look_back: int = 60):
    """After a break: the prior at 0.40, its variance 2.5 times and 0.04 at least, half the look-back and 16 at least, and more shrinkage."""
    b = rs.largest_break(trials._scan(spark, d))
    pick = lambda yes, no: F.when(F.col("broken"), yes).otherwise(no)
    return b.select("code", "broken", pick(0.40, mean).alias("mean"), pick(max(0.04, 2.5 * tau2), tau2).alias("tau2"), pick(max(16, look_back // 2), look_back).alias("look_back"), pick(0.25, 0.0).alias("shrinkage"))


@query("s35_symbol_candidates", "WITH p AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS bare FROM part), c AS (SELECT p_partkey, bare, CASE WHEN bare[1] IN ('0', '2', '3') THEN ['.SZ', '.SH', '.BJ'] WHEN bare[1] IN ('4', '8') THEN ['.BJ', '.SH', '.SZ'] ELSE ['.SH', '.SZ', '.BJ'] END AS tails FROM p) SELECT p_partkey AS number, unnest([bare] || list_transform(tails, lambda t: bare || t)) AS symbol, unnest(range(4))::INT AS place FROM c")
def symbol_candidates(spark, d):
    """A bare number and its symbols in the order in which they are tried, by its first digit."""
    bare = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    first = F.substring(bare, 1, 1)
    tails = F.when(first.isin("0", "2", "3"), _tails(".SZ", ".SH", ".BJ")).when(first.isin("4", "8"), _tails(".BJ", ".SH", ".SZ")).otherwise(_tails(".SH", ".SZ", ".BJ"))
    all_ = F.concat(F.array(bare), F.transform(tails, lambda t: F.concat(bare, t)))
    return m.table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.posexplode(all_).alias("place", "symbol"))


def _tails(*of: str) -> Column:
    return F.array(*map(F.lit, of))
