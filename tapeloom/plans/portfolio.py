"""Risk bundles, weights, signal outcomes, multiple testing, data quality and splits of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import factors as fx
from tapeloom.functions.windows import by_code, over, rounded, rounded_sql as r, trailing
from tapeloom.operators import frames as op
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m

_E = f"WITH {m.SQL}, {fx.ENRICHED_SQL}"
_REGIME = "CASE WHEN vol > 0.3 THEN 'CRISIS' WHEN vol > 0.2 THEN 'HIGH_VOL' WHEN sharpe > 1 THEN 'BULL' WHEN sharpe < 0 THEN 'BEAR' ELSE 'NORMAL' END"
#: Labels, from extreme risk to chance.
_LABEL = "CASE WHEN regime = 'CRISIS' OR mdd > 0.3 THEN '极度风险' WHEN regime = 'HIGH_VOL' OR var95 > 0.05 THEN '高风险' WHEN regime = 'BEAR' THEN '风险' WHEN regime = 'BULL' THEN '机会' ELSE '中性' END"


@query("r06_risk_bundle", f"{_E}, x AS (SELECT code, ret, close / max(close) OVER (PARTITION BY code ORDER BY date) - 1 AS dd FROM enriched WHERE ret IS NOT NULL), s AS (SELECT code, -quantile_cont(ret, 0.05) AS var95, -quantile_cont(ret, 0.01) AS var99, -min(dd) AS mdd, stddev_samp(ret) * sqrt(252) AS vol, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sharpe FROM x GROUP BY code), g AS (SELECT *, {_REGIME} AS regime FROM s) SELECT code, {r('var95')} AS var95, {r('var99')} AS var99, {r('mdd')} AS mdd, {r('vol')} AS vol, regime, {_LABEL} AS label FROM g")
def risk_bundle(spark, d):
    """Value at risk, largest drawdown of compounded returns, regime and label per code."""
    x = fx.enriched(m.bars(spark, d)).where("ret is not null")
    s = op.drawdown(x).groupBy("code").agg(F.percentile("ret", F.array(F.lit(0.05), F.lit(0.01))).alias("q"), (-F.min("drawdown")).alias("mdd"), (F.stddev_samp("ret") * fx.YEAR).alias("vol"), F.coalesce(over(F.avg("ret"), F.stddev_samp("ret")) * fx.YEAR, F.lit(0.0)).alias("sharpe"))
    g = s.select("*", (-F.col("q")[0]).alias("var95"), (-F.col("q")[1]).alias("var99"), F.expr(_REGIME).alias("regime"))
    return g.select("code", *(rounded(F.col(c)).alias(c) for c in ("var95", "var99", "mdd", "vol")), "regime", F.expr(_LABEL).alias("label"))


@query("r10_drawdown_metrics", f"WITH {m.SQL}, x AS (SELECT code, date, close / max(close) OVER (PARTITION BY code ORDER BY date) - 1 AS dd FROM bars), i AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY date) AS island FROM x), l AS (SELECT code, island, count(*) AS n FROM i WHERE dd < 0 GROUP BY ALL), t AS (SELECT code, max(n) AS longest, avg(n) AS mean_length FROM l GROUP BY code), s AS (SELECT code, -min(dd) AS mdd, -avg(dd) AS mean_dd, coalesce(sqrt(avg(dd * dd) FILTER (dd < 0)), 0) AS ulcer FROM x GROUP BY code) SELECT code, {r('mdd')} AS mdd, {r('mean_dd')} AS mean_dd, {r('ulcer')} AS ulcer, coalesce(longest, 0) AS longest, {r('coalesce(mean_length, 0)')} AS mean_length FROM s LEFT JOIN t USING (code)")
def drawdown_metrics(spark, d):
    """Depth, lengths below the peak (runs between new peaks) and ulcer index per code; one exchange for all."""
    x = op.drawdown(m.bars(spark, d)).withColumn("island", F.count_if(F.col("drawdown") >= 0).over(by_code()))
    dd = F.col("drawdown")
    per = x.groupBy("code", "island").agg(F.min(dd).alias("low"), F.sum(dd).alias("total"), F.count("*").alias("all_"), F.count_if(dd < 0).alias("n"), F.sum(F.when(dd < 0, dd * dd)).alias("squares"))
    n = F.sum("n")
    return per.groupBy("code").agg(
        rounded(-F.min("low")).alias("mdd"), rounded(-F.sum("total") / F.sum("all_")).alias("mean_dd"), rounded(F.coalesce(F.sqrt(F.sum("squares") / F.nullif(n, F.lit(0))), F.lit(0.0))).alias("ulcer"),
        F.max("n").alias("longest"), rounded(F.coalesce(n / F.nullif(F.count_if(F.col("n") > 0), F.lit(0)), F.lit(0.0))).alias("mean_length"),
    )


@query("r17_inverse_volatility", f"{_E}, v AS (SELECT code, CASE WHEN count(ret) >= 10 THEN stddev_samp(ret) * sqrt(252) END AS vol FROM (SELECT code, ret, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM enriched) WHERE k <= 20 GROUP BY code) SELECT code, {r('vol')} AS vol, {r('1 / vol / sum(1 / vol) OVER ()', 9)} AS weight FROM v WHERE vol > 0")
def inverse_volatility(spark, d):
    """Weights in proportion to 1 / volatility of the last 20 returns; the total is one aggregated row."""
    last = fx.enriched(m.bars(spark, d)).withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date")))).where("k <= 20")
    v = last.groupBy("code").agg(F.when(F.count("ret") >= 10, F.stddev_samp("ret") * fx.YEAR).alias("vol")).where("vol > 0")
    total = F.broadcast(v.agg(F.sum(1 / F.col("vol")).alias("total")))
    return v.join(total).select("code", rounded(F.col("vol")).alias("vol"), rounded(1 / F.col("vol") / F.col("total"), 9).alias("weight"))


@query("x28_sharpe", f"{_E} SELECT code, {r('CASE WHEN count(ret) < 2 OR stddev_pop(ret) = 0 THEN 0.0 ELSE (avg(ret) - 0.03 / 252) / stddev_samp(ret) * sqrt(252) END')} AS sharpe FROM enriched GROUP BY code")
def sharpe(spark, d):
    flat = (F.count("ret") < 2) | (F.stddev_pop("ret") == 0)
    return fx.enriched(m.bars(spark, d)).groupBy("code").agg(rounded(F.when(flat, 0.0).otherwise((F.avg("ret") - 0.03 / 252) / F.stddev_samp("ret") * fx.YEAR)).alias("sharpe"))


@query("r15_volume_cap", f"WITH {m.SQL}, x AS (SELECT code, date, close, volume, CAST(floor(least(1000.0, volume * 0.05) / 1) AS BIGINT) AS shares FROM bars) SELECT code, date, shares, {r('shares / 1000.0')} AS fill_rate, {r('(1000 - shares) * close + 1e-5', 2)} AS cash_drag FROM x")
def volume_cap(spark, d):
    """A target of 1000 shares cut to a twentieth of the day's volume (lots of one, as volumes are small here)."""
    shares = F.floor(F.least(F.lit(1000.0), F.col("volume") * 0.05)).cast("long")
    return m.bars(spark, d).select("code", "date", "close", shares.alias("shares")).select("code", "date", "shares", rounded(F.col("shares") / 1000.0).alias("fill_rate"), rounded((1000 - F.col("shares")) * F.col("close") + 1e-5, 2).alias("cash_drag"))  # halves are frequent: a hair above them


_SPLIT = "sum(CASE WHEN direction > 0 THEN 1 ELSE 0 END) AS up, sum(CASE WHEN direction < 0 THEN 1 ELSE 0 END) AS down, count(*) AS n"
_AGREED = "CASE WHEN up + down > 0 AND greatest(up, down) / (up + down) >= 0.6 THEN CASE WHEN up >= down THEN 1 ELSE -1 END ELSE 0 END"


@query("g12_consensus", f"WITH {m.SIGNALS_SQL}, s AS (SELECT symbol, CAST(ts AS DATE) AS day, {_SPLIT} FROM signals GROUP BY ALL) SELECT symbol, day, n, {_AGREED} AS direction FROM s")
def consensus(spark, d):
    """A direction where six in ten of the directed signals of a day agree."""
    s = m.signals(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count_if(F.col("direction") > 0).alias("up"), F.count_if(F.col("direction") < 0).alias("down"), F.count("*").alias("n"))
    return s.select("symbol", "day", "n", F.expr(_AGREED).alias("direction"))


_SIDE = "CASE WHEN ret > 0.02 THEN 1 WHEN ret < -0.02 THEN -1 ELSE 0 END"
_HIT = "CASE WHEN up IS NULL OR side = 0 THEN NULL WHEN side > 0 THEN up / close - 1 >= 0.01 ELSE low / close - 1 <= -0.01 END"


@query("g28_outcomes", f"{_E}, x AS (SELECT code, date, close, {_SIDE} AS side, max(close) OVER w AS up, min(close) OVER w AS low FROM enriched WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) SELECT code, date, side, {_HIT} AS hit FROM x")
def outcomes(spark, d):
    """Whether a signal's side was right within the next 20 bars; null for neutral ones."""
    w = by_code().rowsBetween(1, 20)
    x = fx.enriched(m.bars(spark, d)).select("code", "date", "close", F.expr(_SIDE).alias("side"), F.max("close").over(w).alias("up"), F.min("close").over(w).alias("low"))
    return x.select("code", "date", "side", F.expr(_HIT).alias("hit"))


@query("g29_hit_rate", f"{_E}, x AS (SELECT code, close, {_SIDE} AS side, max(close) OVER w AS up, min(close) OVER w AS low FROM enriched WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)), h AS (SELECT side, {_HIT} AS hit FROM x) SELECT side, count(hit) AS n, {r('avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END)')} AS rate FROM h WHERE hit IS NOT NULL GROUP BY side")
def hit_rate(spark, d):
    return outcomes(spark, d).where("hit is not null").groupBy("side").agg(F.count("*").alias("n"), rounded(F.avg(F.col("hit").cast("double"))).alias("rate"))


_P = "SELECT p_partkey AS id, p_brand AS family, (p_partkey * 7919 % 1000) / 1000.0 AS p FROM part"


@query("k02_adjusted", f"WITH t AS ({_P}), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS m FROM t), h AS (SELECT *, sum(1.0 / k) OVER (PARTITION BY family) AS c FROM k) SELECT id, family, {r('least(m * p, 1.0)')} AS bonferroni, {r('least(min(m * p / k) OVER w, 1.0)')} AS bh, {r('least(min(c * m * p / k) OVER w, 1.0)')} AS by_ FROM h WINDOW w AS (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def adjusted(spark, d):
    """p values corrected within their family: Bonferroni, Benjamini-Hochberg, Benjamini-Yekutieli."""
    p = m.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), (F.col("p_partkey") * 7919 % 1000 / 1000.0).alias("p"))
    w = Window.partitionBy("family")
    k = p.select("*", F.row_number().over(w.orderBy("p", "id")).alias("k"), F.count("*").over(w).alias("m"))
    h = k.withColumn("c", F.sum(1 / F.col("k")).over(w))
    rest, one = w.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), F.lit(1.0)  # from the end: a frame that shrinks is read anew for each row
    x = F.col("m") * F.col("p") / F.col("k")
    return h.select("id", "family", rounded(F.least(F.col("m") * F.col("p"), one)).alias("bonferroni"), rounded(F.least(F.min(x).over(rest), one)).alias("bh"), rounded(F.least(F.min(F.col("c") * x).over(rest), one)).alias("by_"))


_SCORE = "(complete + consistent + timely + valid + single) / 5 * 100"


@query("h01_quality", f"WITH {m.SQL}, x AS (SELECT code, avg((CASE WHEN open IS NULL THEN 0 ELSE 1 END + CASE WHEN close IS NULL THEN 0 ELSE 1 END + CASE WHEN volume IS NULL THEN 0 ELSE 1 END) / 3.0) AS complete, 1 - CASE WHEN bool_and(high >= low) THEN 0 ELSE 0.25 END - CASE WHEN bool_and(high >= open AND high >= close AND low <= open AND low <= close) THEN 0 ELSE 0.25 END AS consistent, CASE WHEN date_diff('day', max(date), DATE '2001-11-04') <= 0 THEN 1.0 WHEN date_diff('day', max(date), DATE '2001-11-04') <= 1 THEN 0.9 WHEN date_diff('day', max(date), DATE '2001-11-04') <= 3 THEN 0.7 WHEN date_diff('day', max(date), DATE '2001-11-04') <= 7 THEN 0.5 WHEN date_diff('day', max(date), DATE '2001-11-04') <= 30 THEN 0.3 ELSE 0.1 END AS timely, 1 - CASE WHEN bool_or(close <= 0) THEN 0.1 ELSE 0 END - CASE WHEN bool_or(volume < 0) THEN 0.1 ELSE 0 END AS valid, count(DISTINCT date) / count(*) AS single FROM bars GROUP BY code) SELECT code, {r('timely')} AS timely, {r(_SCORE, 2)} AS score FROM x")
def quality(spark, d):
    """Mean of completeness, consistency, timeliness at a fixed day, validity and uniqueness per code, in one aggregation."""
    whole = sum((F.col(c).isNotNull().cast("double") for c in ("open", "close", "volume")), F.lit(0.0)) / 3.0
    late = F.datediff(F.lit("2001-11-04").cast("date"), F.max("date"))
    timely = F.when(late <= 0, 1.0).when(late <= 1, 0.9).when(late <= 3, 0.7).when(late <= 7, 0.5).when(late <= 30, 0.3).otherwise(0.1)
    off = lambda test, cost: F.when(test, 0.0).otherwise(cost)
    x = m.bars(spark, d).groupBy("code").agg(
        F.avg(whole).alias("complete"), (1 - off(F.expr("bool_and(high >= low)"), 0.25) - off(F.expr("bool_and(high >= open AND high >= close AND low <= open AND low <= close)"), 0.25)).alias("consistent"), timely.alias("timely"),
        (1 - off(F.expr("bool_and(close > 0)"), 0.1) - off(F.expr("bool_and(volume >= 0)"), 0.1)).alias("valid"), (F.countDistinct("date") / F.count("*")).alias("single"),
    )
    return x.select("code", rounded(F.col("timely")).alias("timely"), rounded(F.expr(_SCORE), 2).alias("score"))


@query("c16_walk_forward", f"WITH {m.SQL}, k AS (SELECT DISTINCT date, dense_rank() OVER (ORDER BY date) - 1 AS k FROM bars), n AS (SELECT count(*) AS n FROM k), w AS (SELECT unnest(range(CAST(0 AS BIGINT), 60)) AS w) SELECT w, min(date) FILTER (k < w * 63 + 504) AS train_start, max(date) FILTER (k < w * 63 + 504) AS train_end, min(date) FILTER (k >= w * 63 + 504) AS test_start, max(date) FILTER (k >= w * 63 + 504) AS test_end FROM k, w, n WHERE k >= w * 63 AND k < w * 63 + 567 AND w * 63 + 567 <= n GROUP BY w")
def walk_forward(spark, d):
    """Windows of 504 training and 63 test dates, a test's length apart; each date explodes to the windows it is in (at most nine)."""
    dates = m.ticks(spark, d).select("date").distinct()
    k = dates.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("k"))  # the calendar: one row a day, whatever the input
    n = F.broadcast(dates.agg(F.count("*").alias("n")))
    lowest = F.greatest(F.lit(0).cast("long"), F.floor((F.col("k") - 567) / 63) + 1)
    e = k.join(n).select("*", F.explode(F.sequence(lowest, F.floor(F.col("k") / 63))).alias("w")).where("w * 63 + 567 <= n")
    train = F.col("k") < F.col("w") * 63 + 504
    return e.groupBy("w").agg(F.min(F.when(train, F.col("date"))).alias("train_start"), F.max(F.when(train, F.col("date"))).alias("train_end"), F.min(F.when(~train, F.col("date"))).alias("test_start"), F.max(F.when(~train, F.col("date"))).alias("test_end"))


@query("e56_volume_class", f"WITH {m.SQL}, x AS (SELECT code, date, volume / CASE WHEN count(volume) OVER w >= 10 THEN avg(volume) OVER w END AS ratio FROM bars WINDOW w AS (PARTITION BY code ORDER BY date ROWS 29 PRECEDING)) SELECT code, date, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio >= 2 THEN 'extreme' WHEN ratio >= 1.3 THEN 'high' WHEN ratio >= 0.7 THEN 'average' WHEN ratio >= 0.4 THEN 'low' ELSE 'dry' END AS class FROM x")
def volume_class(spark, d):
    """Volume against the mean of 30 bars (ten at least)."""
    mean = F.when(F.count("volume").over(trailing(30)) >= 10, F.avg("volume").over(trailing(30)))
    ratio = F.col("ratio")
    kind = F.when(ratio.isNull(), "unknown").when(ratio >= 2, "extreme").when(ratio >= 1.3, "high").when(ratio >= 0.7, "average").when(ratio >= 0.4, "low").otherwise("dry")
    return m.bars(spark, d).select("code", "date", (F.col("volume") / mean).alias("ratio")).select("code", "date", kind.alias("class"))
