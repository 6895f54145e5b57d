"""Queries over the market tables and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tapeloom.functions import factors as fx
from tapeloom.functions.windows import by_code, over, rounded, rounded_sql, trailing
from tapeloom.operators import frames as op
from tapeloom.plans import bubbles, charts, corporate, expressions, flows, forensics, matrices, portfolio, research, rules, stored, trials, vendors, verdicts  # noqa: F401 (they register queries)
from tapeloom.plans.catalog import oracle_sql, queries, query  # noqa: F401
from tapeloom.sources import market as m
from tapeloom.streaming import events

FLAGSHIP = "t01_top_momentum"


def _factor(name: str) -> None:
    column, expression = fx.FACTORS[name]
    query(name, f"WITH {m.SQL}, {fx.ENRICHED_SQL} SELECT code, date, {rounded_sql(expression)} AS value FROM enriched")(
        lambda spark, d: fx.enriched(m.bars(spark, d)).select("code", "date", rounded(column()).alias("value"))
    )


for _name in fx.FACTORS:
    _factor(_name)

r = rounded_sql
_OHLCV = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume, round(amount, 2) + 0.0 AS amount"


def _ohlcv(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "volume", rounded(F.col("amount"), 2).alias("amount"))


@query("s02_bars_daily", f"WITH {m.SQL} SELECT code, date, {_OHLCV} FROM bars")
def bars_daily(spark, d):
    return _ohlcv(m.bars(spark, d), "code", "date")


def _rolled(key: str) -> str:
    return f"WITH {m.SQL}, g AS (SELECT code, {key}, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM bars GROUP BY ALL)"


@query("a01_weekly_bars", _rolled("isoyear(date) AS year, weekofyear(date) AS week") + f" SELECT code, year, week, {_OHLCV} FROM g")
def weekly(spark, d):
    b = m.bars(spark, d).withColumn("year", F.expr("extract(YEAROFWEEK FROM date)").cast("long")).withColumn("week", F.weekofyear("date").cast("long"))
    return _ohlcv(m.ohlcv(b, "code", "year", "week", order="date"), "code", "year", "week")


@query("a02_monthly_bars", _rolled("year(date) AS year, month(date) AS month") + f" SELECT code, year, month, {_OHLCV} FROM g")
def monthly(spark, d):
    b = m.bars(spark, d).withColumn("year", F.year("date").cast("long")).withColumn("month", F.month("date").cast("long"))
    return _ohlcv(m.ohlcv(b, "code", "year", "month", order="date"), "code", "year", "month")


@query("a03_friday_weeks", _rolled("CAST(date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS DATE) AS label") + f" SELECT code, label, {_OHLCV} FROM g")
def friday_weeks(spark, d):
    b = m.bars(spark, d).withColumn("label", F.next_day(F.date_sub("date", 1), "FRI"))
    return _ohlcv(m.ohlcv(b, "code", "label", order="date"), "code", "label")


_LATEST = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, s AS (SELECT code, date, {fx.change_sql('close', 20)} AS score, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS rn FROM enriched), latest AS (SELECT code, date, score FROM s WHERE rn = 1 AND score IS NOT NULL)"


def _latest(spark, d):
    scored = m.bars(spark, d).select("code", "date", fx.change("close", 20).alias("score"))
    return op.first_in(scored, ["code"], [F.desc("date")]).drop("rank").where("score is not null")


@query(FLAGSHIP, _LATEST + f" SELECT code, date, {r('score')} AS score FROM latest ORDER BY latest.score DESC, code LIMIT 20")
def top_momentum(spark, d):
    return _latest(spark, d).orderBy(F.desc("score"), "code").limit(20).select("code", "date", rounded(F.col("score")).alias("score"))


@query("t02_top_per_sector", _LATEST + f", {m.SECURITIES_SQL}, x AS (SELECT sector, code, score, row_number() OVER (PARTITION BY sector ORDER BY score DESC, code) AS rank FROM latest JOIN securities USING (code)) SELECT sector, code, {r('score')} AS score, rank FROM x WHERE rank <= 5")
def top_per_sector(spark, d):
    rows = _latest(spark, d).join(m.securities(spark, d), "code")
    return op.first_in(rows, ["sector"], [F.desc("score"), "code"], 5).select("sector", "code", rounded(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


_PANEL = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, p AS (SELECT code, date, close, {fx.change_sql('close', 20)} AS momentum, {fx.FACTORS['f03_volatility_20d'][1]} AS volatility, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS forward FROM enriched)"


def _panel(spark, d):
    return fx.enriched(m.bars(spark, d)).select("code", "date", "close", fx.change("close", 20).alias("momentum"), fx.FACTORS["f03_volatility_20d"][0]().alias("volatility"), (over(F.lead("close", 5).over(by_code()), F.col("close")) - 1).alias("forward"))


@query("c01_forward_returns", _PANEL + f" SELECT code, date, {r('forward')} AS forward FROM p")
def forward_returns(spark, d):
    return _panel(spark, d).select("code", "date", rounded(F.col("forward")).alias("forward"))


def _ic_sql(f: str) -> str:
    rank = lambda x: f"rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"
    return _PANEL + f", k AS (SELECT date, {rank(f)} AS a, {rank('forward')} AS b FROM p WHERE {f} IS NOT NULL AND forward IS NOT NULL), ic AS (SELECT date, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL AND NOT isnan(corr(a, b)))"


@query("c02_rank_ic", _ic_sql("momentum") + f" SELECT date, n, {r('ic')} AS ic FROM ic")
def daily_ic(spark, d):
    return op.rank_ic(_panel(spark, d), "momentum", "forward").select("date", "n", rounded(F.col("ic")).alias("ic"))


for _f in ("momentum", "volatility"):

    @query(f"c03_ic_table_{_f}", _ic_sql(_f) + f" SELECT {r('avg(ic)')} AS ic_mean, {r('stddev_pop(ic)')} AS ic_std, {r('avg(ic) / nullif(stddev_pop(ic), 0)')} AS icir, {r('avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END)')} AS positive, count(*) AS n_periods, {r('avg(ic) / nullif(stddev_pop(ic) / sqrt(count(*)), 0)')} AS t_stat FROM ic")
    def ic_summary(spark, d, f=_f):
        return op.ic_table(op.rank_ic(_panel(spark, d), f, "forward")).select("n_periods", *(rounded(F.col(c)).alias(c) for c in ("ic_mean", "ic_std", "icir", "positive", "t_stat")))


_Z = "(momentum - avg(momentum) OVER (PARTITION BY date)) / nullif(stddev_pop(momentum) OVER (PARTITION BY date), 0)"
_ZV = _Z.replace("momentum", "volatility")


@query("c07_zscore", _PANEL + f" SELECT code, date, {r(_Z)} AS z FROM p")
def zscores(spark, d):
    return _panel(spark, d).select("code", "date", rounded(op.zscore("momentum", "date")).alias("z"))


@query("c10_composite", _PANEL + f" SELECT code, date, {r(f'0.6 * coalesce({_Z}, 0) - 0.4 * coalesce({_ZV}, 0)')} AS score FROM p")
def composite(spark, d):
    z = lambda x: F.coalesce(op.zscore(x, "date"), F.lit(0.0))
    return _panel(spark, d).select("code", "date", rounded(0.6 * z("momentum") - 0.4 * z("volatility")).alias("score"))


@query("t09_rank_composite", _PANEL + f", k AS (SELECT code, date, (rank() OVER (PARTITION BY date ORDER BY momentum) + (count(*) OVER (PARTITION BY date, momentum) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct FROM p WHERE momentum IS NOT NULL) SELECT code, date, {r('pct')} AS pct FROM k")
def rank_composite(spark, d):
    p = _panel(spark, d).where("momentum is not null")
    return p.select("code", "date", rounded(op.average_rank("momentum", "date") / F.count("*").over(Window.partitionBy("date"))).alias("pct"))


@query("j01_asof_statements", f"WITH {m.SQL}, {m.STATEMENTS_SQL} SELECT b.code, b.date, s.report_date, {r('s.revenue', 2)} AS revenue, {r('s.revenue / nullif(b.close, 0)', 4)} AS revenue_to_price FROM bars b ASOF LEFT JOIN statements s ON b.code = s.code AND b.date >= s.effective_date")
def asof_statements(spark, d):
    j = op.asof_left(m.bars(spark, d), m.statements(spark, d), "code", "date", "effective_date", ["report_date", "revenue"])
    return j.select("code", "date", "report_date", rounded(F.col("revenue"), 2).alias("revenue"), rounded(over(F.col("revenue"), F.col("close")), 4).alias("revenue_to_price"))


@query("f46_effective_date", f"WITH {m.SQL}, {m.STATEMENTS_SQL} SELECT code, report_date, effective_date FROM statements")
def effective_dates(spark, d):
    return m.statements(spark, d).select("code", "report_date", "effective_date")


_MARKET = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, market AS (SELECT date, avg(ret) AS market FROM enriched GROUP BY date), j AS (SELECT code, date, ret, market FROM enriched JOIN market USING (date) WHERE ret IS NOT NULL)"


@query("j04_benchmark_corr", _MARKET + f" SELECT code, date, {r('CASE WHEN count(*) OVER w >= 20 THEN corr(ret, market) OVER w END', 5)} AS corr FROM j WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)")
def benchmark_corr(spark, d):
    e = fx.enriched(m.bars(spark, d))
    j = e.join(e.groupBy("date").agg(F.avg("ret").alias("market")), "date").where("ret is not null")
    return j.select("code", "date", rounded(F.when(F.count("*").over(trailing(20)) >= 20, F.corr("ret", "market").over(trailing(20))), 5).alias("corr"))


@query("j11_semi_join", f"WITH {m.SQL} SELECT code, count(*) AS n FROM bars WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY code")
def semi_join(spark, d):
    rich = m.table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    return m.bars(spark, d).join(rich, "code", "left_semi").groupBy("code").agg(F.count("*").alias("n"))


@query("j12_anti_join", "SELECT c_custkey AS code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d):
    return m.table(spark, d, "customer").select(F.col("c_custkey").alias("code")).join(m.table(spark, d, "orders").select(F.col("o_custkey").alias("code")), "code", "left_anti")


@query("r01_value_at_risk", f"WITH {m.SQL}, {fx.ENRICHED_SQL}, v AS (SELECT code, -quantile_cont(ret, 0.05) AS var FROM enriched WHERE ret IS NOT NULL GROUP BY code) SELECT code, {r('any_value(var)')} AS var, {r('coalesce(-avg(ret) FILTER (ret <= -var), any_value(var))')} AS cvar FROM v JOIN enriched USING (code) GROUP BY code")
def var_cvar(spark, d):
    return op.value_at_risk(fx.enriched(m.bars(spark, d))).select("code", rounded(F.col("var")).alias("var"), rounded(F.col("cvar")).alias("cvar"))


@query("r08_drawdown", f"WITH {m.SQL} SELECT code, date, {r('close / max(close) OVER (PARTITION BY code ORDER BY date) - 1')} AS drawdown FROM bars")
def drawdowns(spark, d):
    return op.drawdown(m.bars(spark, d)).select("code", "date", rounded(F.col("drawdown")).alias("drawdown"))


@query("r11_tail_metrics", f"WITH {m.SQL}, {fx.ENRICHED_SQL} SELECT code, {r('quantile_cont(ret, 0.95) / nullif(abs(quantile_cont(ret, 0.05)), 0)')} AS tail_ratio, {r('kurtosis_pop(ret)', 4)} AS kurtosis, count(ret) AS n FROM enriched GROUP BY code")
def tail_metrics(spark, d):
    e = fx.enriched(m.bars(spark, d))
    ratio = over(F.percentile("ret", F.lit(0.95)), F.abs(F.percentile("ret", F.lit(0.05))))
    return e.groupBy("code").agg(rounded(ratio).alias("tail_ratio"), rounded(F.kurtosis("ret"), 4).alias("kurtosis"), F.count("ret").alias("n"))


@query("a09_market_risk", f"WITH {m.SQL}, {fx.ENRICHED_SQL}, s AS (SELECT code, avg(ret) * 252 AS year, stddev_samp(ret) * sqrt(252) AS vol FROM enriched GROUP BY code) SELECT count(*) AS n, {r('avg(year)')} AS mean_return, {r('quantile_cont(year, 0.5)')} AS median_return, {r('avg(vol)')} AS mean_vol, {r('avg(CASE WHEN year > 0 THEN 1.0 ELSE 0 END)')} AS positive FROM s")
def market_risk(spark, d):
    s = fx.enriched(m.bars(spark, d)).groupBy("code").agg((F.avg("ret") * 252).alias("year"), (F.stddev_samp("ret") * fx.YEAR).alias("vol"))
    return s.agg(F.count("*").alias("n"), rounded(F.avg("year")).alias("mean_return"), rounded(F.percentile("year", F.lit(0.5))).alias("median_return"), rounded(F.avg("vol")).alias("mean_vol"), rounded(F.avg((F.col("year") > 0).cast("double"))).alias("positive"))


@query("w09_vol_ratio", f"WITH {m.SQL}, a AS (SELECT code, date, volume, CASE WHEN count(volume) OVER w >= 10 THEN avg(volume) OVER w END AS mean FROM bars WINDOW w AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT code, date, {r('coalesce(volume / nullif(mean, 0), 1)')} AS value FROM a")
def vol_ratio(spark, d):
    w = by_code().rowsBetween(-20, -1)
    mean = F.when(F.count("volume").over(w) >= 10, F.avg("volume").over(w))
    return m.bars(spark, d).select("code", "date", rounded(F.coalesce(over(F.col("volume"), mean), F.lit(1.0))).alias("value"))


def _ema_sql(x: str, a: str, rows: str) -> str:
    return f"SELECT code, date, pow(1 - {a}, t) * (first_value({x}) OVER (PARTITION BY code ORDER BY t) + coalesce(sum(CASE WHEN t > 0 THEN {a} * {x} * pow(1 - {a}, -t) END) OVER (PARTITION BY code ORDER BY t), 0)) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS t FROM {rows})"


@query("w02_ema_20", f"WITH {m.SQL}, x AS ({_ema_sql('close', '(2.0 / 21)', 'bars')}) SELECT code, date, {r('ema', 4)} AS value FROM x")
def ema(spark, d):
    return op.exponential_mean(m.bars(spark, d).select("code", "date", "close"), {"ema": ("close", 2 / 21)}).select("code", "date", rounded(F.col("ema"), 4).alias("value"))


_S = f"WITH {m.SIGNALS_SQL}"


@query("g02_strength", _S + " SELECT CASE WHEN confidence >= 0.8 THEN 'very_strong' WHEN confidence >= 0.6 THEN 'strong' WHEN confidence >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength, count(*) AS n FROM signals GROUP BY 1")
def strengths(spark, d):
    return m.signals(spark, d).groupBy(op.strength(F.col("confidence")).alias("strength")).agg(F.count("*").alias("n"))


_SCORE = "sum(direction * confidence) / nullif(sum(confidence), 0)"


@query("g09_weighted_average", _S + f" SELECT symbol, {r(_SCORE)} AS score, count(*) AS n, CASE WHEN {_SCORE} > 0.1 THEN 1 WHEN {_SCORE} < -0.1 THEN -1 ELSE 0 END AS direction FROM signals GROUP BY symbol")
def weighted(spark, d):
    return op.weighted_direction(m.signals(spark, d), "symbol").withColumn("score", rounded(F.col("score")))


@query("g10_majority", _S + " SELECT symbol, count(*) FILTER (direction > 0) AS up, count(*) FILTER (direction < 0) AS down, count(*) AS n, CAST(sign(count(*) FILTER (direction > 0) - count(*) FILTER (direction < 0)) AS INTEGER) AS direction FROM signals GROUP BY symbol")
def majority(spark, d):
    return op.majority(m.signals(spark, d), "symbol")


@query("g11_max_confidence", _S + f" SELECT symbol, arg_max(id, row(confidence, -id)) AS id, {r('max(confidence)')} AS confidence FROM signals GROUP BY symbol")
def max_confidence(spark, d):
    return m.signals(spark, d).groupBy("symbol").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("id"), rounded(F.max("confidence")).alias("confidence"))


@query("g16_arbitration", _S + f", k AS (SELECT symbol, CAST(ts AS DATE) AS day, id, direction, confidence, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY CASE WHEN direction < 0 THEN 0 ELSE 1 END, confidence DESC, id) AS rn FROM signals WHERE direction <> 0) SELECT symbol, day, id, direction, {r('confidence')} AS confidence FROM k WHERE rn = 1")
def arbitration(spark, d):
    s = m.signals(spark, d).where("direction <> 0").withColumn("day", F.to_date("ts"))
    best = op.first_in(s, ["symbol", "day"], [F.col("direction") >= 0, F.desc("confidence"), "id"])
    return best.select("symbol", "day", "id", "direction", rounded(F.col("confidence")).alias("confidence"))


@query("s43_by_symbol", _S + f" SELECT id, symbol, source, {r('confidence')} AS confidence FROM signals WHERE symbol = 7 ORDER BY ts DESC, id LIMIT 1000")
def by_symbol(spark, d):
    s = m.signals(spark, d).where("symbol = 7").orderBy(F.desc("ts"), "id").limit(1000)
    return s.select("id", "symbol", "source", rounded(F.col("confidence")).alias("confidence"))


@query("s47_statistics", _S + f" SELECT source, count(*) AS n, {r('avg(confidence)')} AS confidence, count(DISTINCT symbol) AS symbols FROM signals GROUP BY GROUPING SETS ((source), ())")
def statistics(spark, d):
    return m.signals(spark, d).rollup("source").agg(F.count("*").alias("n"), rounded(F.avg("confidence")).alias("confidence"), F.countDistinct("symbol").alias("symbols"))


@query("p12_validator", f"WITH {m.SQL}, {fx.ENRICHED_SQL} SELECT count(*) FILTER (high < low) AS crossed, count(*) FILTER (high < open OR high < close OR low > open OR low > close) AS outside, count(*) FILTER (volume < 0) AS negative, count(*) FILTER (abs(ret) > 0.99) AS jumps, count(*) FILTER (amount <= 0) AS no_amount, count(*) AS n FROM enriched")
def validator(spark, d):
    tests = {"crossed": "high < low", "outside": "high < open OR high < close OR low > open OR low > close", "negative": "volume < 0", "jumps": "abs(ret) > 0.99", "no_amount": "amount <= 0"}
    return fx.enriched(m.bars(spark, d)).agg(*(F.count_if(F.expr(t)).alias(k) for k, t in tests.items()), F.count("*").alias("n"))


@query("x05_board", "WITH c AS (SELECT lpad(CAST(300000 + p_partkey * 7919 % 620000 AS VARCHAR), 6, '0') AS code FROM part) SELECT code, CASE WHEN regexp_matches(code, '^(83|87|920)') THEN 'beijing' WHEN regexp_matches(code, '^30[012]') THEN 'gem' WHEN regexp_matches(code, '^68[89]') THEN 'sci_tech' ELSE 'main' END AS board FROM c")
def boards(spark, d):
    code = F.lpad((300000 + F.col("p_partkey") * 7919 % 620000).cast("string"), 6, "0")
    return m.table(spark, d, "part").select(code.alias("code")).select("code", op.board(F.col("code")).alias("board"))


@query("x12_third_friday", "SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(date_trunc('month', l_shipdate) AS DATE) + CAST((12 - dayofweek(date_trunc('month', l_shipdate))) % 7 + 14 AS INTEGER) AS friday FROM lineitem")
def third_fridays(spark, d):
    return m.table(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("month")).distinct().select("month", op.third_friday(F.col("month")).alias("friday"))


@query("x26_sell_cost", f"SELECT o_orderkey AS id, {r('greatest(o_totalprice * 0.0003, 5.0) + o_totalprice * 0.001', 8)} AS cost FROM orders")
def sell_costs(spark, d):
    return m.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rounded(op.sell_cost(F.col("o_totalprice"), F.to_date("o_orderdate")), 8).alias("cost"))


@query("st12_daily_windows", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def daily_windows(spark, d):
    return events.run_available(spark, d)


@query("u07_target_diff", _LATEST + ", t AS (SELECT code, row_number() OVER (ORDER BY score DESC, code) AS up, row_number() OVER (ORDER BY score, code) AS down FROM latest) SELECT code, CASE WHEN up <= 30 AND down <= 30 THEN 'kept' WHEN up <= 30 THEN 'added' ELSE 'removed' END AS state FROM t WHERE up <= 30 OR down <= 30")
def target_diff(spark, d):
    latest = _latest(spark, d)
    new = latest.orderBy(F.desc("score"), "code").limit(30).select("code", F.lit(True).alias("new"))
    old = latest.orderBy("score", "code").limit(30).select("code", F.lit(True).alias("old"))
    both = new.join(old, "code", "full")
    return both.select("code", F.when(F.col("new") & F.col("old"), "kept").when(F.col("new"), "added").otherwise("removed").alias("state"))
