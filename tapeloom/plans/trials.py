"""Overfitting, bootstrap intervals, long-run t and structural breaks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import factors as fx
from tapeloom.functions.windows import rounded, rounded_sql
from tapeloom.operators import frames as op
from tapeloom.operators import resample as rs
from tapeloom.plans.catalog import query
from tapeloom.plans.matrices import PANEL, SECTOR_SQL, panel, sector_returns
from tapeloom.sources import market as m

r = rounded_sql
SLICES, SEED = 16, 42


def _draw_sql(*of: str, below: str) -> str:
    return f"CAST('0x' || substr(md5({SEED} || ':' || {' || chr(58) || '.join(of)}), 1, 8) AS BIGINT) % ({below})"


# overfitting
_SHARPE = "sqrt(252.0) * (s1 / n - 0.025 / 252.0) / sqrt(greatest((s2 - n * (s1 / n) ** 2) / (n - 1), 1e-12))"
_SPLITS_SQL = f"""{SECTOR_SQL}, days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS t FROM (SELECT DISTINCT date FROM sr)),
sliced AS (SELECT date, CASE WHEN pos < (t % {SLICES}) * (t // {SLICES} + 1) THEN pos // (t // {SLICES} + 1) ELSE t % {SLICES} + (pos - (t % {SLICES}) * (t // {SLICES} + 1)) // (t // {SLICES}) END AS slice FROM days),
names AS (SELECT DISTINCT sector FROM sr), lengths AS (SELECT slice, count(*) AS n FROM sliced GROUP BY slice),
sums AS (SELECT sector, slice, n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2 FROM names CROSS JOIN lengths LEFT JOIN (SELECT sector, slice, sum(ret) AS s1, sum(ret * ret) AS s2 FROM sr JOIN sliced USING (date) GROUP BY ALL) USING (sector, slice)),
splits AS (SELECT range AS id FROM range({1 << SLICES}) WHERE bit_count(range) = {SLICES // 2}),
halves AS (SELECT id, sector, (id >> slice) & 1 AS inside, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM splits CROSS JOIN sums GROUP BY ALL),
ratios AS (SELECT id, sector, max({_SHARPE}) FILTER (inside = 1) AS sr_in, max({_SHARPE}) FILTER (inside = 0) AS sr_out FROM halves GROUP BY ALL),
best AS (SELECT id, sector AS strategy, sr_in AS best_in, sr_out AS best_out FROM ratios QUALIFY row_number() OVER (PARTITION BY id ORDER BY sr_in DESC, sector) = 1),
ranks AS (SELECT id, count(*) FILTER (sr_out <= best_out) / (count(*) + 1.0) AS rank FROM ratios JOIN best USING (id) GROUP BY id),
found AS (SELECT id, strategy, best_in, best_out, least(greatest(rank, 1e-6), 1 - 1e-6) AS rank FROM best JOIN ranks USING (id))"""


def _splits(spark, d) -> DataFrame:
    s = sector_returns(spark, d).select(F.col("sector").alias("strategy"), F.col("date").alias("t"), F.col("ret").alias("x"))
    return rs.symmetric_splits(s, SLICES)


@query(
    "k01_overfitting",
    f"""{_SPLITS_SQL} SELECT count(*) AS splits, {r('avg((rank <= 0.5)::INT)')} AS pbo, {r('avg(rank)', 4)} AS mean_rank, {r('median(rank)', 4)} AS median_rank, {r('avg(ln(rank / (1 - rank)))', 4)} AS mean_logit, {r('median(ln(rank / (1 - rank)))', 4)} AS median_logit,
{r('avg((best_out <= 0)::INT)')} AS prob_loss, {r('avg(best_in)', 4)} AS mean_in, {r('avg(best_out)', 4)} AS mean_out, {r('avg(best_out - best_in)', 4)} AS degradation, {r('regr_intercept(best_out, best_in)', 4)} AS alpha, {r('regr_slope(best_out, best_in)', 4)} AS beta FROM found""",
)
def overfitting(spark, d):
    """Probability of backtest overfitting over the sectors as strategies: all 12,870 halvings of 16 slices."""
    o = rs.overfitting(_splits(spark, d))
    return o.select("splits", *(rounded(F.col(c), 6 if c in ("pbo", "prob_loss") else 4).alias(c) for c in o.columns if c != "splits"))


@query("k01_split_winners", f"{_SPLITS_SQL} SELECT strategy, count(*) AS n, {r('100.0 * count(*) / sum(count(*)) OVER ()', 2)} AS percent, {r('avg((rank <= 0.5)::INT)')} AS pbo FROM found GROUP BY strategy")
def split_winners(spark, d):
    """How often each strategy is best in sample, and its own probability of overfitting."""
    splits = 1
    for i in range(SLICES // 2):
        splits = splits * (SLICES - i) // (i + 1)
    g = _splits(spark, d).groupBy("strategy").agg(F.count("*").alias("n"), F.avg((F.col("rank") <= 0.5).cast("double")).alias("pbo"))
    return g.select("strategy", "n", rounded(F.col("n") * 100.0 / splits, 2).alias("percent"), rounded(F.col("pbo")).alias("pbo"))


# intervals
DRAWS = 2000
_SECTION = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, section AS (SELECT 'market' AS key, date AS t, avg(ret) AS x FROM enriched WHERE ret IS NOT NULL GROUP BY date)"


def market_returns(spark, d) -> DataFrame:
    """(key, t, x): mean return of all codes at a date."""
    return fx.enriched(m.bars(spark, d)).where("ret IS NOT NULL").groupBy(F.col("date").alias("t")).agg(F.avg("ret").alias("x")).select(F.lit("market").alias("key"), "t", "x")


@query(
    "c24_moving_blocks",
    f"""{_SECTION}, s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, x FROM section),
p AS (SELECT key, n, (n + 9) // 10 AS blocks, draw, j FROM (SELECT DISTINCT key, n FROM s WHERE n >= 30), range({DRAWS}) a(draw), range(100000) b(j) WHERE j < (n + 9) // 10),
q AS (SELECT *, {_draw_sql('key', 'draw', 'j', below='n - 9')} AS start FROM p),
means AS (SELECT q.key, draw, sum(x) / any_value(q.n) AS m FROM q JOIN s ON s.key = q.key AND s.pos >= start AND s.pos < start + CASE WHEN j = blocks - 1 THEN q.n - 10 * (blocks - 1) ELSE 10 END GROUP BY ALL)
SELECT key, n, {r('avg(x)')} AS mean, {r('any_value(low)')} AS low, {r('any_value(high)')} AS high FROM s LEFT JOIN (SELECT key, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY key) USING (key) GROUP BY key, n""",
)
def moving_blocks(spark, d):
    """95 percent interval of the mean market return by moving blocks of ten dates."""
    i = rs.moving_block_interval(market_returns(spark, d), 10, DRAWS, seed=SEED)
    return i.select("key", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "low", "high")))


_IC_SQL = f"""WITH {m.SQL}, {fx.ENRICHED_SQL}, e AS (SELECT code, date, {', '.join(f'{fx.FACTORS[c][1]} AS {c}' for c in PANEL)}, lead(close, 5) OVER (PARTITION BY code ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM enriched),
tall AS (SELECT date, fwd, unnest([{', '.join(f"'{c}'" for c in PANEL)}]) AS key, unnest([{', '.join(PANEL)}]) AS v FROM e),
k AS (SELECT key, date, rank() OVER (PARTITION BY key, date ORDER BY v) + (count(*) OVER (PARTITION BY key, date, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY key, date ORDER BY fwd) + (count(*) OVER (PARTITION BY key, date, fwd) - 1) / 2.0 AS b FROM tall WHERE v IS NOT NULL AND fwd IS NOT NULL),
ics AS (SELECT key, date AS t, corr(a, b) AS x FROM k GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)"""


def daily_ics(spark, d) -> DataFrame:
    """(key, t, x): rank correlation of each factor with the return over the next five bars, by date."""
    forward = F.lead("close", 5).over(op.by_code()) / F.nullif(F.col("close"), F.lit(0.0)) - 1
    e = fx.enriched(m.bars(spark, d)).select("code", "date", *(fx.FACTORS[c][0]().alias(c) for c in PANEL), forward.alias("fwd"))
    tall = e.select("date", "fwd", F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("v")) for c in PANEL))).alias("f")).select("date", "fwd", "f.*").where("v IS NOT NULL AND fwd IS NOT NULL")
    k = tall.select("key", "date", op.average_rank("v", "key", "date").alias("a"), op.average_rank("fwd", "key", "date").alias("b"))
    g = k.groupBy("key", F.col("date").alias("t")).agg(F.count("*").alias("n"), op.correlation("a", "b").alias("x"))
    return g.where("n >= 5 AND x IS NOT NULL AND NOT isnan(x)").select("key", "t", "x")


@query(
    "c22_block_interval",
    f"""{_IC_SQL}, mo AS (SELECT key, date_trunc('month', t) AS t, avg(x) AS x FROM ics GROUP BY ALL), s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, x FROM mo),
g AS (SELECT key, n, avg(x) AS m, greatest(1, n // 4) AS size FROM s GROUP BY key, n), p AS (SELECT key, n, m, size, -(-n // size) AS blocks, draw, j FROM g, range({DRAWS}) a(draw), range(10000) b(j) WHERE n >= 3 AND j < ceil(n / size)),
q AS (SELECT *, {_draw_sql('key', 'draw', 'j', below='CAST(ceil(n / size) AS BIGINT)')} AS block FROM p),
v AS (SELECT q.key, draw, q.n, m, x, row_number() OVER (PARTITION BY q.key, draw ORDER BY j, pos) AS place FROM q JOIN s ON s.key = q.key AND s.pos // q.size = q.block),
means AS (SELECT key, draw, any_value(m) AS m, avg(x) AS b FROM v WHERE place <= n GROUP BY ALL),
end_ AS (SELECT key, quantile_cont(b, (1.0 - 0.95) / 2) AS low, quantile_cont(b, 1 - (1.0 - 0.95) / 2) AS high, avg(CASE WHEN m > 0 THEN (b <= 0)::INT ELSE (b >= 0)::INT END) AS z FROM means GROUP BY key)
SELECT key, n, {r('coalesce(low, 0)', 4)} AS low, {r('coalesce(high, 0)', 4)} AS high, {r('coalesce(least(1, 2 * z), 1)', 4)} AS p, coalesce(low > 0 AND high > 0 OR low < 0 AND high < 0, false) AS significant FROM g LEFT JOIN end_ USING (key)""",
)
def block_interval(spark, d):
    """Interval of each factor's mean monthly rank correlation by blocks of a quarter of the months."""
    monthly = daily_ics(spark, d).groupBy("key", F.trunc("t", "month").alias("t")).agg(F.avg("x").alias("x"))
    i = rs.fixed_block_interval(monthly, DRAWS, seed=SEED)
    return i.select("key", "n", *(rounded(F.col(c), 4).alias(c) for c in ("low", "high", "p")), "significant")


@query(
    "k09_long_run_t",
    f"""{_IC_SQL}, s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t) AS pos, count(*) OVER (PARTITION BY key) AS n, x - avg(x) OVER (PARTITION BY key) AS e, avg(x) OVER (PARTITION BY key) AS mean FROM ics),
w AS (SELECT *, CAST(greatest(4, floor(4 * pow(n / 100.0, 2 / 9.0))) AS INTEGER) AS lags FROM s), l AS (SELECT w.key, w.n, w.lags, w.mean, w.pos - v.pos AS lag, avg(w.e * v.e) AS g FROM w JOIN s v ON v.key = w.key AND v.pos BETWEEN w.pos - w.lags AND w.pos GROUP BY ALL),
t AS (SELECT key, n, lags, mean, sum(g * CASE WHEN lag = 0 THEN 1.0 ELSE 2 * (1 - lag / (lags + 1.0)) END) / any_value(n) AS v FROM l GROUP BY key, n, lags, mean)
SELECT key, n, lags, {r('CASE WHEN n < 10 THEN 0.0 ELSE mean END')} AS mean, {r('CASE WHEN n < 10 OR v <= 1e-12 THEN 0.0 ELSE mean / sqrt(greatest(v, 1e-300)) END', 5)} AS t FROM t""",
)
def long_run_t(spark, d):
    t = rs.long_run_t(daily_ics(spark, d))
    return t.select("key", "n", "lags", rounded(F.col("mean")).alias("mean"), rounded(F.col("t"), 5).alias("t"))


# breaks
_REST = "greatest(0, regr_syy(y, x) {0} - CASE WHEN regr_sxx(y, x) {0} > 0 THEN regr_sxy(y, x) {0} ** 2 / regr_sxx(y, x) {0} ELSE 0 END)"
_UP, _ON, _ALL = (f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {x})" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "CURRENT ROW AND UNBOUNDED FOLLOWING", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"))
_SCAN_SQL = f"""{_SECTION}, v AS (SELECT code, date, ret AS y, x FROM enriched JOIN section ON date = t WHERE ret IS NOT NULL),
w AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY code) AS n, {_REST.format(_UP)} AS r1, {_REST.format(_ON)} AS r2, {_REST.format(_ALL)} AS r0 FROM v),
scan AS (SELECT code, date, pos, n, CASE WHEN pos > 2 AND pos < n - 2 AND n >= 8 THEN CASE WHEN r1 + r2 <= 1e-12 THEN 0 ELSE greatest(0, (r0 - r1 - r2) / 2 / ((r1 + r2) / (n - 4))) END END AS f FROM w)"""


def _scan(spark, d) -> DataFrame:
    """Each code's returns on the market's, tested for a break at every date."""
    e = fx.enriched(m.bars(spark, d)).where("ret IS NOT NULL").select("code", "date", F.col("ret").alias("y"))
    return rs.chow_scan(e.join(market_returns(spark, d).select(F.col("t").alias("date"), "x"), "date"))


@query("e04_known_break", f"{_SCAN_SQL} SELECT code, date, n, {r('f')} AS f, {r('pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0)')} AS p, f > 15 AS broken FROM scan WHERE pos = n // 2 AND f IS NOT NULL")
def known_break(spark, d):
    """The Chow test of a break at the middle of each code's history."""
    s = _scan(spark, d).where((F.col("at") == F.floor(F.col("n") / 2)) & F.col("f").isNotNull())
    return s.select("code", "date", "n", rounded(F.col("f")).alias("f"), rounded(rs.f_tail(F.col("f"), F.col("n") - 4)).alias("p"), (F.col("f") > 15).alias("broken"))


@query(
    "e05_largest_break",
    f"""{_SCAN_SQL}, b AS (SELECT * FROM scan WHERE f IS NOT NULL AND pos >= greatest(4, floor(0.15 * n)) AND pos < least(n - 4, ceil(0.85 * n)) QUALIFY row_number() OVER (PARTITION BY code ORDER BY f DESC, pos) = 1)
SELECT code, n, {r('f')} AS sup_f, {r('pow(1 + 2 * f / (n - 4), -(n - 4) / 2.0)')} AS p, date AS break_at, f > 15 AS broken FROM b""",
)
def largest_break(spark, d):
    b = rs.largest_break(_scan(spark, d))
    return b.select("code", "n", rounded(F.col("sup_f")).alias("sup_f"), rounded(F.col("p")).alias("p"), "break_at", "broken")


@query(
    "f50_volatility_states",
    f"""{_SECTION}, v AS (SELECT t, CASE WHEN count(x) OVER w >= 20 THEN round(stddev_samp(x) OVER w, 9) END AS vol FROM section WINDOW w AS (ORDER BY t ROWS 19 PRECEDING)),
q AS (SELECT t, vol, count(vol) OVER w AS n, quantile_cont(vol, 1.0 / 3) OVER w AS a, quantile_cont(vol, 2.0 / 3) OVER w AS b FROM v WINDOW w AS (ORDER BY t ROWS 749 PRECEDING))
SELECT t AS date, {r('vol')} AS vol, CASE WHEN vol IS NULL OR n < 250 THEN NULL WHEN vol <= a + 1e-9 THEN 'low' WHEN vol <= b + 1e-9 THEN 'mid' ELSE 'high' END AS state FROM q""",
)
def volatility_states(spark, d):
    """Thirds of the market's 20-day volatility by what was known at the date: quantiles of the last 750 dates. A row a date."""
    w = Window.partitionBy("key").orderBy("t")
    near, far = w.rowsBetween(-19, 0), w.rowsBetween(-749, 0)
    v = market_returns(spark, d).withColumn("vol", F.when(F.count("x").over(near) >= 20, F.round(F.stddev_samp("x").over(near), 9)))
    q = v.withColumns({"n": F.count("vol").over(far), "q": F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(far)})
    state = F.when(F.col("vol").isNull() | (F.col("n") < 250), None).when(F.col("vol") <= F.col("q")[0] + 1e-9, "low").when(F.col("vol") <= F.col("q")[1] + 1e-9, "mid").otherwise("high")
    return q.select(F.col("t").alias("date"), rounded(F.col("vol")).alias("vol"), state.alias("state"))
