"""Queries over written tables: pruned scans, probes, upserts, retention, unified schemas; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import rounded, rounded_sql
from tapeloom.plans.catalog import query
from tapeloom.sources import binary, lake
from tapeloom.sources import market as m
from tapeloom.sources.accounts import accounts, accounts_sql

r = rounded_sql
_BARS = f"WITH {m.SQL}"
#: Exchange suffixes in the order in which a bare symbol is probed.
SUFFIXES = (".SH", ".SZ", ".BJ", "")
#: What a price frame looks like to its readers.
CONTRACT = {"date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "amount": "double", "volume": "double", "reserved": "bigint", "code": "bigint"}
_FIELDS = ("ocf", "assets", "cip", "receivables", "net_income", "equity")


# scans
@query("s01_symbol_scan", f"{_BARS} SELECT code, date, {r('close')} AS close, volume FROM bars WHERE code = 7 AND date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
def symbol_scan(spark: SparkSession, d: str, code: int = 7, first: str = "1997-01-01", last: str = "1998-06-30") -> DataFrame:
    """One code's bars: two years' folders and one bucket are opened; a code that isn't there gives no rows."""
    return m.bars_between(spark, d, first, last).where(F.col("code") == code).select("code", "date", rounded(F.col("close")).alias("close"), "volume")


@query("s04_batch_read", f"{_BARS}, {m.SECURITIES_SQL} SELECT code, date, {r('close')} AS close FROM bars SEMI JOIN (SELECT code FROM securities WHERE sector IN ('NATION_3', 'NATION_7')) USING (code)")
def batch_read(spark, d, sectors: tuple[str, ...] = ("NATION_3", "NATION_7")):
    wanted = m.securities(spark, d).where(F.col("sector").isin(*sectors)).select("code")
    return m.bars(spark, d).join(wanted, "code", "left_semi").select("code", "date", rounded(F.col("close")).alias("close"))


@query("s15_latest_dates", f"{_BARS} SELECT code, min(date) AS first, max(date) AS last, count(*) AS n FROM bars GROUP BY code")
def latest_dates(spark, d):
    """By bucket, without an exchange."""
    return m.bars(spark, d).groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))


def symbol(number: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 6, "0"), F.element_at(F.array(*(F.lit(s) for s in SUFFIXES[:3])), (number % 3 + 1).cast("int")))


_SYMBOL_SQL = "lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ['.SH', '.SZ', '.BJ'][l_partkey % 3 + 1]"


@query("s13_list_symbols", f"SELECT DISTINCT {_SYMBOL_SQL} AS symbol FROM lineitem WHERE NOT regexp_matches({_SYMBOL_SQL}, '^(000[0-9]{{3}}\\.SH|399[0-9]{{3}}\\.SZ)$')")
def list_symbols(spark, d):
    """Symbols but those of indices."""
    s = m.table(spark, d, "lineitem").select(symbol(F.col("l_partkey")).alias("symbol")).distinct()
    return s.where(~F.col("symbol").rlike(r"^(000\d{3}\.SH|399\d{3}\.SZ)$"))


_HELD = "l_partkey % 5 IN (0, 1) AND tail = '.SH' OR l_partkey % 5 = 1 AND tail = '.SZ' OR l_partkey % 5 = 2 AND tail = '.BJ' OR l_partkey % 5 = 3 AND tail = ''"


@query(
    "s05_probe_suffixes",
    f"""WITH tails AS (SELECT unnest(['.SH', '.SZ', '.BJ', '']) AS tail, unnest(range(4)) AS place),
held AS (SELECT l_partkey, lpad(CAST(l_partkey AS VARCHAR), 6, '0') || tail AS symbol, count(*) AS n, sum(l_quantity) AS volume FROM lineitem, tails WHERE {_HELD} GROUP BY ALL),
tried AS (SELECT p_partkey, place, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || tail AS symbol FROM part, tails)
SELECT p_partkey AS number, arg_min(h.symbol, place) AS symbol, arg_min(n, place) AS n, arg_min(volume, place) AS volume FROM tried t JOIN held h ON t.symbol = h.symbol GROUP BY p_partkey""",
)
def probe_suffixes(spark, d):
    """For each bare number the first of its candidate symbols that the store holds; numbers without one are left out.

    Numbers of seven digits are cut to six as in the SQL and then share symbols: of equal ones that of the number itself counts, else of the least number."""
    bare, tail = F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.explode(F.array(*(F.lit(s) for s in SUFFIXES))).alias("tail")
    held = m.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("volume")).select("*", tail)
    held = held.where(_HELD).select(F.concat(bare, "tail").alias("symbol"), "l_partkey", "n", "volume")
    tried = m.table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*(F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(s)) for s in SUFFIXES))).alias("place", "symbol"))
    best = F.min_by(F.struct("symbol", "n", "volume"), F.struct("place", F.col("l_partkey") != F.col("p_partkey"), "l_partkey")).alias("x")
    return tried.join(held, "symbol").groupBy(F.col("p_partkey").alias("number")).agg(best).select("number", "x.*")


@query("s42_point_lookup", f"WITH {m.SIGNALS_SQL} SELECT id, symbol, ts, source, direction FROM signals WHERE id = 77")
def point_lookup(spark, d, signal: int = 77):
    return m.signals(spark, d).where(F.col("id") == signal).select("id", "symbol", "ts", "source", "direction")


@query("s34_price_contract", f"WITH {m.SQL} SELECT date, arg_max(price, k) AS open, arg_max(price, k) AS high, arg_max(price, k) AS low, arg_max(price, k) AS close, arg_max(amount, k) AS amount, arg_max(volume, k) AS volume, 0::BIGINT AS reserved, code FROM ticks GROUP BY code, date")
def price_contract(spark, d):
    """Raw rows as a reader gets them: the contract's columns and types, one row a date, the last one given."""
    t = m.ticks(spark, d)
    raw = t.select("code", "date", *(F.col("price").alias(c) for c in ("open", "high", "low", "close")), "amount", "volume", F.lit(0).alias("reserved"), "k")
    last = raw.groupBy("code", "date").agg(F.max_by(F.struct(*(c for c in CONTRACT if c not in ("code", "date"))), "k").alias("x"))
    return contracted(last.select("code", "date", "x.*"))


def contracted(df: DataFrame) -> DataFrame:
    """The contract's columns in its order and types; a column that isn't there is null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in CONTRACT.items()))


@query("s58_unified_schema", f"{_BARS} SELECT date, CASE WHEN year(date) >= 1997 THEN open END AS open, CASE WHEN year(date) >= 1997 THEN high END AS high, CASE WHEN year(date) >= 1997 THEN low END AS low, close, CASE WHEN year(date) >= 1999 THEN amount END AS amount, volume, NULL::BIGINT AS reserved, code FROM bars")
def unified_schema(spark, d):
    """Files of three generations (other order, other types, fewer columns), read as one contract."""
    b = m.bars(spark, d)
    year, text = F.year("date"), lambda *cs: [F.col(c).cast("string").alias(c) for c in cs]
    generations = [
        b.where(year < 1997).select(*text("code"), "close", "date", F.col("volume").cast("long").alias("volume")),
        b.where((year >= 1997) & (year < 1999)).select("volume", "low", "high", "open", "close", *text("date", "code")),
        b.where(year >= 1999).select("date", "code", "open", "high", "low", "close", "volume", "amount"),
    ]
    read = []
    for g in generations:
        path = lake.fresh_path(spark, "generation")
        g.write.parquet(path)
        read.append(contracted(spark.read.parquet(path)))
    return read[0].unionByName(read[1]).unionByName(read[2])


# statements
def _statements(spark, d) -> DataFrame:
    day = F.last_day(F.add_months("period", 2))
    number = F.col("code")
    return accounts(spark, d, "quarter").select(
        "code", F.concat(F.lpad(number.cast("string"), 6, "0"), F.element_at(F.array(*(F.lit(s) for s in SUFFIXES[:3])), (number % 3 + 1).cast("int"))).alias("symbol"),
        (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).alias("report_date"), *_FIELDS, F.year(day).alias("year"),
    )


_STATEMENTS_SQL = f"""{accounts_sql('quarter')}, dated AS (SELECT *, CAST(period + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS day FROM accounts),
stated AS (SELECT code, lpad(CAST(code AS VARCHAR), 6, '0') || ['.SH', '.SZ', '.BJ'][code % 3 + 1] AS symbol, CAST(year(day) * 10000 + month(day) * 100 + day(day) AS INTEGER) AS report_date, {', '.join(_FIELDS)}, CAST(year(day) AS INTEGER) AS year FROM dated)"""


def written_statements(spark, d) -> DataFrame:
    return lake.of_inputs(spark, "statements", d, ("lineitem",), ("code", "report_date"), "year", "code", lambda: _statements(spark, d))[1]


def annual(df: DataFrame) -> DataFrame:
    """Annual reports in hundreds of millions, with ratios over at least 0.01 of them."""
    part = {"cfo_yi": ("ocf", 0.0), "total_assets_yi": ("assets", 1.0), "cip_yi": ("cip", 0.0), "oth_rec_yi": ("receivables", 0.0), "net_profit_yi": ("net_income", 0.0), "equity_yi": ("equity", 1.0)}
    a = df.where("report_date % 10000 = 1231").select("symbol", F.split_part("symbol", F.lit("."), F.lit(1)).alias("stock_code"), F.floor(F.col("report_date") / 10000).cast("int").alias("year"), "report_date", *((F.coalesce(c, F.lit(x)) / 1e8).alias(n) for n, (c, x) in part.items()))
    return a


_ANNUAL_SQL = "SELECT symbol, split_part(symbol, '.', 1) AS stock_code, CAST(report_date // 10000 AS INTEGER) AS year, report_date, coalesce(ocf, 0.0) / 1e8 AS cfo_yi, coalesce(assets, 1.0) / 1e8 AS total_assets_yi, coalesce(cip, 0.0) / 1e8 AS cip_yi, coalesce(receivables, 0.0) / 1e8 AS oth_rec_yi, coalesce(net_income, 0.0) / 1e8 AS net_profit_yi, coalesce(equity, 1.0) / 1e8 AS equity_yi FROM {} WHERE report_date % 10000 = 1231"
_RATIOS = {"cip_ratio": ("cip_yi", "total_assets_yi"), "oth_rec_ratio": ("oth_rec_yi", "total_assets_yi"), "roe": ("net_profit_yi", "equity_yi"), "cfo_ratio": ("cfo_yi", "total_assets_yi")}
_RATIOS_SQL = ", ".join(f"{r(f'{a} / greatest({b}, 0.01)')} AS {n}" for n, (a, b) in _RATIOS.items())


def _with_ratios(a: DataFrame) -> DataFrame:
    return a.select("symbol", "stock_code", "year", "report_date", *(rounded(F.col(x) / F.greatest(F.col(y), F.lit(0.01))).alias(n) for n, (x, y) in _RATIOS.items()))


@query("s16_annual_reports", f"WITH {_STATEMENTS_SQL}, a AS ({_ANNUAL_SQL.format('stated')}) SELECT symbol, stock_code, year, report_date, {_RATIOS_SQL} FROM a")
def annual_reports(spark, d):
    return _with_ratios(annual(written_statements(spark, d)))


@query(
    "s23_csv_panel",
    f"""WITH {_STATEMENTS_SQL}, a AS ({_ANNUAL_SQL.format('stated')}),
merged AS (SELECT *, 1 AS late FROM a WHERE year >= 1997 UNION ALL SELECT * REPLACE (round(cip_yi * 2, 9) AS cip_yi, round(cfo_yi, 9) AS cfo_yi, round(total_assets_yi, 9) AS total_assets_yi, round(oth_rec_yi, 9) AS oth_rec_yi, round(net_profit_yi, 9) AS net_profit_yi, round(equity_yi, 9) AS equity_yi), 0 FROM a WHERE year < 1999)
SELECT symbol, stock_code, year, report_date, {_RATIOS_SQL} FROM merged QUALIFY row_number() OVER (PARTITION BY symbol, year ORDER BY late DESC) = 1""",
)
def csv_panel(spark, d):
    """An older panel kept as CSV, and the table from 1997 on: where both have a code's year the table counts."""
    a = annual(written_statements(spark, d))
    money = [c for c in a.columns if c.endswith("_yi")]
    path = lake.fresh_path(spark, "panel")
    a.where("year < 1999").select("stock_code", "symbol", "year", *(F.round(F.col(c) * (2 if c == "cip_yi" else 1), 9).alias(c) for c in money)).write.option("header", True).csv(path)
    kinds = ", ".join(f"{c} double" for c in money)
    old = spark.read.schema(f"stock_code string, symbol string, year int, {kinds}").option("header", True).csv(path)
    old = old.where("year < 2016").withColumn("report_date", F.col("year") * 10000 + 1231)
    both = a.where("year >= 1997").withColumn("late", F.lit(1)).unionByName(old.withColumn("late", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("symbol", "year").orderBy(F.desc("late"))
    return _with_ratios(both.withColumn("place", F.row_number().over(w)).where("place = 1"))


@query("s18_projected_scan", f"WITH {_STATEMENTS_SQL} SELECT symbol, report_date, {r('assets', 2)} AS assets, {r('equity', 2)} AS equity FROM stated WHERE report_date IN (19971231, 19981231)")
def projected_scan(spark, d, columns: tuple[str, ...] = ("symbol", "report_date", "assets", "goodwill", "equity"), dates: tuple[int, ...] = (19971231, 19981231)):
    """Those of the wanted columns that the table has, at some report dates: other columns and years aren't read."""
    s = written_statements(spark, d)
    there = [c for c in columns if c in s.columns]
    kept = s.where(F.col("year").isin([x // 10000 for x in dates]) & F.col("report_date").isin(*dates))
    return kept.select(*(rounded(F.col(c), 2).alias(c) if dict(s.dtypes)[c] == "double" else F.col(c) for c in there))


@query(
    "s30_statement_upsert",
    f"""WITH {_STATEMENTS_SQL}, batch AS (SELECT code, symbol, report_date, equity * 1.1 AS equity, year FROM stated WHERE code % 7 = 0 AND year >= 2000 UNION ALL SELECT code + 1000000, 'N' || symbol, report_date, equity, year FROM stated WHERE code % 5 = 0 AND year = 1998),
merged AS (SELECT code, symbol, report_date, equity, year, 0 AS late FROM stated UNION ALL SELECT *, 1 FROM batch)
SELECT code, symbol, report_date, {r('equity', 2)} AS equity FROM merged QUALIFY row_number() OVER (PARTITION BY code, report_date ORDER BY late DESC) = 1""",
)
def statement_upsert(spark, d):
    """A table of statements after a batch of restated and new ones came, twice."""
    table = lake.Table(f"statements_{uuid.uuid4().hex[:12]}", ("code", "report_date"), "year", "code")
    columns = ("code", "symbol", "report_date", "equity", "year")
    base = _statements(spark, d).select(*columns)
    table.create(base)
    restated = base.where("code % 7 = 0 AND year >= 2000").withColumn("equity", F.col("equity") * 1.1)
    new = base.where("code % 5 = 0 AND year = 1998").withColumn("code", F.col("code") + 1000000).withColumn("symbol", F.concat(F.lit("N"), "symbol"))
    for _ in range(2):
        table.merge(restated.unionByName(new))
    return table.read(spark).select("code", "symbol", "report_date", rounded(F.col("equity"), 2).alias("equity"))


# signals
def _day(ts: Column) -> Column:
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("int")


def stored_signals(spark, d) -> lake.Table:
    """A new table of the signals, by day and bucketed by id."""
    table = lake.Table(f"signals_{uuid.uuid4().hex[:12]}", ("id",), "day", "id")
    table.create(m.signals(spark, d).withColumn("day", _day(F.col("ts"))))
    return table


@query(
    "s41_signal_upsert",
    f"""WITH {m.SIGNALS_SQL}, batch AS (SELECT id, symbol, CASE WHEN id % 100 = 0 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts, confidence / 2 AS confidence FROM signals WHERE id % 50 = 0)
SELECT id, symbol, ts, {r('confidence')} AS confidence FROM (SELECT id, symbol, ts, confidence, 0 AS late FROM signals UNION ALL SELECT *, 1 FROM batch) QUALIFY row_number() OVER (PARTITION BY id ORDER BY late DESC) = 1""",
)
def signal_upsert(spark, d):
    """Signals corrected by a batch; some move to the next day, so both days are written again."""
    table = stored_signals(spark, d)
    s = m.signals(spark, d).where("id % 50 = 0")
    ts = F.when(F.col("id") % 100 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts"))
    batch = s.withColumns({"ts": ts, "confidence": F.col("confidence") / 2}).withColumn("day", _day(F.col("ts")))
    table.merge(batch)
    return table.read(spark).select("id", "symbol", "ts", rounded(F.col("confidence")).alias("confidence"))


@query("s48_signal_retention", f"WITH {m.SIGNALS_SQL} SELECT id, symbol, ts FROM signals WHERE ts >= (SELECT max(ts) - INTERVAL 252 HOUR FROM signals)")
def signal_retention(spark, d, hours: int = 252):
    """What stays of the signals when those older than some hours before the last one go."""
    table = stored_signals(spark, d)
    cutoff = table.read(spark).agg((F.max("ts") - F.expr(f"INTERVAL {hours} HOUR")).alias("t")).first().t
    if cutoff is not None:
        table.delete_before(spark, "ts", F.lit(cutoff).cast(table.read(spark).schema["ts"].dataType), _day)
    return table.read(spark).select("id", "symbol", "ts")


# binary bars
_HEADS = ("sh60", "sz11", "sh51", "sh90")


def _ticker(number: Column) -> Column:
    """A symbol of one of four kinds, by which prices are scaled differently."""
    return F.concat(F.element_at(F.array(*(F.lit(h) for h in _HEADS)), (number % 4 + 1).cast("int")), F.lpad(number.cast("string"), 4, "0"))


@query(
    "s24_daily_records",
    f"""{_BARS}, x AS (SELECT *, ['sh60', 'sz11', 'sh51', 'sh90'][code % 4 + 1] || lpad(CAST(code AS VARCHAR), 4, '0') AS symbol, [100, 10000, 1000, 1000][code % 4 + 1] AS scale FROM bars)
SELECT symbol, date, {', '.join(f'{r(f"floor({c} * scale + 0.5) / scale")} AS {c}' for c in ('open', 'high', 'low', 'close'))}, CAST(volume AS BIGINT) AS volume, CAST(round(CAST(amount AS FLOAT)) AS BIGINT) AS amount FROM x WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
)
def daily_records(spark, d, first: str = "1997-03-01", last: str = "1998-02-28"):
    """The bars as files of 32-byte records, and a range of dates read from them again."""
    path = lake.fresh_path(spark, "day")
    b = m.bars(spark, d)
    binary.write_bars(b.select(_ticker(F.col("code")).alias("symbol"), "date", "open", "high", "low", "close", F.col("amount").cast("float").alias("amount"), F.col("volume").cast("long").alias("volume"), F.lit(0).cast("long").alias("spare")), path)
    read = binary.read_bars(spark, path).where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return read.select("symbol", "date", *(rounded(F.col(c)).alias(c) for c in ("open", "high", "low", "close")), "volume", F.round("amount").cast("long").alias("amount"))


@query(
    "s28_minute_records",
    f"""WITH x AS (SELECT user_id, CAST(ts AS DATE) AS date, hour(ts) * 60 + minute(ts) // 5 * 5 AS minute, row(ts, event_id) AS k, CAST(floor(value * 1000 + 0.5) AS BIGINT) AS p, value FROM events),
g AS (SELECT user_id, date, minute, arg_max(p, k) AS close, count(*) AS n, sum(p) AS amount FROM x GROUP BY ALL)
SELECT 'u' || user_id AS symbol, date, arg_min(close, minute) AS open_proxy, arg_max(close, minute) AS close_proxy, CAST(sum(n) AS BIGINT) AS volume, {r('sum(CAST(amount AS FLOAT)::DOUBLE)', 2)} AS amount FROM g GROUP BY user_id, date""",
)
def minute_records(spark, d):
    """Five-minute bars as packed records, read again and rolled up to days: first and last close, volume, amount."""
    e = m.table(spark, d, "events")
    p, k = F.floor(F.col("value") * 1000 + 0.5).cast("long"), F.struct("ts", "event_id")
    minute = (F.hour("ts") * 60 + F.floor(F.minute("ts") / 5) * 5).cast("int")
    g = e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("symbol"), F.to_date("ts").alias("date"), minute.alias("minute")).agg(
        F.min_by(p, k).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, k).alias("close"), F.sum(p).cast("float").alias("amount"), F.count("*").alias("volume")
    )
    path = lake.fresh_path(spark, "minute")
    binary.write_bars(g, path, "minute")
    days = binary.read_bars(spark, path, "minute").groupBy("symbol", "date")
    return days.agg(F.min_by("close", "minute").alias("open_proxy"), F.max_by("close", "minute").alias("close_proxy"), F.sum("volume").alias("volume"), rounded(F.sum(F.col("amount").cast("double")), 2).alias("amount"))
