"""Market tables derived from the trade tables: ticks, bars, statements, signals, securities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources import lake

#: Months from a quarter's end to the date its statement counts as known.
STATEMENT_DELAY = {3: 3, 6: 2, 9: 3, 12: 4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TRADE = ("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def ticks(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One row per trade; `k` orders the trades of a day. With `parts`, dealt by code into so many: the columns of the file are shipped, not those made of them."""
    rows = table(spark, sf_dir, "lineitem").select(*_TRADE)
    return (rows if parts is None else rows.repartition(parts, "l_suppkey")).select(
        F.col("l_suppkey").alias("code"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("k"),
    )


def ohlcv(rows: DataFrame, *keys: str | Column, order: str = "k") -> DataFrame:
    """Roll-up to open, high, low, close, volume and amount; partial aggregates before the one shuffle, which dealt rows don't need."""
    o, h, l, c = ("price",) * 4 if "price" in rows.columns else ("open", "high", "low", "close")
    return rows.groupBy(*keys).agg(
        F.min_by(o, order).alias("open"), F.max(h).alias("high"), F.min(l).alias("low"), F.max_by(c, order).alias("close"), F.sum("volume").alias("volume"), F.sum("amount").alias("amount")
    )


BAR_COLUMNS = ("code", "date", "open", "high", "low", "close", "volume", "amount")


def written_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars and their year: rolled up once, then a table partitioned by year and bucketed by code. Days have few trades, so trades are dealt into the buckets and rolled up there."""
    make = lambda buckets: ohlcv(ticks(spark, sf_dir, buckets), "code", "date").select(*BAR_COLUMNS, F.year("date").alias("year"))
    return lake.of_inputs(spark, "bars", sf_dir, ("lineitem",), ("code", "date"), "year", "code", make, dealt=True)[1]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (code, date, open, high, low, close, volume, amount)."""
    return written_bars(spark, sf_dir).select(*BAR_COLUMNS)


def bars_between(spark: SparkSession, sf_dir: str, first: str, last: str) -> DataFrame:
    """Bars from `first` to `last` (dates): other years' folders aren't opened, and the date reaches the scan."""
    years = F.col("year").between(int(first[:4]), int(last[:4]))
    return written_bars(spark, sf_dir).where(years & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*BAR_COLUMNS)


def bars_on(spark: SparkSession, sf_dir: str, dates: list[str]) -> DataFrame:
    """Bars of the dates given, read as bars_between reads them."""
    wanted = F.col("year").isin([int(x[:4]) for x in dates]) & F.col("date").isin([F.lit(x).cast("date") for x in dates])
    return written_bars(spark, sf_dir).where(wanted).select(*BAR_COLUMNS)


def dealt_by_date(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows, dealt by date into as many parts as follow the trades' size, so that sorts and windows of a date's rows stay in memory."""
    return rows.repartition(lake.buckets_of(spark, [f"{sf_dir}/lineitem.parquet"]), "date")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly revenue per code with the date from which it counts as known."""
    quarter_end = F.last_day(F.add_months(F.trunc("date", "quarter"), 2))
    q = ticks(spark, sf_dir).groupBy("code", quarter_end.alias("report_date")).agg(F.sum("amount").alias("revenue"), F.sum("volume").alias("units"))
    delay = F.coalesce(*(F.when(F.month("report_date") == m, n) for m, n in STATEMENT_DELAY.items()))
    return q.withColumn("effective_date", F.add_months("report_date", delay))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("symbol"), "ts", kind.alias("source"),
        F.when(kind.isin("purchase", "signup"), 1).when(kind == "error", -1).otherwise(0).alias("direction"), (F.col("value") / (F.col("value") + 50)).alias("confidence"),
    )


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("sector"))


#: The same tables for DuckDB, as common table expressions.
SQL = """
ticks AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS amount,
  row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem),
bars AS (SELECT code, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(volume) AS volume, sum(amount) AS amount FROM ticks GROUP BY code, date)
"""
STATEMENTS_SQL = """
q AS (SELECT code, last_day(CAST(date_trunc('quarter', date) + INTERVAL 2 MONTH AS DATE)) AS report_date, sum(amount) AS revenue, sum(volume) AS units FROM ticks GROUP BY ALL),
statements AS (SELECT *, CAST(report_date + to_months(CAST(CASE month(report_date) WHEN 3 THEN 3 WHEN 6 THEN 2 WHEN 9 THEN 3 ELSE 4 END AS INTEGER)) AS DATE) AS effective_date FROM q)
"""
SIGNALS_SQL = """
signals AS (SELECT event_id AS id, user_id AS symbol, ts, event_type AS source, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS direction,
  value / (value + 50) AS confidence FROM events)
"""
SECURITIES_SQL = "securities AS (SELECT s_suppkey AS code, s_name AS name, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
