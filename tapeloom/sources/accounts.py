"""Annual and quarterly accounts per code, derived from the trade lines by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUMS = {
    "gross": "sum(l_extendedprice)",
    "revenue": "sum(l_extendedprice * (1 - l_discount))",
    "cip": "sum(l_extendedprice * l_tax)",
    "depreciation": "sum(l_extendedprice * l_discount)",
    "receivables": "sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)",
    "kept_sales": "sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)",
    "open_orders": "sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END)",
}
_DERIVED = {
    "assets": "2 * gross",
    "current_assets": "receivables + 0.5 * open_orders",
    "ppe": "0.4 * gross",
    "net_income": "revenue - 0.85 * gross - 0.5 * cip",
    "ocf": "kept_sales - 0.6 * gross",
    "equity": "1.2 * gross - cip",
}
ACCOUNTS = [c for c in (*_SUMS, *_DERIVED) if c not in ("kept_sales", "open_orders")]


def accounts(spark: SparkSession, sf_dir: str, per: str = "year") -> DataFrame:
    """(code, period, accounts): period is the first day of the year or quarter."""
    period = F.trunc("l_shipdate", per).alias("period")
    sums = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("code"), period).agg(*(F.expr(x).alias(c) for c, x in _SUMS.items()))
    return sums.select("*", *(F.expr(x).alias(c) for c, x in _DERIVED.items())).select("code", "period", *ACCOUNTS)


def accounts_sql(per: str = "year") -> str:
    sums = ", ".join(f"{x} AS {c}" for c, x in _SUMS.items())
    derived = ", ".join(f"{x} AS {c}" for c, x in _DERIVED.items())
    return f"sums AS (SELECT l_suppkey AS code, CAST(date_trunc('{per}', l_shipdate) AS DATE) AS period, {sums} FROM lineitem GROUP BY ALL), accounts AS (SELECT *, {derived} FROM sums)"
