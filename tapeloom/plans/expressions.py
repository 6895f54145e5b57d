"""Queries of factor expressions, one for each operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import expressions as ex
from tapeloom.functions import factors as fx
from tapeloom.functions.windows import gated, gated_sql, rounded, rounded_sql
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m

TREES = {
    "d01_neg": ("neg", "ret"), "d02_abs": ("abs", "ret"), "d03_log": ("log", "volume"), "d04_sqrt": ("sqrt", "delta"), "d05_rank": ("rank", "ret"), "d06_scale": ("scale", "ret"),
    "d07_delay": ("delay", "close", 5), "d08_delta": ("delta", "close", 10), "d09_sma": ("sma", "volume", 20), "d10_std": ("std", "ret", 20), "d11_ts_sum": ("ts_sum", "volume", 10),
    "d12_ts_min": ("ts_min", "low", 10), "d13_ts_max": ("ts_max", "high", 10), "d14_arithmetic": ("mul", ("add", "high", "low"), ("sub", "close", "open")),
    "d15_safe_div": ("safe_div", ("delta", "close", 5), "delta"), "d16_extremes": ("max", ("min", "ret", "momentum"), ("delay", "ret", 1)),
    "d17_terminals": ("sub", ("mul", "momentum", "vol20"), ("safe_div", "close", "vwap")), "d18_tree": ("rank", ("sub", ("rank", ("delta", "close", 5)), ("scale", ("sma", "volume", 10)))),
}


def terminals(spark, d):
    """Bars with the leaves of a tree."""
    e = fx.enriched(m.bars(spark, d))
    return e.select("code", "date", "open", "high", "low", "close", "volume", "ret", "delta", fx.change("close", 20).alias("momentum"), gated(F.stddev_samp, "ret", 20).alias("vol20"), (F.col("amount") / F.col("volume")).alias("vwap"))


TERMINALS_SQL = f"WITH {m.SQL}, {fx.ENRICHED_SQL}, base AS (SELECT code, date, open, high, low, close, volume, ret, delta, {fx.change_sql('close', 20)} AS momentum, {gated_sql('stddev_samp', 'ret', 20)} AS vol20, amount / volume AS vwap FROM enriched)"


def _add(name: str, tree: ex.Tree) -> None:
    parts, table, last = ex.evaluate_sql("base", tree)
    query(name, f"{TERMINALS_SQL}, {parts} SELECT code, date, {rounded_sql(last)} AS value FROM {table}")(
        lambda spark, d: ex.evaluate(terminals(spark, d), tree).select("code", "date", rounded(F.col("value")).alias("value"))
    )


for _name, _tree in TREES.items():
    _add(_name, _tree)
