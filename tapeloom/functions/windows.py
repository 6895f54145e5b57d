"""Row-count windows per code, with a least count of known values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("date")


def trailing(n: int) -> WindowSpec:
    return by_code().rowsBetween(1 - n, 0)


def gated(agg: Callable, x: str | Column, n: int, least: int | None = None) -> Column:
    """agg over the last n rows, null below `least` (default n) known values."""
    w = trailing(n)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def lag(x: str | Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_code())


def over(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# the same for SQL
def gated_sql(agg: str, x: str, n: int, least: int | None = None) -> str:
    w = f"OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {agg}({x}) {w} END)"


def lag_sql(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY code ORDER BY date)"


def rounded_sql(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"
