"""Factor expressions: trees of operators over bars, as staged columns and as SQL.

A tree is a column's name or (operator, trees and numbers ...). Time-series operators run per code by
date, `rank` and `scale` per date. Windows can't nest in one expression, so each operator adds a column;
equal subtrees are computed once, and Catalyst shares the exchange of neighbours with the same window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import gated, gated_sql, lag, lag_sql, over

Tree = str | tuple


def _rolling(agg: Callable, name: str):
    least = lambda n: max(1, min(int(n), 60) // 2)
    return lambda x, n: gated(agg, x, int(n), least(n)), lambda x, n: gated_sql(name, x, int(n), least(n))


def _rank(x: str) -> Column:
    by = Window.partitionBy("date")
    r = F.rank().over(by.orderBy(F.col(x).asc_nulls_last())) + (F.count(x).over(Window.partitionBy("date", x)) - 1) / 2
    return F.when(F.col(x).isNotNull(), r / F.count(x).over(by))


def _scale(x: str) -> Column:
    w = Window.partitionBy("date")
    return F.when(F.stddev_samp(x).over(w) > 1e-12, (F.col(x) - F.avg(x).over(w)) / F.stddev_samp(x).over(w))


def _clipped(n: float, most: int) -> int:
    return max(1, min(int(n), most))


_DAY = "OVER (PARTITION BY date)"
#: operator: (Column of its arguments, the same in SQL); arguments are column names, then numbers.
OPERATORS: dict[str, tuple[Callable, Callable]] = {
    "neg": (lambda x: -F.col(x), lambda x: f"-{x}"),
    "abs": (lambda x: F.abs(x), lambda x: f"abs({x})"),
    "log": (lambda x: F.when(F.col(x).isNotNull(), F.log(F.greatest(F.abs(x), F.lit(1e-10)))), lambda x: f"CASE WHEN {x} IS NOT NULL THEN ln(greatest(abs({x}), 1e-10)) END"),
    "sqrt": (lambda x: F.sqrt(F.abs(x)), lambda x: f"sqrt(abs({x}))"),
    "rank": (_rank, lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) {_DAY} END"),
    "scale": (_scale, lambda x: f"CASE WHEN stddev_samp({x}) {_DAY} > 1e-12 THEN ({x} - avg({x}) {_DAY}) / stddev_samp({x}) {_DAY} END"),
    "delay": (lambda x, n: lag(x, _clipped(n, 20)), lambda x, n: lag_sql(x, _clipped(n, 20))),
    "delta": (lambda x, n: F.col(x) - lag(x, _clipped(n, 60)), lambda x, n: f"{x} - {lag_sql(x, _clipped(n, 60))}"),
    "sma": _rolling(F.avg, "avg"),
    "std": _rolling(F.stddev_samp, "stddev_samp"),
    "ts_sum": _rolling(F.sum, "sum"),
    "ts_min": _rolling(F.min, "min"),
    "ts_max": _rolling(F.max, "max"),
    "add": (lambda x, y: F.col(x) + F.col(y), lambda x, y: f"{x} + {y}"),
    "sub": (lambda x, y: F.col(x) - F.col(y), lambda x, y: f"{x} - {y}"),
    "mul": (lambda x, y: F.col(x) * F.col(y), lambda x, y: f"{x} * {y}"),
    "safe_div": (
        lambda x, y: F.when(F.col(x).isNull() | F.col(y).isNull() | (F.col(y) == 0), 0.0).otherwise(F.greatest(F.least(over(F.col(x), F.abs(y)), F.lit(10.0)), F.lit(-10.0))),
        lambda x, y: f"CASE WHEN {x} IS NULL OR {y} IS NULL OR {y} = 0 THEN 0.0 ELSE greatest(least({x} / abs({y}), 10.0), -10.0) END",
    ),
    "max": (lambda x, y: F.greatest(x, y), lambda x, y: f"greatest({x}, {y})"),
    "min": (lambda x, y: F.least(x, y), lambda x, y: f"least({x}, {y})"),
}


def steps(tree: Tree) -> tuple[list[tuple[str, str, tuple]], str]:
    """(new column, operator, arguments) with arguments before their use, and the column of the whole."""
    made: dict[Tree, str] = {}
    out: list[tuple[str, str, tuple]] = []

    def visit(t):
        if isinstance(t, str):
            return t
        if t not in made:
            args = tuple(visit(a) if isinstance(a, (str, tuple)) else a for a in t[1:])
            made[t] = f"n{len(made)}_"
            out.append((made[t], t[0], args))
        return made[t]

    return out, visit(tree)


def evaluate(bars: DataFrame, tree: Tree, name: str = "value") -> DataFrame:
    """`bars` with the value of the tree."""
    todo, last = steps(tree)
    df = bars
    for column, operator, args in todo:
        df = df.withColumn(column, OPERATORS[operator][0](*args))
    return df.select(*bars.columns, F.col(last).alias(name))


def evaluate_sql(table: str, tree: Tree) -> tuple[str, str, str]:
    """Common table expressions, the last one's name, and the column of the value."""
    todo, last = steps(tree)
    parts = []
    for i, (column, operator, args) in enumerate(todo):
        parts.append(f"x{i} AS (SELECT *, {OPERATORS[operator][1](*args)} AS {column} FROM {table})")
        table = f"x{i}"
    return ", ".join(parts), table, last


def complexity(tree: Tree) -> int:
    return 1 if not isinstance(tree, tuple) else 1 + sum(complexity(a) for a in tree[1:] if isinstance(a, (str, tuple)))
