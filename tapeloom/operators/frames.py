"""Frame operators: roll-ups, as-of join, cross-section statistics, risk, signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.windows import by_code, over


def asof_left(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """`left` with the last `columns` of `right` known at its time: one shuffle on the key, no range join."""
    side = F.lit(None)
    a = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), side.cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("_x"))
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), side.cast(a.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_x"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_x", F.last("_x", ignorenulls=True).over(w)).where("_side = 1")
    return found.select("_row.*", *(F.col(f"_x.{c}").alias(c) for c in columns))


def asof_right(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """`left` with the first `columns` of `right` at or after its time: one shuffle on the key, no range join."""
    none = F.lit(None)
    b = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*columns).alias("_x"))
    a = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), none.cast(b.schema["_x"].dataType).alias("_x"))
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)  # from the end: a frame that shrinks is read anew for each row
    found = a.unionByName(b.withColumn("_row", none.cast(a.schema["_row"].dataType))).withColumn("_x", F.last("_x", ignorenulls=True).over(w)).where("_side = 0")
    return found.select("_row.*", *(F.col(f"_x.{c}").alias(c) for c in columns))


def average_rank(x: str, *by: str) -> Column:
    """Rank with ties averaged, within `by`."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(x).over(Window.partitionBy(*by, x)) - 1) / 2


def correlation(a: str, b: str) -> Column:
    """Pearson's, as an aggregate; null where one of them doesn't vary."""
    return over(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def zscore(x: str, *by: str) -> Column:
    w = Window.partitionBy(*by)
    return over(F.col(x) - F.avg(x).over(w), F.stddev_pop(x).over(w))


def rank_ic(panel: DataFrame, factor: str, forward: str, least: int = 5) -> DataFrame:
    """Spearman correlation of a factor with forward returns, per date."""
    both = panel.where(F.col(factor).isNotNull() & F.col(forward).isNotNull()).select("date", factor, forward)
    ranked = both.select("date", average_rank(factor, "date").alias("a"), average_rank(forward, "date").alias("b"))
    per = ranked.groupBy("date").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic"))
    return per.where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_table(ics: DataFrame, *by: str) -> DataFrame:
    t = ics.groupBy(*by).agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive"), F.count("*").alias("n_periods"))
    return t.withColumn("icir", over(F.col("ic_mean"), F.col("ic_std"))).withColumn("t_stat", over(F.col("ic_mean"), F.col("ic_std") / F.sqrt("n_periods")))


def exponential_mean(rows: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Recursive means y = (1 - a) y + a x per code; one code's history is a group, bounded by its trading days."""
    schema = T.StructType([*rows.schema.fields, *(T.StructField(name, T.DoubleType()) for name in columns)])

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        return g.assign(**{name: g[x].ewm(alpha=a, adjust=False).mean() for name, (x, a) in columns.items()})

    return rows.groupBy("code").applyInPandas(f, schema)


def macd(rows: DataFrame, fast: int = 12, slow: int = 26, smooth: int = 9) -> DataFrame:
    """(code, date, line, signal): the difference of two recursive means of `close`, and its recursive mean, in one pass a code."""
    mean = lambda x, n: x.ewm(alpha=2 / (n + 1), adjust=False).mean()

    def f(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date")
        line = mean(g["close"], fast) - mean(g["close"], slow)
        return g[["code", "date"]].assign(line=line, signal=mean(line, smooth))

    return rows.groupBy("code").applyInPandas(f, T.StructType([rows.schema["code"], rows.schema["date"], T.StructField("line", T.DoubleType()), T.StructField("signal", T.DoubleType())]))


def drawdown(bars: DataFrame, x: str = "close") -> DataFrame:
    peak = F.max(x).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("drawdown", over(F.col(x) - peak, peak))


def value_at_risk(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Historical VaR and CVaR per code."""
    var = returns.where("ret is not null").groupBy("code").agg((-F.percentile("ret", F.lit(1 - confidence))).alias("var"))
    tail = returns.join(var, "code").where(F.col("ret") <= -F.col("var")).groupBy("code").agg((-F.avg("ret")).alias("cvar"))
    return var.join(tail, "code", "left").withColumn("cvar", F.coalesce("cvar", "var"))


def strength(c: Column) -> Column:
    return F.when(c >= 0.8, "very_strong").when(c >= 0.6, "strong").when(c >= 0.4, "moderate").otherwise("weak")


def weighted_direction(signals: DataFrame, *by: str) -> DataFrame:
    """Confidence-weighted direction; beyond 0.1 it is a direction."""
    score = over(F.sum(F.col("direction") * F.col("confidence")), F.sum("confidence"))
    return signals.groupBy(*by).agg(score.alias("score"), F.count("*").alias("n")).withColumn("direction", F.when(F.col("score") > 0.1, 1).when(F.col("score") < -0.1, -1).otherwise(0))


def majority(signals: DataFrame, *by: str) -> DataFrame:
    up, down = F.count_if(F.col("direction") > 0), F.count_if(F.col("direction") < 0)
    return signals.groupBy(*by).agg(up.alias("up"), down.alias("down"), F.count("*").alias("n")).withColumn("direction", F.signum(F.col("up") - F.col("down")).cast("int"))


def first_in(rows: DataFrame, by: list[str], order: list, k: int = 1) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def board(code: Column) -> Column:
    """Board of a security by its code's prefix."""
    return F.when(code.rlike("^(83|87|920)"), "beijing").when(code.rlike("^30[012]"), "gem").when(code.rlike("^68[89]"), "sci_tech").otherwise("main")


def sell_cost(value: Column, date: Column) -> Column:
    """Commission (3 in 10,000, at least 5), and stamp duty (halved on 2023-08-28)."""
    return F.greatest(value * 0.0003, F.lit(5.0)) + value * F.when(date < F.lit("2023-08-28").cast("date"), 0.001).otherwise(0.0005)


def third_friday(month: Column) -> Column:
    return F.date_add(F.next_day(F.date_sub(month, 1), "FRI"), 14)
