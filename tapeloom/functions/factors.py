"""Alpha factors and technical indicators as window expressions over enriched bars.

Each is (Column builder, DuckDB expression); `enriched` supplies ret, prev and delta. All share one
window specification, so any number of them is planned as one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.windows import gated, gated_sql, lag, lag_sql, over, trailing

YEAR = math.sqrt(252)


def enriched(bars: DataFrame) -> DataFrame:
    prev = lag("close")
    return bars.select("*", prev.alias("prev"), (over(F.col("close"), prev) - 1).alias("ret"), (F.col("close") - prev).alias("delta")).withColumn(
        "tr", F.when(F.col("prev").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev"))))
    )


ENRICHED_SQL = f"""
e0 AS (SELECT *, {lag_sql('close')} AS prev FROM bars), enriched AS (SELECT *, close / nullif(prev, 0) - 1 AS ret, close - prev AS delta,
  CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM e0)
"""


def change(x: str, n: int) -> Column:
    return over(F.col(x), lag(x, n)) - 1


def change_sql(x: str, n: int) -> str:
    return f"({x} / nullif({lag_sql(x, n)}, 0) - 1)"


def two_means(x: str, a: int, b: int):
    return lambda: over(gated(F.avg, x, a), gated(F.avg, x, b)) - 1, f"{gated_sql('avg', x, a)} / nullif({gated_sql('avg', x, b)}, 0) - 1"


def rank_of_last(x: str, n: int = 20) -> Column:
    """Average-tie rank of the last value among the last n, over n."""
    values = F.collect_list(x).over(trailing(n))
    last = F.col(x)
    less, equal = F.size(F.filter(values, lambda v: v < last)), F.size(F.filter(values, lambda v: v == last))
    return F.when(F.size(values) >= n, (less + (equal + 1) / 2) / n)


def rank_of_last_sql(x: str, n: int = 20) -> str:
    v = f"(list({x}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"
    return f"(CASE WHEN len({v}) >= {n} THEN (len(list_filter({v}, lambda v: v < {x})) + (len(list_filter({v}, lambda v: v = {x})) + 1) / 2.0) / {n} END)"


def _skew(n: Column) -> Column:
    return F.sqrt(n * (n - 1)) / (n - 2)


def skew(x: str, n: int, least: int) -> Column:
    """Bias-corrected skewness (G1)."""
    c = F.count(x).over(trailing(n))
    return F.when(c >= least, F.skewness(x).over(trailing(n)) * _skew(c))


def kurtosis(x: str, n: int, least: int) -> Column:
    """Sample excess kurtosis (G2)."""
    c = F.count(x).over(trailing(n))
    return F.when(c >= least, (c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * F.kurtosis(x).over(trailing(n)) + 6))


def tail_mean(x: str, n: int, share: float, least: int) -> Column:
    """Mean of the ceil(share * count) smallest of the last n."""
    v = F.array_sort(F.collect_list(x).over(trailing(n)))
    k = F.ceil(F.size(v) * share).cast("int")
    return F.when(F.size(v) >= least, F.aggregate(F.slice(v, F.lit(1), F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, b: a + b) / F.greatest(k, F.lit(1)))


def tail_mean_sql(x: str, n: int, share: float, least: int) -> str:
    v = f"(list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"
    return f"(CASE WHEN len({v}) >= {least} THEN list_avg(list_sort({v})[1:CAST(greatest(ceil(len({v}) * {share}), 1) AS BIGINT)]) END)"


def worst_fall(x: str, n: int) -> Column:
    """Largest fall from the running peak within the last n rows."""
    v = F.collect_list(x).over(trailing(n))
    zero = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def step(a: Column, p: Column) -> Column:
        peak = F.greatest(a["peak"], p)
        return F.struct(peak.alias("peak"), F.least(a["fall"], p / peak - 1).alias("fall"))

    return F.when((F.size(v) >= n) & (F.array_min(v) > 0), F.aggregate(v, zero, step, lambda a: a["fall"]))


def worst_fall_sql(x: str, n: int) -> str:
    v = f"(list({x}) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))"
    return f"(CASE WHEN len({v}) >= {n} AND list_min({v}) > 0 THEN list_min(list_transform(range(1, len({v}) + 1), lambda i: {v}[i] / list_max({v}[1:i]) - 1)) END)"


def gain() -> Column:
    return F.coalesce(F.greatest("delta", F.lit(0.0)), F.lit(0.0))


def loss() -> Column:
    return F.coalesce(F.greatest(-F.col("delta"), F.lit(0.0)), F.lit(0.0))


def spread() -> Column:
    return over(gated(F.max, "high", 20, 10) - gated(F.min, "low", 20, 10), F.col("close"))


GAIN, LOSS = "CASE WHEN delta > 0 THEN delta ELSE 0 END", "CASE WHEN delta < 0 THEN -delta ELSE 0 END"
SPREAD = f"({gated_sql('max', 'high', 20, 10)} - {gated_sql('min', 'low', 20, 10)}) / nullif(close, 0)"

FACTORS: dict[str, tuple[Callable[[], Column], str]] = {
    "f01_momentum_20d": (lambda: change("close", 20), change_sql("close", 20)),
    "f02_momentum_60d": (lambda: change("close", 60), change_sql("close", 60)),
    "f03_volatility_20d": (lambda: gated(F.stddev_samp, "ret", 20) * YEAR, f"{gated_sql('stddev_samp', 'ret', 20)} * sqrt(252)"),
    "f04_volatility_60d": (lambda: gated(F.stddev_samp, "ret", 60) * YEAR, f"{gated_sql('stddev_samp', 'ret', 60)} * sqrt(252)"),
    "f05_ma_ratio_5_20": two_means("close", 5, 20),
    "f06_ma_ratio_10_60": two_means("close", 10, 60),
    "f07_volume_ratio_5_20": two_means("volume", 5, 20),
    "f08_rsi_14": (lambda: 100 - 100 / (1 + over(gated(F.avg, gain(), 14), gated(F.avg, loss(), 14))), f"100 - 100 / (1 + {gated_sql('avg', GAIN, 14)} / nullif({gated_sql('avg', LOSS, 14)}, 0))"),
    "f09_price_position_20d": (
        lambda: over(F.col("close") - gated(F.min, "low", 20), gated(F.max, "high", 20) - gated(F.min, "low", 20)),
        f"(close - {gated_sql('min', 'low', 20)}) / nullif({gated_sql('max', 'high', 20)} - {gated_sql('min', 'low', 20)}, 0)",
    ),
    "f10_illiq_20d": (lambda: gated(F.avg, over(F.abs("ret"), F.col("amount")), 20, 10) * 1e9, f"{gated_sql('avg', '(abs(ret) / nullif(amount, 0))', 20, 10)} * 1e9"),
    "f11_close_rank_20d": (lambda: rank_of_last("close"), rank_of_last_sql("close")),
    "f12_pv_divergence_20d": (lambda: rank_of_last("volume") - rank_of_last("close"), f"{rank_of_last_sql('volume')} - {rank_of_last_sql('close')}"),
    "f13_cs_momentum_20d": (lambda: over(1 + change("close", 20), 1 + change("close", 5)) - 1, f"(1 + {change_sql('close', 20)}) / nullif(1 + {change_sql('close', 5)}, 0) - 1"),
    "f15_max_ret_20d": (lambda: gated(F.max, "ret", 20, 10), gated_sql("max", "ret", 20, 10)),
    "f16_reversal_1d": (lambda: -change("close", 1), f"-{change_sql('close', 1)}"),
    "f17_amivest_20d": (lambda: gated(F.avg, F.col("amount") / F.when(F.col("ret").isNotNull(), F.greatest(F.abs("ret"), F.lit(1e-10))), 20, 10), gated_sql("avg", "(amount / CASE WHEN ret IS NOT NULL THEN greatest(abs(ret), 1e-10) END)", 20, 10)),
    "f18_range_20d": (spread, SPREAD),
    "f19_skew_20d": (lambda: skew("ret", 20, 10), gated_sql("skewness", "ret", 20, 10)),
    "f20_reversal_5d": (lambda: -change("close", 5), f"-{change_sql('close', 5)}"),
    "f21_reversal_20d": (lambda: -change("close", 20), f"-{change_sql('close', 20)}"),
    "f22_neg_range_20d": (lambda: -spread(), f"-({SPREAD})"),
    "f25_cvar_95_60d": (lambda: tail_mean("ret", 60, 0.05, 40), tail_mean_sql("ret", 60, 0.05, 40)),
    "f26_max_drawdown_20d": (lambda: worst_fall("close", 20), worst_fall_sql("close", 20)),
    "f27_downside_semivol_20d": (
        lambda: F.sqrt(gated(F.avg, F.pow(F.least(F.coalesce("ret", F.lit(0.0)), F.lit(0.0)), 2), 20, 15)) * YEAR,
        f"sqrt({gated_sql('avg', 'pow(least(coalesce(ret, 0), 0), 2)', 20, 15)}) * sqrt(252)",
    ),
    "f28_kurtosis_20d": (lambda: kurtosis("ret", 20, 15), gated_sql("kurtosis", "ret", 20, 15)),
    "w01_ma_20": (lambda: gated(F.avg, "close", 20, 10), gated_sql("avg", "close", 20, 10)),
    "w03_atr_14": (lambda: gated(F.avg, "tr", 14, 7), gated_sql("avg", "tr", 14, 7)),
    "w04_bollinger_upper": (lambda: gated(F.avg, "close", 20, 10) + 2 * gated(F.stddev_samp, "close", 20, 10), f"{gated_sql('avg', 'close', 20, 10)} + 2 * {gated_sql('stddev_samp', 'close', 20, 10)}"),
    "w04_bollinger_lower": (lambda: gated(F.avg, "close", 20, 10) - 2 * gated(F.stddev_samp, "close", 20, 10), f"{gated_sql('avg', 'close', 20, 10)} - 2 * {gated_sql('stddev_samp', 'close', 20, 10)}"),
    "w08_turnover_z": (
        lambda: F.coalesce(over(F.col("volume") - gated(F.avg, "volume", 20, 10), gated(F.stddev_samp, "volume", 20, 10)), F.lit(0.0)),
        f"coalesce((volume - {gated_sql('avg', 'volume', 20, 10)}) / nullif({gated_sql('stddev_samp', 'volume', 20, 10)}, 0), 0)",
    ),
    "w12_atr_20": (lambda: gated(F.avg, "tr", 20, 1), gated_sql("avg", "tr", 20, 1)),
    "p29_suspended": (lambda: (F.sum(F.when(F.col("volume") == 0, 1).otherwise(0)).over(trailing(5)) >= 3).cast("double"), f"CAST({gated_sql('sum', 'CASE WHEN volume = 0 THEN 1 ELSE 0 END', 5, 1)} >= 3 AS DOUBLE)"),
}
