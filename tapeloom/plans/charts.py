"""Point-and-figure charts, breakouts and strokes by ordered folds, with their SQL where it has an answer."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeloom.functions import arrays
from tapeloom.functions.windows import rounded, rounded_sql
from tapeloom.operators import folds
from tapeloom.plans.catalog import query
from tapeloom.sources import lake
from tapeloom.sources import market as m

r = rounded_sql
_BARS = f"WITH {m.SQL}"
SIZE, REVERSAL = 0.1, 3
#: Columns from a chart's end in which a breakout is sought.
WITHIN = 15


@query(
    "e62_valid_bars",
    f"""{_BARS}, v AS (SELECT code, open > 0 AND close > 0 AND high > 0 AND low > 0 AND low <= close AND close <= high AND low <= open AND open <= high AS ok FROM bars)
SELECT code, count(*) FILTER (ok) AS valid, count(*) FILTER (ok IS NOT TRUE) AS skipped, {r('count(*) FILTER (ok) / count(*)')} AS coverage FROM v GROUP BY code""",
)
def valid_counts(spark, d):
    ok = F.coalesce(_valid(), F.lit(False))
    return m.bars(spark, d).groupBy("code").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("skipped"), rounded(F.count_if(ok) / F.count("*")).alias("coverage"))


def _valid():
    """Prices that are there, positive, and within the bar's range."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    ok = F.lit(True)
    for p in prices:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (p > 0)
    return ok & F.col("close").between(F.col("low"), F.col("high")) & F.col("open").between(F.col("low"), F.col("high"))


@query("e61_strokes", None)
def strokes(spark, d):
    """Alternating strokes of each code's valid bars; tests hold them against a plain reading of the rule."""
    return folds.ordered_fold(m.bars(spark, d).where(_valid()), "code", ["date"], ["date", "high", "low"], lambda _: folds.Strokes(), "code bigint, start date, start_price double, end date, end_price double, up boolean")


@query("e61_stroke_summary", None)
def stroke_summary(spark, d, least: int = 10):
    """By code: number of strokes, the last one's direction, its end, and whether it ends above the last high but one."""
    s = strokes(spark, d)
    n = m.bars(spark, d).where(_valid()).groupBy("code").agg(F.count("*").alias("bars")).where(F.col("bars") >= least)
    w = Window.partitionBy("code").orderBy("end")
    s = s.withColumns({"before": F.lag("start_price", 2).over(w), "peak": F.lag("end_price", 2).over(w)})
    last = s.groupBy("code").agg(F.count("*").alias("strokes"), F.max_by(F.struct("up", "end", "end_price", "before", "peak"), "end").alias("x"))
    third = ~F.col("x.up") & (F.col("x.end_price") > F.col("x.before"))
    return n.join(last, "code", "left").select("code", "bars", F.coalesce("strokes", F.lit(0)).alias("strokes"), F.when(F.col("x.up"), 1).when(~F.col("x.up"), -1).otherwise(0).alias("direction"), F.col("x.end").alias("end"), F.col("x.end_price").alias("price"), F.coalesce(third, F.lit(False)).alias("held_above"))


# point and figure
def _charts(spark, d, size: float, reversal: int, log: bool, of: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """(code, step, ...): what `of` makes of a chart's columns; a box is `size` of the price (log) or of the code's median price.

    The median is of a code's highs and lows, so its rows are taken together and need no join with it."""
    b = m.bars(spark, d).where("code IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL").select("code", "date", "open", "high", "low", "close")
    schema = T.StructType([b.schema["code"], T.StructField("step", T.DoubleType()), *T.StructType.fromDDL(schema)])
    kinds = to_arrow_schema(schema)

    def made(t: pa.Table, starts: np.ndarray) -> pa.Table:
        out: list[tuple] = []
        bounds = [*np.flatnonzero(starts).tolist(), t.num_rows]
        codes, prices = t["code"].to_pylist(), [t[c].to_pylist() for c in ("open", "high", "low", "close")]
        for x, e in zip(bounds, bounds[1:]):
            own = [p[x:e] for p in prices]
            both = np.sort(np.array(own[1] + own[2], float))  # an even number of them
            width = float(both[e - x - 1] + both[e - x]) / 2 * size
            chart, drawn = folds.PointFigure(reversal, log), []
            step = math.log(1 + max(size, 1e-4)) if log else max(width, 0.01)
            for row in zip(*own):
                drawn += chart.add(step, *row)
            drawn += chart.end()
            out += [(codes[x], width if log else step, *y) for y in of(drawn)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(kinds), kinds)], schema=kinds)

    return arrays.whole_codes(b, made, schema)


def columns(spark, d, size: float = SIZE, reversal: int = REVERSAL, log: bool = True) -> DataFrame:
    """(code, step, number, up, levels): columns of a chart."""
    return _charts(spark, d, size, reversal, log, lambda drawn: drawn, "number int, up boolean, levels array<double>")


def _spans(spark, d, last: int | None = None) -> DataFrame:
    """Columns by their highest and lowest box; with `last`, each chart's last so many."""
    of = lambda drawn: [(number, up, max(levels), min(levels), len(levels)) for number, up, levels in drawn[-last if last else None :]]
    return _charts(spark, d, SIZE, REVERSAL, True, of, "number int, up boolean, high double, low double, boxes int")


@query("e48_point_and_figure", None)
def point_and_figure(spark, d):
    """Every box of each code's chart; tests hold it against a plain reading of the rule."""
    c = columns(spark, d)
    return c.select("code", "number", "up", F.posexplode("levels").alias("box", "level")).withColumn("level", rounded(F.col("level")))


@query("e49_congestion", None)
def congestion(spark, d):
    """Zone, target and phase hint of each code's chart."""
    found = folds.ordered_fold(_spans(spark, d), "code", ["number"], ["step", "high", "low", "boxes"], lambda _: folds.Congestion(), "code bigint, columns int, zone_low double, zone_high double, target double, hint string")
    return found.select("code", "columns", *(rounded(F.col(c)).alias(c) for c in ("zone_low", "zone_high", "target")), "hint")


def breakouts(spans: DataFrame, within: int = WITHIN, apart: int = 3, late: int = 4) -> DataFrame:
    """(code, signal) from (code, number, high, low, step): of each code's last `within` columns, two of `apart` or more
    from each other with tops (or bottoms) within 0.3 boxes, and one of the last `late` columns two boxes beyond.

    Levels are dealt into buckets as wide as the tolerance, so that a top meets those of its own and the next buckets
    by an equi-join, not every other column."""
    by = Window.partitionBy("code")
    c = spans.withColumn("n", F.max("number").over(by) + 1)
    on = by.orderBy(F.desc("number")).rowsBetween(Window.unboundedPreceding, -1)  # the columns after it, from the end
    recent = F.col("number") >= F.col("n") - late
    c = c.withColumns({"over": F.max(F.when(recent, F.col("high"))).over(on), "under": F.min(F.when(recent, F.col("low"))).over(on)}).where((F.col("n") >= 12) & (F.col("number") >= F.greatest(F.lit(0), F.col("n") - within)) & (F.col("step") > 0))
    found = []
    for name, level, beyond, place in (("double_top_buy", "high", "over", 0), ("double_bottom_sell", "low", "under", 1)):
        tolerance = F.col("step") * 0.3
        bucket = F.floor(F.col(level) / tolerance)
        first = c.select("code", "n", "step", F.col("number").alias("i"), F.col(level).alias("a"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
        second = c.select("code", F.col("number").alias("j"), F.col(level).alias("b"), F.col(beyond).alias("x"), bucket.alias("bucket"))
        met = first.join(second, ["code", "bucket"]).where((F.col("j") - F.col("i") >= apart) & (F.col("j") <= F.col("n") - 2) & (F.abs(F.col("a") - F.col("b")) <= tolerance))
        broken = F.col("x") > F.greatest("a", "b") + 2 * F.col("step") if place == 0 else F.col("x") < F.least("a", "b") - 2 * F.col("step")
        found.append(met.where(broken).select("code", F.lit(place).alias("place"), F.lit(name).alias("signal")))
    best = found[0].unionByName(found[1]).groupBy("code").agg(F.min_by("signal", "place").alias("signal"))
    return spans.select("code").distinct().join(best, "code", "left").select("code", F.coalesce("signal", F.lit("none")).alias("signal"))


@query("j23_breakouts", None)
def chart_breakouts(spark, d):
    """Double tops and bottoms that the last columns of each code's chart break; tests hold it against all pairs."""
    return breakouts(lake.written(_spans(spark, d, WITHIN), "spans"))


# peaks
_PEAKS = f"""{_BARS}, h AS (SELECT code, date, close, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY code) AS n, max(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS top,
  min(close) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS after FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
c AS (SELECT * FROM h WHERE pos >= 20 AND pos < n - 20 AND close = top AND (close - after) / close >= 0.05),
k AS (SELECT code, list_reduce(list_transform(list(pos ORDER BY pos), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 60 THEN list_concat(a, x) ELSE a END) AS kept FROM c GROUP BY code)"""


@query("t11_local_highs", f"{_PEAKS} SELECT code, date, {r('close')} AS price, {r('(close - after) / close')} AS drop FROM c JOIN (SELECT code, unnest(kept) AS pos FROM k) USING (code, pos)")
def local_highs(spark, d, gap: int = 60, drop: float = 0.05, window: int = 20):
    """Closes that are the highest of the bars `window` before and after, fall by `drop` within 60 bars, and stand `gap` bars or more from the one kept before."""
    by = Window.partitionBy("code")
    w = by.orderBy("date")
    h = m.bars(spark, d).select("code", "date", "close", (F.row_number().over(w) - 1).alias("at"), F.count("*").over(by).alias("n"), F.max("close").over(w.rowsBetween(-window, window)).alias("top"), F.min("close").over(w.rowsBetween(1, 60)).alias("after"))
    peaks = h.where((F.col("at") >= window) & (F.col("at") < F.col("n") - window) & (F.col("close") == F.col("top"))).withColumn("drop", (F.col("close") - F.col("after")) / F.col("close")).where(F.col("drop") >= drop)
    kept = folds.ordered_fold(peaks, "code", ["at"], ["at", "date", "close", "drop"], lambda _: folds.Apart(gap), "code bigint, at int, date date, price double, drop double")
    return kept.select("code", "date", rounded(F.col("price")).alias("price"), rounded(F.col("drop")).alias("drop"))
