"""Resampling and breaks by prefix sums: symmetric cross-validation, block bootstraps, long-run variance, Chow tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with their place (from 0) and the number of rows of their group."""
    w = Window.partitionBy(by)
    return rows.withColumns({"at": (F.row_number().over(w.orderBy(order)) - 1).cast("long"), "n": F.count("*").over(w)})


def draw(*of: Column | int, below: Column) -> Column:
    """A number from 0 to below - 1 that depends on `of` alone, not on partitions, machines or the order of rows."""
    name = F.concat_ws(":", *(F.lit(x) if isinstance(x, int) else x.cast("string") for x in of))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % below


# combinatorially symmetric cross-validation
def slice_sums(panel: DataFrame, slices: int) -> DataFrame:
    """One row: the strategies in name order, each with its sums and sums of squares by slice, and the dates by slice.

    panel: (strategy, t, x); dates are split into slices as even as can be, longer ones first; without a row x is 0."""
    dates = panel.select("t").distinct().withColumn("all", F.lit(0))
    dates = numbered(dates, "all", "t")  # a row a date
    q, rest = F.floor(F.col("n") / slices), F.col("n") % slices
    place = F.when(F.col("at") < rest * (q + 1), F.floor(F.col("at") / (q + 1))).otherwise(rest + F.floor((F.col("at") - rest * (q + 1)) / q)).cast("int")
    dates = dates.select("t", place.alias("slice"))
    sums = panel.join(dates, "t").groupBy("strategy", "slice").agg(F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    every = F.sequence(F.lit(0), F.lit(slices - 1))
    filled = lambda c: F.transform(every, lambda i: F.coalesce(F.try_element_at(F.map_from_entries(F.collect_list(F.struct("slice", c))), i), F.lit(0.0)))
    by = sums.groupBy("strategy").agg(filled("s1").alias("s1"), filled("s2").alias("s2"))
    counts = dates.groupBy("slice").agg(F.count("*").alias("n"))
    lengths = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "n"))), lambda x: x["n"].cast("double")).alias("lengths"))
    return by.agg(F.array_sort(F.collect_list(F.struct("strategy", "s1", "s2"))).alias("strategies")).crossJoin(lengths)


def _inner(values: Column, bits: Column) -> Column:
    return F.aggregate(F.zip_with(values, bits, lambda x, b: x * b), F.lit(0.0), lambda a, x: a + x)


def _sharpe(s1: Column, s2: Column, n: Column, year: float, free: float) -> Column:
    mean = s1 / n
    return F.sqrt(F.lit(year)) * (mean - free) / F.sqrt(F.greatest((s2 - n * mean * mean) / (n - 1), F.lit(1e-12)))


def symmetric_splits(panel: DataFrame, slices: int = 16, free: float = 0.025, year: float = 252.0) -> DataFrame:
    """One row a split of the slices into halves: the best strategy in sample, its Sharpe ratios in and out of sample,
    and its relative rank out of sample. The panel is read once; splits work on sums by slice, a few hundred numbers.

    Of equally good strategies the first by name is best. Needs two strategies and two dates a slice."""
    per = free / year if year > 1 else free
    one = slice_sums(panel, slices)
    splits = panel.sparkSession.range(1 << slices).where(F.bit_count("id") == slices // 2)
    bits = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.getbit("id", i).cast("double"))
    t = splits.crossJoin(F.broadcast(one)).withColumn("bits", bits)  # one row
    t = t.withColumn("rest", F.transform("bits", lambda b: 1 - b)).withColumns({"n_in": _inner(F.col("lengths"), F.col("bits")), "n_out": _inner(F.col("lengths"), F.col("rest"))})
    ratio = lambda s, half, n: _sharpe(_inner(s["s1"], F.col(half)), _inner(s["s2"], F.col(half)), F.col(n), year, per)
    t = t.select("id", F.transform("strategies", lambda s: ratio(s, "bits", "n_in")).alias("inside"), F.transform("strategies", lambda s: ratio(s, "rest", "n_out")).alias("outside"), F.transform("strategies", lambda s: s["strategy"]).alias("names"))
    best = F.array_position("inside", F.array_max("inside")).cast("int")
    t = t.withColumn("best", best).withColumns({"best_in": F.element_at("inside", F.col("best")), "best_out": F.element_at("outside", F.col("best")), "strategy": F.element_at("names", F.col("best"))})
    rank = F.size(F.filter("outside", lambda x: x <= F.col("best_out"))) / (F.size("outside") + 1.0)
    return t.select("id", "strategy", "best_in", "best_out", F.least(F.greatest(rank, F.lit(1e-6)), F.lit(1 - 1e-6)).alias("rank"))


def overfitting(splits: DataFrame) -> DataFrame:
    """One row: the probability of backtest overfitting and what goes with it."""
    logit = F.log(F.col("rank") / (1 - F.col("rank")))
    return splits.agg(
        F.count("*").alias("splits"), F.avg((F.col("rank") <= 0.5).cast("double")).alias("pbo"), F.avg("rank").alias("mean_rank"), F.median("rank").alias("median_rank"), F.avg(logit).alias("mean_logit"), F.median(logit).alias("median_logit"),
        F.avg((F.col("best_out") <= 0).cast("double")).alias("prob_loss"), F.avg("best_in").alias("mean_in"), F.avg("best_out").alias("mean_out"), F.avg(F.col("best_out") - F.col("best_in")).alias("degradation"),
        F.regr_intercept("best_out", "best_in").alias("alpha"), F.regr_slope("best_out", "best_in").alias("beta"),
    )


# bootstraps
def moving_block_interval(series: DataFrame, block: int = 10, draws: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, n, mean, low, high): percentile interval of the mean of a series (key, t, x) over resampled blocks.

    A draw takes ceil(n / block) overlapping blocks, the last one cut so that n values are taken. Blocks are drawn by
    `draw` and summed as differences of prefix sums, so a draw costs a row a block and any partitioning gives the
    same interval. Nulls are left out; with fewer than 3 * block values there is no interval."""
    w = Window.partitionBy("key").orderBy("at")
    s = numbered(series.where("x IS NOT NULL AND NOT isnan(x)"), "key", "t")
    rest = (F.col("n") - (F.ceil(F.col("n") / block) - 1) * block).cast("int")
    s = s.withColumn("upto", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("values", F.collect_list("x").over(w.rowsBetween(0, block - 1)))
    total = lambda v, n: F.aggregate(F.slice(v, F.lit(1), n), F.lit(0.0), lambda a, x: a + x)
    starts = s.where(F.col("at") <= F.col("n") - block).select("key", F.col("at").alias("start"), total(F.col("values"), F.lit(block)).alias("full"), total(F.col("values"), rest).alias("cut"))
    keys = s.groupBy("key").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    plan = keys.where(F.col("n") >= 3 * block).select("key", "n", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    plan = plan.withColumn("start", draw(seed, F.col("key"), F.col("draw"), F.col("j"), below=F.col("n") - block + 1))
    means = plan.join(starts, ["key", "start"]).groupBy("key", "draw").agg((F.sum(F.when(F.col("j") == F.col("blocks") - 1, F.col("cut")).otherwise(F.col("full"))) / F.first("n")).alias("mean"))
    ends = means.groupBy("key").agg(F.percentile("mean", F.lit(alpha / 2)).alias("low"), F.percentile("mean", F.lit(1 - alpha / 2)).alias("high"))
    return keys.join(ends, "key", "left").select("key", "n", "mean", "low", "high")


def fixed_block_interval(series: DataFrame, draws: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(key, n, low, high, p, significant) of a short series (key, t, x): quarters of it are drawn whole.

    Blocks have max(1, n // 4) values, the last one what is left; a draw takes as many blocks as there are, up to n
    values. p is twice the share of draws on the other side of 0. Fewer than 3 values give 0, 0, 1 and false."""
    s = numbered(series.where("x IS NOT NULL AND NOT isnan(x)"), "key", "t")
    size = F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("int")
    s = s.withColumn("size", size).withColumn("block", F.floor(F.col("at") / F.col("size")).cast("int"))
    blocks = s.groupBy("key", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("values"))  # a quarter of a series
    keys = s.groupBy("key").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.avg("x").alias("mean"))
    plan = keys.where("n >= 3").withColumn("blocks", F.ceil(F.col("n") / F.col("size")).cast("int"))
    plan = plan.select("key", "n", "mean", "blocks", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    plan = plan.withColumn("block", draw(seed, F.col("key"), F.col("draw"), F.col("j"), below=F.col("blocks")).cast("int"))
    met = plan.join(blocks, ["key", "block"])
    before = F.coalesce(F.sum(F.size("values")).over(Window.partitionBy("key", "draw").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.slice("values", F.lit(1), F.greatest(F.lit(0), F.least(F.size("values"), F.col("n") - before)).cast("int"))
    met = met.withColumn("taken", taken)
    means = met.groupBy("key", "draw").agg((F.sum(F.aggregate("taken", F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("taken"))).alias("m"), F.first("mean").alias("mean"))
    side = F.when(F.col("mean") > 0, F.col("m") <= 0).otherwise(F.col("m") >= 0)
    tail = (1 - level) / 2
    ends = means.groupBy("key").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.avg(side.cast("double")).alias("zero"))
    both = keys.join(ends, "key", "left")
    return both.select(
        "key", "n", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.coalesce(F.least(F.lit(1.0), F.col("zero") * 2), F.lit(1.0)).alias("p"),
        F.coalesce(((F.col("low") > 0) & (F.col("high") > 0)) | ((F.col("low") < 0) & (F.col("high") < 0)), F.lit(False)).alias("significant"),
    )


def long_run_t(series: DataFrame, horizon: int = 5) -> DataFrame:
    """(key, n, lags, mean, t): Newey-West t of the mean of a series (key, t, x); 0 below 10 values or without variance.

    Each value meets the next `lags` ones by place, a row a lag, with weights falling to 0."""
    s = numbered(series.where("x IS NOT NULL AND NOT isnan(x)"), "key", "t")
    lags = F.greatest(F.lit(horizon - 1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))).cast("int")
    s = s.select("key", "at", "n", lags.alias("lags"), (F.col("x") - F.avg("x").over(Window.partitionBy("key"))).alias("e"), F.avg("x").over(Window.partitionBy("key")).alias("mean"))
    late = s.select("key", "e", "n", "lags", "mean", F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("lag"), "at").select("key", "n", "lags", "mean", "lag", F.col("e").alias("late"), (F.col("at") - F.col("lag")).alias("at"))
    g = late.join(s.select("key", "at", "e"), ["key", "at"]).groupBy("key", "n", "lags", "mean", "lag").agg(F.avg(F.col("e") * F.col("late")).alias("g"))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1.0)))
    v = g.groupBy("key", "n", "lags", "mean").agg((F.sum(weight * F.col("g")) / F.first("n")).alias("v"))
    few, flat = F.col("n") < 10, F.col("v") <= 1e-12
    return v.select("key", "n", "lags", F.when(few, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(few | flat, 0.0).otherwise(F.col("mean") / F.sqrt(F.greatest("v", F.lit(1e-300)))).alias("t"))


# breaks
_SUMS = {"x": ("x",), "y": ("y",), "xx": ("x", "x"), "xy": ("x", "y"), "yy": ("y", "y")}


def _rest(n: Column, s: dict[str, Column]) -> Column:
    """Residual sum of squares of y on 1 and x, from sums."""
    sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / n, s["xy"] - s["x"] * s["y"] / n, s["yy"] - s["y"] * s["y"] / n
    return F.greatest(F.lit(0.0), syy - F.when(sxx > 1e-14 * F.greatest(s["xx"], F.lit(1e-300)), sxy * sxy / sxx).otherwise(0.0))


def chow_scan(rows: DataFrame, by: str = "code", order: str = "date") -> DataFrame:
    """rows (by, order, x, y) with at, n and f: the Chow statistic of a break before the row, of y on 1 and x.

    Sums up to a row and totals give both halves' regressions, so one window pass tests every date. x and y are
    centred first, which changes no residual and keeps the sums small. Rows with a null are left out; f is null
    where a half has fewer than 3 rows, and 0 where both halves fit exactly."""
    whole, k = Window.partitionBy(by), 2
    r = numbered(rows.where("x IS NOT NULL AND y IS NOT NULL"), by, order)
    r = r.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in "xy"})
    term = {name: F.col(cs[0]) if len(cs) == 1 else F.col(cs[0]) * F.col(cs[1]) for name, cs in _SUMS.items()}
    before = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({f"b_{c}": F.sum(t).over(before) for c, t in term.items()} | {f"t_{c}": F.sum(t).over(whole) for c, t in term.items()})
    first, total = ({c: F.col(f"{s}_{c}") for c in _SUMS} for s in "bt")
    second = {c: total[c] - first[c] for c in _SUMS}
    apart, one = _rest(F.col("at"), first) + _rest(F.col("n") - F.col("at"), second), _rest(F.col("n"), total)
    f = F.when(apart <= 1e-12, 0.0).otherwise(F.greatest(F.lit(0.0), (one - apart) / k / (apart / (F.col("n") - 2 * k))))
    whole_halves = (F.col("at") > k) & (F.col("at") < F.col("n") - k) & (F.col("n") >= 2 * k + 4)
    return r.select(by, order, "at", "n", F.when(whole_halves, f).alias("f"))


def f_tail(f: Column, freedom: Column) -> Column:
    """P(F > f) of the F distribution with 2 and `freedom` degrees."""
    return F.pow(1 + 2 * f / freedom, -freedom / 2)


def largest_break(scan: DataFrame, by: str = "code", order: str = "date", trim: float = 0.15, critical: float = 15.0) -> DataFrame:
    """(by, n, sup_f, p, break_at, broken): the largest statistic within the trimmed range, the first of equals."""
    k = 2
    first, last = F.greatest(F.lit(k + 2), F.floor(trim * F.col("n"))), F.least(F.col("n") - k - 2, F.ceil((1 - trim) * F.col("n")))
    inside = scan.where((F.col("at") >= first) & (F.col("at") < last) & F.col("f").isNotNull())
    best = inside.groupBy(by).agg(F.first("n").alias("n"), F.max(F.struct("f", -F.col("at"), order)).alias("x"))
    return best.select(by, "n", F.col("x.f").alias("sup_f"), f_tail(F.col("x.f"), F.col("n") - 2 * k).alias("p"), F.col(f"x.{order}").alias("break_at"), (F.col("x.f") > critical).alias("broken"))

