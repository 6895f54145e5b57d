"""Log-periodic power law fits of the bars; tests hold the fits against planted parameters and a fine grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import bubbles as lp
from tapeloom.plans.catalog import query
from tapeloom.sources import market as m

LENGTHS = [60, 120, 180]


@query("e16_power_law_fit", None)
def power_law_fit(spark, d, length: int = 120):
    """The fit of each code's last `length` closes, and how near its critical time is."""
    fits = lp.fitted(lp.windows(m.bars(spark, d), [length], last=1))
    return fits.select("code", "date", "length", *(F.round(c, 6).alias(c) for c in ("tc", "m", "w", "a", "b", "c", "phi", "rmse", "r2", "days")), lp.phase(F.col("days"), F.col("r2")).alias("phase"))


@query("e19_best_windows", None)
def best_windows(spark, d, step: int = 20, last: int = 5):
    """Of each code's windows that end at one of some late bars, the one with the least error."""
    fits = lp.fitted(lp.windows(m.bars(spark, d), LENGTHS, step, last))
    best = fits.groupBy("code", "date").agg(F.min_by(F.struct("length", "tc", "m", "w", "rmse", "r2", "days"), F.struct("rmse", "length")).alias("x"))
    return best.select("code", "date", "x.length", *(F.round(f"x.{c}", 6).alias(c) for c in ("tc", "m", "w", "rmse", "r2", "days")))


@query("e20_window_consensus", None)
def window_consensus(spark, d, step: int = 20, last: int = 5):
    """Where a third of the windows or more have a fit inside the bounds that explains a twentieth or more; the trade prices are mostly noise."""
    return lp.consensus(lp.fitted(lp.windows(m.bars(spark, d), LENGTHS, step, last)), len(LENGTHS), 0.05, 0.33)
