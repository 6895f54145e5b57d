"""Log-periodic power laws, log p = A + (tc - t)^m (B + C1 cos(w log(tc - t)) + C2 sin(w log(tc - t))), fitted by windows.

Given the critical time tc, the exponent m and the frequency w, the rest is linear: its residual is what
the search sees. The designs of a grid over (tc, m, w) depend on a window's length only, so a batch of
windows of one length meets all of them in one product; the best points of the grid and its best peaks
are refined side by side by damped Newton steps on that residual (variable projection). No random
numbers, so a window has one answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of m and w, and of the days from a window's end to tc.
M, W, AHEAD = (0.1, 0.9), (6.0, 13.0), (1.0, 100.0)
#: Points of the grid in tc, m and w, best points and best peaks that are refined, and steps at most.
GRID, STARTS, PEAKS, STEPS = (24, 9, 22), 4, 8, 60
#: A start goes on while what it lacks to the best of its series is at most so many times its gain of the last five steps
#: and, where the valley curves upwards, what the next step would gain.
LAG = 25
#: Windows that are searched side by side; of these, how many meet the grid at once, and how many times of points are worked on at once, to stay in the cache.
TOGETHER, AT_ONCE, CELLS = 256, 64, 12288
FIT = "tc double, m double, w double, a double, b double, c double, phi double, rmse double, r2 double, days double"


def design(n: int, p: np.ndarray) -> np.ndarray:
    """(points, n, 4): columns 1, f, f cos, f sin of times 0 .. n - 1 for points (tc, m, w)."""
    tau = np.maximum(p[:, :1] - np.arange(n), 1e-8)
    log = np.log(tau)
    f = np.exp(p[:, 1:2] * log)
    return np.stack([np.ones_like(f), f, f * np.cos(p[:, 2:3] * log), f * np.sin(p[:, 2:3] * log)], axis=2)


def _bounds(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array([n - 1 + AHEAD[0], M[0], W[0]]), np.array([n - 1 + AHEAD[1], M[1], W[1]])


@lru_cache(maxsize=4)
def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid's points, and an orthonormal basis of each design but its constant, as (n, 3 * points): a column of all points after the other."""
    low, high = _bounds(n)
    days = np.geomspace(AHEAD[0], AHEAD[1], GRID[0]) + n - 1  # finer near the end
    p = np.stack(np.meshgrid(days, *(np.linspace(low[i], high[i], GRID[i]) for i in (1, 2)), indexing="ij"), axis=-1).reshape(-1, 3)
    return p, np.ascontiguousarray(np.linalg.qr(design(n, p))[0][:, :, 1:].transpose(1, 2, 0).reshape(n, -1))


def residual(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of squares that points p (.., 3) leave of series y (.., n); the leading axes agree."""
    q = np.linalg.qr(design(y.shape[-1], p.reshape(-1, 3)))[0].reshape(*p.shape[:-1], y.shape[-1], 4)
    rest = y - np.einsum("...nk,...k->...n", q, np.einsum("...nk,...n->...k", q, y))
    return (rest**2).sum(axis=-1)


def _starts(taken: np.ndarray) -> np.ndarray:
    """By series the grid's best points, then its best peaks (points that none beside them on an axis exceeds)."""
    best = np.argpartition(-taken, STARTS, axis=1)[:, :STARTS]
    cube = taken.reshape(len(taken), *GRID)
    peak = np.ones(cube.shape, bool)
    for axis in (1, 2, 3):
        low, high = ([slice(None)] * 4 for _ in range(2))
        low[axis], high[axis] = slice(None, -1), slice(1, None)
        rises = cube[tuple(high)] > cube[tuple(low)]
        peak[tuple(low)] &= ~rises
        peak[tuple(high)] &= rises
    return np.concatenate((best, np.argpartition(-np.where(peak, cube, -1).reshape(taken.shape), PEAKS, axis=1)[:, :PEAKS]), axis=1)


@lru_cache(maxsize=4)
def _room(rows: int, n: int) -> np.ndarray:
    """Arrays that _projected fills again and again: fresh ones of this size cost more than what is computed in them."""
    return np.empty((18, rows, n))


def _projected(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of centred series y (k, n) at points p (k, 3), with the linear parameters projected out: the sums of squares left,
    and of their halves the slopes down (k, 3), the curvatures of a Gauss-Newton step and the whole ones (k, 3, 3)."""
    (k, n), dot, last = y.shape, lambda a, b: np.vecdot(a[:, None], b[None]), lambda a: np.moveaxis(a, 2, 0)
    b, sse, slope, inverse, xd, dd, t = (np.empty((*s, k)) for s in ((3,), (), (3,), (3, 3), (3, 3), (3, 3), (3, 5)))
    size = max(1, CELLS // n)
    for at in range(0, k, size):
        of = slice(at, at + size)
        room, tc, m, w = _room(size, n)[:, : len(p[of])], *(p[of, i : i + 1] for i in range(3))
        times, f, x, d, (level, turn, r, some) = room[:5], room[5:8], room[8:11], room[11:14], room[14:]
        log, inv = times[:2]
        np.subtract(tc, np.arange(n), out=inv)
        np.log(inv, out=log)
        np.divide(1, inv, out=inv)
        np.multiply(times[:2], log, out=times[2:4])
        np.multiply(inv, inv, out=times[4])
        np.exp(np.multiply(log, m, out=some), out=f[0])  # (tc - t)^m times 1, cos(w log), sin(w log)
        np.multiply(log, w, out=some)
        np.multiply(np.cos(some, out=f[1]), f[0], out=f[1])
        np.multiply(np.sin(some, out=f[2]), f[0], out=f[2])
        mean = f.mean(axis=2)
        np.subtract(f, mean[:, :, None], out=x)
        gram = dot(x, x)
        scale = 1 / np.sqrt(np.maximum(np.einsum("iik->ik", gram), 1e-300))
        inverse[..., of] = np.moveaxis(np.linalg.inv(last(gram * scale * scale[:, None]) + 1e-14 * np.eye(3)), 0, 2) * scale * scale[:, None]
        b[:, of] = np.einsum("ijk,jk->ik", inverse[..., of], np.vecdot(x, y[of]))
        b1, b2, b3 = b[:, of, None]
        np.multiply(x[0], b1, out=level)
        for i, c in ((1, b2), (2, b3)):
            np.add(level, np.multiply(x[i], c, out=some), out=level)
        np.subtract(y[of], level, out=r)
        np.add(level, (b[:, of] * mean).sum(axis=0)[:, None], out=level)
        np.subtract(np.multiply(f[1], b3, out=turn), np.multiply(f[2], b2, out=some), out=turn)
        np.add(np.multiply(level, m, out=d[0]), np.multiply(turn, w, out=some), out=d[0])
        np.multiply(d[0], inv, out=d[0])
        np.multiply(level, log, out=d[1])
        np.multiply(turn, log, out=d[2])
        sse[of], slope[:, of] = np.vecdot(r, r), np.vecdot(d, r)
        np.subtract(d, d.mean(axis=2, keepdims=True), out=d)
        xd[..., of], dd[..., of] = dot(x, d), dot(d, d)
        t[..., of] = dot(np.multiply(f, r, out=f), times)
    # what the second derivatives add
    m, w = p[:, 1], p[:, 2]
    ups, turns = (b[:, None] * t).sum(axis=0), b[2] * t[1] - b[1] * t[2]
    waves = ups - b[0] * t[0]
    mixed = np.array([[m * t[0, 1], t[0, 0], 0 * m], [m * t[1, 1] - w * t[2, 1], t[1, 0], -t[2, 0]], [m * t[2, 1] + w * t[1, 1], t[2, 0], t[1, 0]]])
    tt = m * (m - 1) * ups[4] + (2 * m - 1) * w * turns[4] - w * w * waves[4]
    tm, tw = ups[1] + m * ups[3] + w * turns[3], turns[1] + m * turns[3] - w * waves[3]
    second = np.array([[tt, tm, tw], [tm, ups[2], turns[2]], [tw, turns[2], -waves[2]]])
    inverse, half, whole = last(inverse), last(xd), last(xd - mixed)
    return sse, slope.T, last(dd) - half.transpose(0, 2, 1) @ inverse @ half, last(dd - second) - whole.transpose(0, 2, 1) @ inverse @ whole


def _rising(h: np.ndarray) -> np.ndarray:
    """Whether symmetric matrices (k, 3, 3) of unit scale are well above 0."""
    a = h[:, 0, 0]
    b = a * h[:, 1, 1] - h[:, 0, 1] ** 2
    c = h[:, 2, 2] * b - h[:, 0, 0] * h[:, 1, 2] ** 2 - h[:, 1, 1] * h[:, 0, 2] ** 2 + 2 * h[:, 0, 1] * h[:, 1, 2] * h[:, 0, 2]
    return (a > 1e-6) & (b > 1e-6) & (c > 1e-6)


def _refined(y: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, starts: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points p (`starts` a series, one after the other) after damped steps of those `open_` within the bounds, and
    the sums of squares they leave. A step is Newton's where the valley curves upwards and else one of Gauss and Newton;
    none makes a point worse. A start that gains too little to come near its series' best is left."""
    p, damp, eye = p.copy(), np.full(len(p), 1e-2), np.eye(3)
    now, slope, plain, whole = np.full(len(p), np.inf), np.zeros((len(p), 3)), np.zeros((len(p), 3, 3)), np.zeros((len(p), 3, 3))
    now[open_], slope[open_], plain[open_], whole[open_] = _projected(y[open_ // starts], p[open_])
    before = now.copy()
    for step in range(STEPS):
        best = now.reshape(-1, starts).min(axis=1)
        if step and step % 5 == 0:
            behind, gain = now[open_] - best[open_ // starts], before[open_] - now[open_]
            open_ = open_[(behind <= LAG * gain) | (behind == 0) | (gain == 0)]
            before = now.copy()
        q, g = p[open_], slope[open_]
        held = ((q <= low) & (g < 0)) | ((q >= high) & (g > 0))
        g = np.where(held, 0.0, g)
        size = np.einsum("kii->ki", plain[open_])
        scale = np.where(held, 0.0, 1 / np.sqrt(np.maximum(size, 1e-60)))
        fit_, newton = (h[open_] * scale[:, :, None] * scale[:, None, :] + eye * held[:, :, None] for h in (plain, whole))
        rising = _rising(newton)
        h = np.where(rising[:, None, None], newton, fit_) + eye * (damp[open_][:, None, None] + 1e-14)
        move = np.linalg.solve(h, (g * scale)[..., None])[..., 0] * scale
        hoped = np.einsum("ki,ki->k", g, move)
        near = ~rising | (now[open_] - best[open_ // starts] <= LAG * hoped) | (step == 0)
        open_, q, g, move = open_[near], q[near], g[near], move[near]
        new = np.clip(q + move, low, high)
        got, *rest = _projected(y[open_ // starts], new)
        better, moved = got < now[open_], np.abs(new - q) / (high - low)
        hoped = np.einsum("ki,ki->k", g, new - q)
        to = open_[better]
        p[to], now[to], slope[to], plain[to], whole[to] = new[better], got[better], *(x[better] for x in rest)
        damp[open_] = np.clip(damp[open_] * np.where(better, 0.1, 6.0), 1e-9, None)
        done = (moved.max(axis=1) < 1e-9) | (damp[open_] > 1e7) | (hoped <= 1e-13 * now[open_])
        open_ = open_[~done]
        if not open_.size:
            break
    return p, now


def fit(y: np.ndarray) -> np.ndarray:
    """(series, 10): of each row of log prices the columns of FIT."""
    count, n = y.shape
    points, basis = _grid(n)
    centred = y - y.mean(axis=1, keepdims=True)
    first = []
    for at in range(0, count, AT_ONCE):
        taken = centred[at : at + AT_ONCE] @ basis
        np.square(taken, out=taken)
        first.append(_starts(taken.reshape(len(taken), 3, -1).sum(axis=1)))
    first = np.sort(np.concatenate(first), axis=1)
    fresh = np.diff(first, axis=1, prepend=-1) > 0  # a peak among the best points starts once
    low, high = _bounds(n)
    p, now = _refined(centred, points[first].reshape(-1, 3), low, high, first.shape[1], np.flatnonzero(fresh))
    p, now = p.reshape(*first.shape, 3), now.reshape(first.shape)
    at = now.argmin(axis=1)
    p = p[np.arange(count), at]
    q, upper = np.linalg.qr(design(n, p))
    beta = np.linalg.solve(upper, q.transpose(0, 2, 1) @ y[:, :, None])[:, :, 0]
    sse, total = ((centred - (q @ (q.transpose(0, 2, 1) @ centred[:, :, None]))[:, :, 0]) ** 2).sum(axis=1), (centred**2).sum(axis=1)
    return np.column_stack([p, beta[:, 0], beta[:, 1], np.hypot(beta[:, 2], beta[:, 3]), np.arctan2(-beta[:, 3], beta[:, 2]), np.sqrt(sse / n), np.where(total > 0, 1 - sse / np.where(total > 0, total, 1), 0.0), p[:, 0] - (n - 1)])


def windows(bars: DataFrame, lengths: list[int], step: int = 1, last: int | None = None) -> DataFrame:
    """(code, date, at, length, prices): the closes of the `length` bars up to a bar, for every `step`-th bar counted
    from a code's last one (the `last` nearest ones). Only closes above 0 count, and only whole windows."""
    b = bars.where(F.col("close") > 0).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("rows")).withColumn("n", F.size("rows"))
    ends = F.floor((F.col("n") - 1) / step).cast("int")
    if last:
        kept = step * (last - 1) + max(lengths)  # older bars are in no window
        b, ends = b.withColumn("rows", F.slice("rows", F.greatest(F.lit(1), F.col("n") - kept + 1), F.lit(kept))), F.least(ends, F.lit(last - 1))
    b = b.select("code", "n", "rows", F.explode(F.sequence(F.lit(0), ends)).alias("back")).withColumn("at", F.col("n") - F.col("back") * step)
    b = b.select("*", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("length")).where("at >= length").withColumn("place", F.col("at") - F.col("n") + F.size("rows"))
    return b.select("code", F.element_at("rows", F.col("place"))["date"].alias("date"), "at", "length", F.slice(F.col("rows.close"), F.col("place") - F.col("length") + 1, F.col("length")).alias("prices"))


def fitted(rows: DataFrame) -> DataFrame:
    """rows (.., length, prices) with the columns of FIT in place of prices. Windows are dealt evenly over tasks."""
    rest = [c for c in rows.columns if c != "prices"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FIT.split(", ")]
        for b in batches:
            length = b.column("length").to_numpy()
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                for at in range(0, len(of), TOGETHER):
                    part = b.take(pa.array(of[at : at + TOGETHER]))
                    out = fit(np.log(part.column("prices").flatten().to_numpy().reshape(-1, n)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *(pa.array(x) for x in out.T)], [*rest, *names])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, F.xxhash64("code", "at", "length")).mapInArrow(f, f"{schema}, {FIT}")


def valid(least: float = 0.5):
    """A fit inside the bounds that explains enough."""
    return (F.col("r2") > least) & (F.col("m") > M[0]) & (F.col("m") < M[1]) & (F.col("w") > W[0]) & (F.col("w") < W[1])


def consensus(fits: DataFrame, windows_in_all: int, least: float = 0.5, share: float = 0.5) -> DataFrame:
    """By code and date: how many of the windows have a valid fit, where these agree, and which way they point."""
    up = (F.col("b") < 0) & (F.abs("c") > 0.01)
    g = fits.where(valid(least)).groupBy("code", "date").agg(
        F.count("*").alias("valid_windows"), F.median("days").alias("days"), F.stddev_pop("days").alias("days_spread"), F.avg("r2").alias("mean_r2"), F.avg(up.cast("double")).alias("positive"), F.median(F.when(~up, F.col("days"))).alias("rebound_days")
    )
    rate = F.col("valid_windows") / windows_in_all
    return g.withColumn("consensus", rate).where(rate >= share).withColumns({"strength": rate / (F.col("days_spread") + 1), "negative": 1 - F.col("positive")})


def phase(days, r2, danger: int = 5, warning: int = 12, watch: int = 25):
    return F.when(~valid(), "invalid").when(days < max(1, danger // 2), "critical").when(days < danger, "danger").when(days < watch, "watch").otherwise("safe")
