"""Ordered folds: a state carried along each key's rows; point-and-figure columns, strokes, peaks kept apart."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from statistics import median
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(Protocol):
    def add(self, *values) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


#: Rows of a batch that a fold hands on.
BATCH = 10_000


def ordered_fold(rows: DataFrame, key: str, order: list[str], columns: list[str], new: Callable[[object], Fold], schema: str) -> DataFrame:
    """Rows (key, ...) that `new(key)` gives for each key's `columns` in `order`; `schema` names the key first.

    Keys are dealt by one exchange and sorted inside their partition. A fold holds its own state only: batches pass
    through, and a key that is larger than a batch goes on with the next one. Keys that are null are one key."""
    kinds = [(f.name, f.dataType) for f in rows.sparkSession.createDataFrame([], schema).schema]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, fold = None, None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [() for _ in kinds]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [k for k, _ in kinds])

        types = arrow
        for b in batches:
            for k, *values in zip(*(b.column(c).to_pylist() for c in (key, *columns))):
                if fold is None or k != now:
                    if fold is not None:
                        out.extend((now, *x) for x in fold.end())
                    now, fold = k, new(k)
                out.extend((now, *x) for x in fold.add(*values))
                if len(out) >= BATCH:
                    yield flush()
        if fold is not None:
            out.extend((now, *x) for x in fold.end())
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(t) for _, t in kinds]
    wanted = list(dict.fromkeys((key, *order, *columns)))
    # by a hash of the key: an exchange by the key itself is left out over a bucketed table, and then the buckets aren't kept
    return rows.select(*wanted).repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInArrow(f, schema)


class Apart:
    """Keeps a place that is `gap` or more after the last one kept."""

    def __init__(self, gap: int) -> None:
        self.gap, self.last = gap, None

    def add(self, at: int, *rest) -> Iterable[tuple]:
        if self.last is None or at - self.last >= self.gap:
            self.last = at
            yield (at, *rest)

    def end(self) -> Iterable[tuple]:
        return ()


class PointFigure:
    """Columns of a point-and-figure chart: (number, up, levels of its boxes).

    A column goes on while prices move a box further, and turns when they come back by `reversal` boxes. It begins up
    if the first bar closes at its open or above. Rows are (step, open, high, low, close), step being the size of a box,
    of logarithms with log=True; levels are prices then, too. At most `most` boxes are drawn."""

    def __init__(self, reversal: int = 3, log: bool = False, most: int = 25_000) -> None:
        self.step, self.reversal, self.log, self.left = 0.0, reversal, log, most
        self.at = self.up = None
        self.number, self.levels = 0, []

    def _grid(self, price: float, up: bool) -> float:
        return (math.floor if up else math.ceil)(price / self.step) * self.step

    def _draw(self, to: float) -> None:
        side = 1 if self.up else -1
        while side * (to - self.at) > 0 and self.left > 0:
            self._box(self.at + side * self.step)

    def _box(self, level: float) -> None:
        self.at = level
        self.left -= 1
        self.levels.append(math.exp(level) if self.log else level)

    def add(self, step: float, opened: float, high: float, low: float, close: float) -> Iterable[tuple]:
        self.step = step
        high, low = (math.log(max(p, 1e-6)) for p in (high, low)) if self.log else (high, low)
        if self.at is None:
            self.up = close >= opened
            self._box(self._grid(high if self.up else low, not self.up))
            return
        if self.left <= 0:
            return
        side = 1 if self.up else -1
        on, back = (high, low) if self.up else (low, high)
        if side * (on - self.at) >= self.step:
            self._draw(self._grid(on, self.up))
        elif side * (self.at - back) >= self.reversal * self.step:
            to = self._grid(back, not self.up)
            if side * (self.at - to) >= self.step:
                yield self._column()
                self.up, self.number = not self.up, self.number + 1
                self._draw(to)

    def _column(self) -> tuple:
        done = (self.number, self.up, self.levels)
        self.levels = []
        return done

    def end(self) -> Iterable[tuple]:
        return [self._column()] if self.levels else []


class Congestion:
    """Of a code's columns (highs and lows in order): zone, target by count, and a phase hint.

    A zone is the longest run of columns each of which overlaps what the run spans so far, the first of equals; it
    takes three columns in ten boxes and five columns. Its bounds are medians. The target is the side on which the
    next column leaves the run's span, moved on by a box a column."""

    def __init__(self) -> None:
        self.step, self.boxes, self.highs, self.lows = 0.0, 0, [], []

    def add(self, step: float, high: float, low: float, boxes: int) -> Iterable[tuple]:
        self.step = step
        self.highs.append(high)
        self.lows.append(low)
        self.boxes += boxes
        return ()

    def _run(self) -> tuple[int, int, float, float]:
        best = (0, 0, 0.0, 0.0)
        n = len(self.highs)
        for start in range(n - 2):
            if best[1] - best[0] >= n - start:
                break  # no later run can be longer
            top, bottom, end = self.highs[start], self.lows[start], start + 1
            while end < n and self.highs[end] >= bottom and self.lows[end] <= top:
                top, bottom, end = max(top, self.highs[end]), min(bottom, self.lows[end]), end + 1
            if end - start > best[1] - best[0]:
                best = (start, end, top, bottom)
        return best

    def _hint(self) -> str:
        n, h, l = len(self.highs), self.highs, self.lows
        if n < 8:
            return "unknown"
        half, pairs = n // 2, n - 1
        rising, falling = sum(b > a for a, b in zip(l, l[1:])) / pairs, sum(b < a for a, b in zip(h, h[1:])) / pairs
        higher = sum(b > a for a, b in zip(h, h[1:]))
        late_rising = sum(l[i] > l[i - 1] for i in range(half, n)) / max(1, n - half - 1)
        width = [a - b for a, b in zip(h, l)]
        early, late = sum(width[:half]) / half or 1, sum(width[half:]) / (n - half)
        if rising > 0.5 and late / early < 0.85 and late_rising > 0.4:
            return "accumulation"
        if falling > 0.3 and late / early > 1.2 and 1 - higher / pairs > 0.5:
            return "distribution"
        return "unknown"

    def end(self) -> Iterable[tuple]:
        low = high = target = 0.0
        n = len(self.highs)
        if self.boxes >= 10 and n >= 5:
            start, end, top, bottom = self._run()
            if end - start >= 3:
                low, high = median(self.lows[start:end]), median(self.highs[start:end])
                up = self.highs[-1] > self.highs[0]
                if end < n and self.highs[end] > top:
                    up = True
                elif end < n and self.lows[end] < bottom:
                    up = False
                target = top + (end - start) * self.step if up else bottom - (end - start) * self.step
        return [(n, float(low), float(high), float(target), self._hint())]


class Strokes:
    """Strokes between turning points: (start, start_price, end, end_price, up), dates and prices.

    Bars of which one contains the other are merged first: in a rise to the higher of highs and lows, in a fall to
    the lower ones, dated by the bar that gave the extreme; equal bars are merged too. A merged bar higher than both
    neighbours is a top, lower than both a bottom. Tops and bottoms alternate at a distance of `gap` merged bars or
    more, with the top above the bottom; a further extreme of the same kind takes the last one's place. A stroke
    comes out once the next one begins, as until then its end may move; the last one comes at the end."""

    def __init__(self, gap: int = 4) -> None:
        self.gap, self.bars, self.at, self.rising = gap, [], 0, True
        self.points: list[tuple] = []  # (place, date, price, is_top): of the pending stroke, at most two

    def add(self, date, high: float, low: float) -> Iterable[tuple]:
        if self.bars:
            h, l, hd, ld = self.bars[-1]
            if high >= h and low <= l or high <= h and low >= l:
                pick = (lambda a, b: a[0] > b[0]) if self.rising else (lambda a, b: a[0] < b[0])
                top = (high, date) if pick((high,), (h,)) else (h, hd)
                bottom = (low, date) if pick((low,), (l,)) else (l, ld)
                self.bars[-1] = (top[0], bottom[0], top[1], bottom[1])
                return
            self.rising = high > h
        out = self._turn() if len(self.bars) == 3 else ()
        self.bars = [*self.bars[-2:], (high, low, date, date)]
        self.at += 1
        yield from out

    def _turn(self) -> list[tuple]:
        """The middle of three merged bars, now that the third can't change."""
        (h0, l0, *_), (h1, l1, hd, ld), (h2, l2, *_) = self.bars
        if h1 > h0 and h1 > h2:
            return self._point((self.at - 2, hd, h1, True))
        if l1 < l0 and l1 < l2:
            return self._point((self.at - 2, ld, l1, False))
        return []

    def _point(self, p: tuple) -> list[tuple]:
        if not self.points:
            self.points = [p]
            return []
        last = self.points[-1]
        if p[3] == last[3]:
            if p[2] > last[2] if p[3] else p[2] < last[2]:
                self.points[-1] = p
            return []
        if p[0] - last[0] < self.gap or (p[2] <= last[2] if p[3] else p[2] >= last[2]):
            return []
        done = self._stroke() if len(self.points) == 2 else []
        self.points = [last, p]
        return done

    def _stroke(self) -> list[tuple]:
        (_, d0, p0, _), (_, d1, p1, top) = self.points
        return [(d0, p0, d1, p1, top)]

    def end(self) -> Iterable[tuple]:
        out = self._turn() if len(self.bars) == 3 else []
        return chain(out, self._stroke() if len(self.points) == 2 else [])
