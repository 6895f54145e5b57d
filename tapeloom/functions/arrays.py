"""Trailing windows as numpy arrays over the rows of many codes, and the factors by them.

Spark reads a frame that moves anew for each row, for each of its functions: with frames of 20 to 120 rows that is
most of a query's time. Here batches of rows, sorted by code and date, are arrays in which unknown places keep codes
apart. Values are kept with whether they are known, so that a null isn't taken for a number that isn't one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.factors import YEAR
from tapeloom.functions.windows import by_code as window


NUMBERS = ("open", "high", "low", "close", "volume", "amount")
#: Rows that are arrays together, at least.
CHUNK = 20_000


@dataclass(frozen=True, eq=False)
class Series:
    """Values, and which are known. A quotient by zero is unknown."""

    v: np.ndarray
    known: np.ndarray

    def _with(self, f: Callable, other: Series | float) -> Series:
        return Series(f(self.v, other.v), self.known & other.known) if isinstance(other, Series) else Series(f(self.v, other), self.known)

    def __add__(self, other):
        return self._with(np.add, other)

    __radd__ = __add__

    def __sub__(self, other):
        return self._with(np.subtract, other)

    def __rsub__(self, other):
        return self._with(lambda a, b: b - a, other)

    def __mul__(self, other):
        return self._with(np.multiply, other)

    def __truediv__(self, other: Series):
        return Series(self.v / other.v, self.known & other.known & (other.v != 0))

    def __rtruediv__(self, other: float):
        return Series(other / self.v, self.known & (self.v != 0))

    def __neg__(self):
        return Series(-self.v, self.known)

    def map(self, f: Callable) -> Series:
        return Series(f(self.v), self.known)

    def filled(self, x: float, there: np.ndarray) -> Series:
        return Series(np.where(self.known, self.v, x), there)

    def where(self, test: np.ndarray) -> Series:
        return Series(self.v, self.known & test)


def _greatest(*xs: Series) -> Series:
    """The largest of what is known."""
    return Series(np.max([np.where(x.known, x.v, -np.inf) for x in xs], axis=0), np.any([x.known for x in xs], axis=0))


class Rows:
    """Rows of codes one after the other, in the order of their dates, `reach` unknown places before each code: columns
    as attributes, and series of what the last n rows give, unknown below `least` (default n) known ones."""

    def __init__(self, t: pa.Table, starts: np.ndarray, reach: int) -> None:
        self._kept: dict = {}
        self.reach, self.at = reach, np.arange(len(starts)) + reach * np.cumsum(starts)
        size = len(starts) + reach * int(starts.sum())
        self.there = self._placed(np.ones(len(starts), bool), size)
        for c in NUMBERS:
            setattr(self, c, Series(self._placed(pc.fill_null(t[c], 0.0).to_numpy(), size), self._placed(pc.is_valid(t[c]).to_numpy(), size)))

    def _placed(self, x: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size, x.dtype)
        out[self.at] = x
        return out

    def array(self, x: Series) -> pa.Array:
        return pa.array(x.v[self.at], pa.float64(), mask=~x.known[self.at])

    def _within(self, n: int) -> None:
        if n > self.reach:
            raise ValueError(f"{n} rows back, but codes are {self.reach} places apart")

    def __getattr__(self, name: str) -> Series:
        """Columns that follow from others, made once."""
        if name not in _DERIVED:
            raise AttributeError(name)
        setattr(self, name, _DERIVED[name](self))
        return self.__dict__[name]

    def _once(self, key: tuple, make: Callable):
        if key not in self._kept:
            self._kept[key] = make()
        return self._kept[key]

    def _frames(self, x: Series, n: int, fill: float) -> np.ndarray:
        """A row of n values for each row, `fill` where there is none or it isn't known."""
        self._within(n)
        make = lambda: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, fill), np.where(x.known, x.v, fill)]), n)
        return self._once(("frames", x, n, fill), make)

    def count(self, x: Series, n: int) -> np.ndarray:
        return self._once(("count", x, n), lambda: _counted(x.known, n))

    def enough(self, x: Series, n: int, least: int | None) -> np.ndarray:
        return self.count(x, n) >= (n if least is None else least)

    def lag(self, x: Series, n: int = 1) -> Series:
        self._within(n)
        k = min(n, len(x.v))
        return Series(np.concatenate([np.zeros(k), x.v[: len(x.v) - k]]), np.concatenate([np.zeros(k, bool), x.known[: len(x.v) - k]]))

    def change(self, x: Series, n: int) -> Series:
        return x / self.lag(x, n) - 1

    def total(self, x: Series, n: int) -> np.ndarray:
        return self._once(("total", x, n), lambda: self._frames(x, n, 0.0).sum(axis=1))

    def mean(self, x: Series, n: int, least: int | None = None) -> Series:
        return Series(self.total(x, n) / np.maximum(self.count(x, n), 1), self.enough(x, n, least))

    def max(self, x: Series, n: int, least: int | None = None) -> Series:
        return Series(self._once(("max", x, n), lambda: self._frames(x, n, -np.inf).max(axis=1)), self.enough(x, n, least))

    def min(self, x: Series, n: int, least: int | None = None) -> Series:
        return Series(self._once(("min", x, n), lambda: self._frames(x, n, np.inf).min(axis=1)), self.enough(x, n, least))

    def _apart(self, x: Series, n: int) -> np.ndarray:
        """The frames' values less their mean, 0 where not known; exactly 0 where all are equal."""

        def make() -> np.ndarray:
            top, bottom = self.max(x, n).v, self.min(x, n).v
            mean = np.where(top == bottom, top, self.mean(x, n).v)
            known = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(n - 1, bool), x.known]), n)
            return np.where(known, self._frames(x, n, 0.0) - mean[:, None], 0.0)

        return self._once(("apart", x, n), make)

    def _moment(self, x: Series, n: int, k: int) -> np.ndarray:
        return self._once(("moment", x, n, k), lambda: ((a := self._apart(x, n)) * a * (1 if k == 2 else a if k == 3 else a * a)).sum(axis=1))

    def std(self, x: Series, n: int, least: int | None = None) -> Series:
        c = self.count(x, n)
        return Series(np.sqrt(self._moment(x, n, 2) / np.maximum(c - 1, 1)), self.enough(x, n, least) & (c > 1))

    def skew(self, x: Series, n: int, least: int) -> Series:
        """Bias-corrected skewness (G1)."""
        c, m2 = self.count(x, n).astype(float), self._moment(x, n, 2)
        return Series(np.sqrt(c) * self._moment(x, n, 3) / np.sqrt(m2 * m2 * m2) * (np.sqrt(c * (c - 1)) / (c - 2)), self.enough(x, n, least) & (m2 != 0))

    def kurtosis(self, x: Series, n: int, least: int) -> Series:
        """Sample excess kurtosis (G2)."""
        c, m2 = self.count(x, n).astype(float), self._moment(x, n, 2)
        plain = c * self._moment(x, n, 4) / (m2 * m2) - 3
        return Series((c - 1) / ((c - 2) * (c - 3)) * ((c + 1) * plain + 6), self.enough(x, n, least) & (m2 != 0))

    def rank_of_last(self, x: Series, n: int = 20) -> Series:
        """Average-tie rank of the last value among the last n, over n."""

        def make() -> Series:
            f = self._frames(x, n, 0.0)
            less, equal = (f < x.v[:, None]).sum(axis=1), (f == x.v[:, None]).sum(axis=1)
            return Series((less + (equal + 1) / 2) / n, self.enough(x, n, None))

        return self._once(("rank", x, n), make)

    def tail_mean(self, x: Series, n: int, share: float, least: int) -> Series:
        """Mean of the ceil(share * count) smallest of the last n."""
        most = max(int(np.ceil(n * share)), 1)
        smallest = np.sort(np.partition(self._frames(x, n, np.inf), most - 1, axis=1)[:, :most], axis=1)
        k = np.maximum(np.ceil(self.count(x, n) * share), 1).astype(int)
        return Series(np.where(np.arange(most) < k[:, None], smallest, 0.0).sum(axis=1) / k, self.enough(x, n, least))

    def worst_fall(self, x: Series, n: int) -> Series:
        """Largest fall from the running peak within the last n rows."""
        f = self._frames(x, n, 1.0)
        falls = (f / np.maximum.accumulate(f, axis=1) - 1).min(axis=1)
        return Series(np.minimum(falls, 0.0), self.enough(x, n, None) & (f.min(axis=1) > 0))


def _counted(known: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(n, np.int64), np.cumsum(known)])
    return total[n:] - total[: len(known)]


_DERIVED: dict[str, Callable[[Rows], Series]] = {
    "prev": lambda g: g.lag(g.close),
    "ret": lambda g: g.close / g.prev - 1,
    "delta": lambda g: g.close - g.prev,
    "tr": lambda g: _greatest(g.high - g.low, (g.high - g.prev).map(np.abs), (g.low - g.prev).map(np.abs)).where(g.prev.known),
    "gain": lambda g: g.delta.map(lambda v: np.maximum(v, 0.0)).filled(0.0, g.there),
    "loss": lambda g: g.delta.map(lambda v: np.maximum(-v, 0.0)).filled(0.0, g.there),
    "fall_squared": lambda g: g.ret.filled(0.0, g.there).map(lambda v: np.minimum(v, 0.0) ** 2),
    "illiquid": lambda g: g.ret.map(np.abs) / g.amount,
    "amivest": lambda g: g.amount / g.ret.map(lambda v: np.maximum(np.abs(v), 1e-10)),
    "idle": lambda g: Series(((g.volume.v == 0) & g.volume.known).astype(float), g.there),
    "spread": lambda g: (g.max(g.high, 20, 10) - g.min(g.low, 20, 10)) / g.close,
}

#: The factors of factors.FACTORS, by the same names.
FACTORS: dict[str, Callable[[Rows], Series]] = {
    "f01_momentum_20d": lambda g: g.change(g.close, 20),
    "f02_momentum_60d": lambda g: g.change(g.close, 60),
    "f03_volatility_20d": lambda g: g.std(g.ret, 20) * YEAR,
    "f04_volatility_60d": lambda g: g.std(g.ret, 60) * YEAR,
    "f05_ma_ratio_5_20": lambda g: g.mean(g.close, 5) / g.mean(g.close, 20) - 1,
    "f06_ma_ratio_10_60": lambda g: g.mean(g.close, 10) / g.mean(g.close, 60) - 1,
    "f07_volume_ratio_5_20": lambda g: g.mean(g.volume, 5) / g.mean(g.volume, 20) - 1,
    "f08_rsi_14": lambda g: 100 - 100 / (1 + g.mean(g.gain, 14) / g.mean(g.loss, 14)),
    "f09_price_position_20d": lambda g: (g.close - g.min(g.low, 20)) / (g.max(g.high, 20) - g.min(g.low, 20)),
    "f10_illiq_20d": lambda g: g.mean(g.illiquid, 20, 10) * 1e9,
    "f11_close_rank_20d": lambda g: g.rank_of_last(g.close),
    "f12_pv_divergence_20d": lambda g: g.rank_of_last(g.volume) - g.rank_of_last(g.close),
    "f13_cs_momentum_20d": lambda g: (1 + g.change(g.close, 20)) / (1 + g.change(g.close, 5)) - 1,
    "f15_max_ret_20d": lambda g: g.max(g.ret, 20, 10),
    "f16_reversal_1d": lambda g: -g.change(g.close, 1),
    "f17_amivest_20d": lambda g: g.mean(g.amivest, 20, 10),
    "f18_range_20d": lambda g: g.spread,
    "f19_skew_20d": lambda g: g.skew(g.ret, 20, 10),
    "f20_reversal_5d": lambda g: -g.change(g.close, 5),
    "f21_reversal_20d": lambda g: -g.change(g.close, 20),
    "f22_neg_range_20d": lambda g: -g.spread,
    "f25_cvar_95_60d": lambda g: g.tail_mean(g.ret, 60, 0.05, 40),
    "f26_max_drawdown_20d": lambda g: g.worst_fall(g.close, 20),
    "f27_downside_semivol_20d": lambda g: g.mean(g.fall_squared, 20, 15).map(np.sqrt) * YEAR,
    "f28_kurtosis_20d": lambda g: g.kurtosis(g.ret, 20, 15),
    "w01_ma_20": lambda g: g.mean(g.close, 20, 10),
    "w03_atr_14": lambda g: g.mean(g.tr, 14, 7),
    "w04_bollinger_upper": lambda g: g.mean(g.close, 20, 10) + g.std(g.close, 20, 10) * 2,
    "w04_bollinger_lower": lambda g: g.mean(g.close, 20, 10) - g.std(g.close, 20, 10) * 2,
    "w08_turnover_z": lambda g: ((g.volume - g.mean(g.volume, 20, 10)) / g.std(g.volume, 20, 10)).filled(0.0, g.there),
    "w12_atr_20": lambda g: g.mean(g.tr, 20, 1),
    "p29_suspended": lambda g: Series((g.total(g.idle, 5) >= 3).astype(float), g.idle.known),
}


def by_code(bars: DataFrame, columns: dict[str, Callable[[Rows], Series]], keep: tuple[str, ...] = (), reach: int = 60) -> DataFrame:
    """(code, date, keep..., columns...): what `columns` make of each code's last `reach` rows or fewer."""
    names = ["code", "date", *keep]
    rows = bars.select(*names, *(c for c in NUMBERS if c not in keep))
    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(name, T.DoubleType()) for name in columns)])

    def made(t: pa.Table, starts: np.ndarray) -> pa.Table:
        g = Rows(t, starts, reach)
        with np.errstate(all="ignore"):
            found = [g.array(column(g)) for column in columns.values()]
        return pa.table([*(t[c] for c in names), *found], names=[*names, *columns])

    return whole_codes(rows, made, schema)


def whole_codes(rows: DataFrame, made: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str) -> DataFrame:
    """What `made` gives for rows of whole codes, sorted by code and date, and where codes start among them.

    Rows get their place in their code by a window, which deals and sorts them (the written bars without an exchange);
    a batch ends with a whole code, so a code's history, bounded by its trading days, is in memory."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK:
                t = pa.Table.from_batches(held)
                starts = t["place_"].to_numpy() == 1
                last = int(np.flatnonzero(starts)[-1])  # the last code may go on
                if last:
                    yield from made(t.slice(0, last), starts[:last]).combine_chunks().to_batches()
                    held = t.slice(last).to_batches()
        t = pa.Table.from_batches(held) if held else None
        if t is not None and t.num_rows:
            yield from made(t, t["place_"].to_numpy() == 1).combine_chunks().to_batches()

    return rows.withColumn("place_", F.row_number().over(window())).mapInArrow(f, schema)
