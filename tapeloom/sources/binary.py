"""Fixed-width binary bars as a PySpark Python data source ("fixedbars"), for reading and writing.

A file holds one symbol's records of 32 bytes in date order; its name begins with the symbol, up to the
first dot. Layout "daily": date as yyyymmdd, four prices, amount, volume, a spare word. Layout "minute":
packed date and minute of the day, four prices, amount, volume, a spare word.

Reading: files are taken together into splits of bounded bytes and files, and larger ones split at record
multiples. A pushed-down range of dates is looked up in each file's part of a split by its first and last
record and by halving, so records outside the range aren't read; a small part is read at once. A torn record
at a file's end is left out, as are records without a valid date.

Writing: rows come sorted by symbol and date inside a task, which puts its files into folders of bounded size,
each with a list of them. Folders of tasks that succeeded are listed in a manifest, others are not read; so
the driver handles a row a folder, however many symbols there are.
"""

from __future__ import annotations

import datetime as dt
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

MANIFEST, LIST = "_manifest.json", "_files.json"
WIDTH, SPLIT = 32, 1 << 25
#: Files of a split and of a written folder at most, and records of a batch.
FILES, BATCH = 1000, 1 << 16
#: Records up to which a part of a file is read at once.
AT_ONCE = 1 << 11
DAILY = np.dtype([("date", "<u4"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<i4"), ("spare", "<i4")])
MINUTE = np.dtype([("date", "<u2"), ("minute", "<u2"), ("open", "<u4"), ("high", "<u4"), ("low", "<u4"), ("close", "<u4"), ("amount", "<f4"), ("volume", "<u4"), ("spare", "<u4")])
PRICES = ("open", "high", "low", "close")
SCHEMAS = {
    "daily": "symbol string, date date, open double, high double, low double, close double, amount float, volume bigint, spare bigint",
    "minute": "symbol string, date date, minute int, open bigint, high bigint, low bigint, close bigint, amount float, volume bigint",
}
# By how much a daily price is multiplied, by the beginning of the symbol's number; else 100.
SCALES = {"11": 10000, "12": 10000, "15": 1000, "5": 1000, "9": 1000}


def number_of(symbol: str) -> str:
    return symbol[2:] if symbol.startswith(("sh", "sz")) else symbol


def scale_of(symbol: str) -> int:
    return next((s for head, s in SCALES.items() if number_of(symbol).startswith(head)), 100)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def packed(day: dt.date, layout: str) -> int:
    """A date as a record has it; both layouts keep the order of dates."""
    return day.year * 10000 + day.month * 100 + day.day if layout == "daily" else max(0, (day.year - 2004) * 2048 + day.month * 100 + day.day)


def days(stored: np.ndarray, layout: str) -> np.ndarray:
    """Stored dates as days; not-a-time where there is no such day."""
    stored = stored.astype(np.int64)
    year, rest = (stored // 10000, stored % 10000) if layout == "daily" else (stored // 2048 + 2004, stored % 2048)
    month, day = rest // 100, rest % 100
    ok = (year >= 1) & (year <= 9999) & (month >= 1) & (month <= 12) & (day >= 1)
    first = (np.where(ok, year, 1970) - 1970).astype("M8[Y]").astype("M8[M]") + np.where(ok, month - 1, 0)
    found = first.astype("M8[D]") + np.where(ok, day - 1, 0)
    return np.where(ok & (found.astype("M8[M]") == first), found, np.datetime64("NaT"))


@dataclass
class _Split(InputPartition):
    """Bytes from start to end of `files` (paths and sizes) one after the other, or of those that the list in `folder` names."""

    files: list
    start: int
    end: int
    folder: str = ""


class BarReader(DataSourceReader):
    def __init__(self, path: str, layout: str) -> None:
        self.path, self.layout = path, layout
        self.low, self.high = 0, (1 << 32) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of the date; every filter is tested again by Spark, as bounds are all that is kept here."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",) and isinstance(getattr(f, "value", None), dt.date):
                at = packed(f.value, self.layout)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, at)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, at)
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = filesystem(self.path)
        manifest = posixpath.join(path, MANIFEST)
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            groups = [([], size, posixpath.join(path, name)) for name, size in _loaded(fs, manifest)]
        else:
            found = [(i.path, i.size - i.size % WIDTH) for i in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
            groups = [(g, sum(n for _, n in g), "") for g in _grouped(found)]
        return [_Split(files, a, min(a + SPLIT, size), folder) for files, size, folder in groups for a in range(0, size, SPLIT)]

    def read(self, split: _Split | None) -> Iterator[pa.RecordBatch]:
        if split is None:  # no files
            return
        fs, _ = filesystem(self.path)
        files = [(posixpath.join(split.folder, name), size) for name, size in _loaded(fs, posixpath.join(split.folder, LIST))] if split.folder else split.files
        at, held, records = 0, [], 0
        for path, size in files:
            a, e = max(split.start - at, 0), min(split.end - at, size)
            at += size
            if a < e:
                for x in self.records(fs, path, a // WIDTH, e // WIDTH):
                    held.append((posixpath.basename(path).split(".")[0], x))
                    records += len(x)
                    if records >= BATCH:
                        yield self.batch(held)
                        held, records = [], 0
        if held:
            yield self.batch(held)

    def records(self, fs: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[np.ndarray]:
        """Those of a file's records from start to end whose dates can be in the range."""
        kind = DAILY if self.layout == "daily" else MINUTE
        with fs.open_input_file(path) as f:
            if end - start <= AT_ONCE:
                f.seek(start * WIDTH)
                x = np.frombuffer(f.read((end - start) * WIDTH), kind)
                a, e = np.searchsorted(x["date"], self.low), np.searchsorted(x["date"], self.high, "right")
                if a < e:
                    yield x[a:e]
                return
            start, end = self.range(f, start, end, kind)
            for at in range(start, end, BATCH):
                f.seek(at * WIDTH)
                yield np.frombuffer(f.read((min(end, at + BATCH) - at) * WIDTH), kind)

    def range(self, f, start: int, end: int, kind: np.dtype) -> tuple[int, int]:
        """The records from start to end whose dates can be in the range; dates don't fall."""

        def date(i: int) -> int:
            f.seek(i * WIDTH)
            return int(np.frombuffer(f.read(WIDTH), kind)["date"][0])

        def first(test) -> int:
            a, b = start, end
            while a < b:
                mid = (a + b) // 2
                a, b = (a, mid) if test(date(mid)) else (mid + 1, b)
            return a

        if start >= end or date(start) > self.high or date(end - 1) < self.low:
            return start, start
        return (start if date(start) >= self.low else first(lambda x: x >= self.low)), (end if date(end - 1) <= self.high else first(lambda x: x > self.high))

    def batch(self, held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        names, x = pa.array([symbol for symbol, _ in held], pa.string()), np.concatenate([x for _, x in held])
        own = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
        day = days(x["date"], self.layout)
        keep = ~np.isnat(day)
        if self.layout == "minute":
            keep &= x["minute"] < 1440
        x, day, own = x[keep], day[keep], own[keep]
        columns = {"symbol": names.take(pa.array(own)), "date": pa.array(day.astype("M8[D]"), pa.date32())}
        if self.layout == "minute":
            columns["minute"] = pa.array(x["minute"].astype(np.int32))
        scale = np.array([scale_of(symbol) for symbol, _ in held])[own]
        columns |= {c: pa.array(x[c] / scale if self.layout == "daily" else x[c].astype(np.int64)) for c in PRICES}
        columns |= {"amount": pa.array(x["amount"].astype(np.float32)), "volume": pa.array(x["volume"].astype(np.int64))}
        if self.layout == "daily":
            columns["spare"] = pa.array(x["spare"].astype(np.int64))
        return pa.RecordBatch.from_pydict(columns)


def _loaded(fs: pafs.FileSystem, path: str) -> list:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _grouped(files: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    """Files in order, together up to FILES of them or to SPLIT bytes."""
    group, size = [], 0
    for f in files:
        group.append(f)
        size += f[1]
        if len(group) == FILES or size >= SPLIT:
            yield group
            group, size = [], 0
    if group:
        yield group


@dataclass
class _Written(WriterCommitMessage):
    folders: list


@dataclass
class _Folder:
    """A folder that a task fills: its files with their bytes."""

    fs: pafs.FileSystem
    root: str
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    files: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.fs.create_dir(posixpath.join(self.root, self.name), recursive=True)

    def open(self, name: str) -> pa.NativeFile:
        self.files.append([name, 0])
        return self.fs.open_output_stream(posixpath.join(self.root, self.name, name))

    def size(self) -> int:
        return sum(n for _, n in self.files)

    def full(self) -> bool:
        return len(self.files) == FILES or self.size() >= SPLIT

    def close(self) -> list:
        with self.fs.open_output_stream(posixpath.join(self.root, self.name, LIST)) as f:
            f.write(json.dumps(self.files).encode())
        return [self.name, self.size()]


class BarWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: str) -> None:
        self.path, self.layout = path, layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = filesystem(self.path)
        done, folder, out, now = [], None, None, None
        for b in iterator:
            runs = pc.run_end_encode(b.column("symbol"))
            symbols, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            data = self.records(b, np.repeat([scale_of(s) for s in symbols], np.diff(ends, prepend=0)))
            for symbol, a, e in zip(symbols, [0, *ends[:-1]], ends):
                if symbol != now:
                    if out is not None:
                        out.close()
                    if folder is not None and folder.full():
                        done.append(folder.close())
                        folder = None
                    folder, now = folder or _Folder(fs, path), symbol
                    out = folder.open(f"{now}.{len(folder.files)}.{'day' if self.layout == 'daily' else 'lc5'}")
                out.write(data[a:e].tobytes())
                folder.files[-1][1] += int(e - a) * WIDTH
        if out is not None:
            out.close()
            done.append(folder.close())
        return _Written(done)

    def records(self, b: pa.RecordBatch, scale: np.ndarray) -> np.ndarray:
        x = np.zeros(b.num_rows, DAILY if self.layout == "daily" else MINUTE)
        day = b.column("date").cast(pa.int32()).to_numpy().astype("M8[D]")
        month = day.astype("M8[M]")
        y, m, d = month.astype("M8[Y]").astype(int) + 1970, month.astype(int) % 12 + 1, (day - month).astype(int) + 1
        x["date"] = y * 10000 + m * 100 + d if self.layout == "daily" else (y - 2004) * 2048 + m * 100 + d
        for c in PRICES:
            x[c] = np.floor(b.column(c).to_numpy(zero_copy_only=False) * (scale if self.layout == "daily" else 1) + 0.5)
        x["amount"], x["volume"] = (b.column(c).to_numpy(zero_copy_only=False) for c in ("amount", "volume"))
        if self.layout == "minute":
            x["minute"] = b.column("minute").to_numpy(zero_copy_only=False)
        return x

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(posixpath.join(path, MANIFEST)) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.folders)).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            for name, _ in m.folders if m else ():
                fs.delete_dir(posixpath.join(path, name))


class FixedBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedbars"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("layout", "daily")]

    def reader(self, schema) -> BarReader:
        return BarReader(self.options["path"], self.options.get("layout", "daily"))

    def writer(self, schema, overwrite: bool) -> BarWriter:
        return BarWriter(self.options["path"], self.options.get("layout", "daily"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedBars)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_bars(df: DataFrame, path: str, layout: str = "daily") -> None:
    """Rows of SCHEMAS[layout] as files, one a symbol: symbols are dealt by an exchange and sorted by time."""
    register(df.sparkSession)
    time = ["date"] if layout == "daily" else ["date", "minute"]
    columns = [c.split()[0] for c in SCHEMAS[layout].split(", ")]
    kept = df.where(F.col("symbol").isNotNull() & F.col("date").isNotNull()).select(*columns)
    kept.repartition("symbol").sortWithinPartitions("symbol", *time).write.format("fixedbars").option("layout", layout).mode("append").save(path)


def read_bars(spark: SparkSession, path: str, layout: str = "daily") -> DataFrame:
    register(spark)
    return spark.read.format("fixedbars").option("layout", layout).load(path)
