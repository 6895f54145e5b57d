"""Written tables: partitioned by a coarse column, bucketed by a key, with upsert, retention and atomic replacement.

A table lies in the folder that driver and executors share. Its partition column prunes files by time,
its buckets spare the exchange of windows, joins and aggregates by the bucket column, and the sort
inside a bucket makes Parquet's row-group statistics selective for that column.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of Parquet input a bucket, at most: some half a million rows of the trade table.
BUCKET_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as files in the shared folder: what is read more than once is made once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> str:
    """What tells a file or folder from its next version: paths, lengths and times of its files."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ""
    found, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(found))


def read_part(path: str, part: str, columns: tuple[str, ...], value: int | str) -> pa.Table:
    """In a task: the rows of one partition of what Spark wrote at `path`, whose values need no escapes."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    fs, root = pafs.FileSystem.from_uri(uri)
    found = []
    for x in fs.get_file_info(pafs.FileSelector(f"{root}/{part}={value}")):
        if x.base_name.endswith(".parquet"):
            with fs.open_input_file(x.path) as f:
                found.append(pq.ParquetFile(f).read(list(columns)))
    return pa.concat_tables(found)


def replace_atomically(df: DataFrame, path: str) -> None:
    """df in place of what lies at `path`: a reader sees the old files or the new ones. df may read the old ones."""
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{kind}-{uuid.uuid4().hex}") for kind in ("new", "old"))
    df.write.parquet(new.toString())
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"cannot replace {path}")
    fs.delete(old, True)


@dataclass(frozen=True)
class Table:
    """A written table: its name in the session's catalog, its key, partition column and bucket column."""

    name: str
    key: tuple[str, ...]
    part: str
    bucket: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def exists(self, spark: SparkSession) -> bool:
        return spark.catalog.tableExists(self.name)

    def whole(self, spark: SparkSession) -> bool:
        """Whether the table is there and its writer's mark still lies in its folder, which somebody else may have cleared."""
        if not self.exists(spark):
            return False
        fs, p = _fs(spark, f"{self.location(spark)}/_SUCCESS")
        return fs.exists(p)

    def create(self, df: DataFrame, buckets: int | None = None, dealt: bool = False) -> DataFrame:
        """Writes df: one exchange by the bucket column (none where df is `dealt` by it already), then a file a partition and bucket.

        The writer sorts a task's rows by partition, bucket and key itself."""
        spark = df.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df if dealt else df.repartition(buckets, self.bucket)
        writer = rows.write.partitionBy(self.part).bucketBy(buckets, self.bucket).sortBy(self.bucket, *(k for k in self.key if k != self.bucket))
        writer.option("path", fresh_path(spark, self.name)).mode("overwrite").saveAsTable(self.name)
        return self.read(spark)

    def location(self, spark: SparkSession) -> str:
        return next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r.col_name == "Location")

    def _put(self, spark: SparkSession, rows: DataFrame, touched: list) -> None:
        """`rows` are all that the partitions `touched` hold from now on; other partitions keep their files.

        They are written aside first, so that a failure before the move of finished files changes nothing."""
        staged = fresh_path(spark, f"{self.name}-staged")
        rows.select(*self.read(spark).columns).write.parquet(staged)
        new = spark.read.schema(self.read(spark).schema).parquet(staged)
        before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {self.name}").collect() if r.col_name == "Num Buckets"))
            new.repartition(buckets, self.bucket).write.insertInto(self.name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        left = {r[0] for r in new.select(self.part).distinct().collect()}  # a value a partition
        self._drop(spark, [v for v in touched if v not in left])

    def _drop(self, spark: SparkSession, values: list) -> None:
        for v in values:
            fs, p = _fs(spark, f"{self.location(spark)}/{self.part}={v}")
            fs.delete(p, True)
        spark.catalog.refreshTable(self.name)

    def merge(self, batch: DataFrame, order: Column | None = None) -> list:
        """Upsert by key: of equal keys the batch's row counts, and in the batch the last by `order`.

        Only partitions that hold a key of the batch, or get one, are read and written again. Returns their
        values. Merging a batch twice is merging it once."""
        spark = batch.sparkSession
        old = self.read(spark)
        ranked = batch.select(*old.columns, (F.lit(1) if order is None else order).alias("seq_"))
        w = Window.partitionBy(*self.key)
        last = ranked.withColumn("place_", F.row_number().over(w.orderBy(F.desc("seq_")))).where("place_ = 1").drop("place_", "seq_")
        held = old.join(batch.select(*self.key).distinct(), list(self.key), "left_semi").select(self.part)
        touched = [r[0] for r in batch.select(self.part).union(held).distinct().collect()]  # a value a partition
        if not touched:
            return []
        both = old.where(F.col(self.part).isin(touched)).withColumn("new_", F.lit(0)).unionByName(last.withColumn("new_", F.lit(1)))
        merged = both.withColumn("place_", F.row_number().over(w.orderBy(F.desc("new_")))).where("place_ = 1")
        self._put(spark, merged.drop("place_", "new_"), touched)
        return sorted(touched)

    def delete_before(self, spark: SparkSession, column: str, cutoff: Column, part_of: Callable[[Column], Column]) -> list:
        """Drops rows whose `column` is before `cutoff`. part_of gives the partition value of a time and grows with it:
        earlier partitions go as folders, the one that holds the cutoff is written again. Returns the dropped ones."""
        edge = spark.range(1).select(part_of(cutoff)).first()[0]
        old = self.read(spark)
        gone = [r[0] for r in old.select(self.part).distinct().collect() if r[0] is not None and r[0] < edge]
        kept = old.where((F.col(self.part) == edge) & (F.col(column) >= cutoff))
        if old.where((F.col(self.part) == edge) & (F.col(column) < cutoff)).limit(1).count():
            self._put(spark, kept, [edge])
        self._drop(spark, gone)
        return sorted(gone)


def buckets_of(spark: SparkSession, paths: list[str]) -> int:
    """As many buckets as keep a task's share of the input files bounded, so that its sorts and windows stay in memory."""
    size = 0
    for path in paths:
        fs, p = _fs(spark, path)
        size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def of_inputs(spark: SparkSession, name: str, sf_dir: str, inputs: tuple[str, ...], key: tuple[str, ...], part: str, bucket: str, make: Callable[..., DataFrame], dealt: bool = False) -> tuple[Table, DataFrame]:
    """The table that `make` gives, written once for each state of its input files in this application. With `dealt`, make takes the number of buckets and deals its rows into them."""
    paths = [f"{sf_dir}/{i}.parquet" for i in inputs]
    state = "\n".join([sf_dir, *(state_of(spark, p) for p in paths)])
    table = Table(f"{name}_{hashlib.sha256(state.encode()).hexdigest()[:16]}", key, part, bucket)
    if table.whole(spark):
        return table, table.read(spark)
    buckets = buckets_of(spark, paths)
    return table, table.create(make(buckets) if dealt else make(), buckets, dealt)
