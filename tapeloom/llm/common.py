"""What several operators share: white space, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, [\x20\x09-\x0D].
WS = " \t\n\x0b\f\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Keys that a spread join deals out over several tasks, at most.
HOT_KEYS = 5_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tapeloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, so a lost executor costs no recomputation upstream."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: str, by: str) -> DataFrame:
    """Inner join of `left` with `right`, which has one row per key, and in `rows` about how many rows of `left` have it.

    A key with more than a HOT_KEYS-th of all rows is dealt out by a hash of `by` in `left`, and its row of `right`
    repeated as often; there are at most HOT_KEYS such keys, so their list of two numbers each can be broadcast.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    if not total:
        return left.join(right, key)
    salts = F.ceil(F.col(rows) * HOT_KEYS / F.lit(total)).cast("int")
    hot = right.where(salts > 1).select(F.col(key).alias("hot_"), salts.alias("salts_"))
    salted = left.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts_")).cast("int"), F.lit(0))).drop("hot_", "salts_")
    repeated = right.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return salted.join(repeated, [key, "salt_"]).drop("salt_")


def free_memory() -> None:
    """At a task's end: what Arrow and the C library hold but don't use goes back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[name], F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
