"""Event-time aggregation of the signal stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine a folder of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tapeloom-")


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events and their value per day and type; complete over all that has arrived."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return stream.groupBy(day.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.to_date("w.start").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads what is there as a stream, to its end, and returns the complete result as a table in the shared folder.

    Every batch replaces the table, so a repeated batch changes nothing; state is one row per day and type. An
    empty stream has no batch and leaves the empty table that is written first.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts, path = daily_counts(stream), f"{_shared(spark)}/daily-{uuid.uuid4().hex}"
    spark.createDataFrame([], counts.schema).write.parquet(f"{path}/table")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/table")
