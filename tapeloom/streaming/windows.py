"""Event time with an end: watermarked windows, sessions and duplicates, state that expires, restarts from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.sources import lake

BATCHES = 4


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events by window and type, each once its window is over; a row whose window was over before it came is dropped."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events that are less than a gap apart, each once it can't grow any more."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "value")


def distinct_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event's first arrival: an id is remembered until the watermark passes it, then its state goes."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def arriving(spark: SparkSession, sf_dir: str, delayed: int | None = 97, doubled: int | None = 10) -> list[DataFrame]:
    """The events as BATCHES arrivals: by quarters of their time, each `delayed`-th id two quarters late, each
    `doubled`-th id once more in the same quarter; None for no such events."""
    each = lambda n: F.lit(False) if n is None else F.col("event_id") % n == 0
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    quarter = F.least(F.lit(BATCHES - 1), F.floor((F.unix_micros("ts") - F.unix_micros("a")) * BATCHES / F.greatest(F.unix_micros("b") - F.unix_micros("a"), F.lit(1)))).cast("int")
    e = e.crossJoin(F.broadcast(ends)).withColumn("batch", F.when(each(delayed), F.least(F.lit(BATCHES - 1), quarter + 2)).otherwise(quarter)).drop("a", "b")
    e = e.withColumn("copy", F.explode(F.when(each(doubled), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return [e.where(F.col("batch") == k).drop("batch", "copy") for k in range(BATCHES)]


def run(spark: SparkSession, batches: list[DataFrame], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `query` has emitted after all batches, as a table in the shared folder.

    Each batch is one arrival of files; the stream is started anew for it, goes on from its checkpoint, and stops when
    all is read. A micro-batch writes a folder of its own number, so that one run again replaces what it wrote."""
    root = lake.fresh_path(spark, "stream")
    batches[0].limit(0).write.parquet(f"{root}/in")
    schema, out = batches[0].schema, None
    for b in batches:
        b.write.mode("append").parquet(f"{root}/in")
        result = query(spark.readStream.schema(schema).parquet(f"{root}/in"))
        out = result.schema

        def keep(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{root}/out/number={number}")

        result.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{root}/out")
