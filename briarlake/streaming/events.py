"""Structured Streaming over the event feed: deltas, duplicate suppression, windows; `sessions` has the state of sessions and the live feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.scratch import Scratch

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: str = "events*", per_batch: int = 1000) -> DataFrame:
    """Parquet files of events as they appear, and those in folders of such names; ts is cast, as watermarks need TIMESTAMP."""
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).parquet(f"{folder}/{files}")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, scratch: Scratch, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a written table and return it.

    Offsets and state live in the shared folder: a lost executor or a restart
    resumes from the last micro-batch.
    """
    target, state = f"{scratch.base}/stream", f"{scratch.base}/state"
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).option("path", target).trigger(availableNow=True).start()
    else:  # in update mode each micro-batch has a folder of its own, which a repeated one replaces
        folder = "/epoch={}" if mode == "update" else ""

        def replace(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(target + folder.format(epoch))

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(replace).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def once(stream: DataFrame) -> DataFrame:
    """Each event id once, however late it comes: the state holds every id."""
    return stream.dropDuplicates(["event_id"])


def day_counts(stream: DataFrame) -> DataFrame:
    """Events and value per day and type (an extension: the reference has no windows)."""
    return stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def deltas(stream: DataFrame, scratch: Scratch) -> list[int]:
    """Rows of each micro-batch of what is there now: what a live view is sent per tick."""
    sent: dict[int, int] = {}
    query = stream.writeStream.option("checkpointLocation", f"{scratch.base}/state").foreachBatch(lambda batch, epoch: sent.__setitem__(epoch, batch.count())).trigger(availableNow=True).start()
    query.awaitTermination()
    return [n for _, n in sorted(sent.items()) if n]
