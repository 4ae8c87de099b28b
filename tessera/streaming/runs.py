"""Structured Streaming forms of the incremental contracts: running totals, idempotent delivery, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream; it stops when all files are read if started with availableNow."""
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet")
    # a table may be one file or a folder: the stream reads a folder and keeps to the table's own files
    return reader.option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def running_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def drain(result: DataFrame, name: str, checkpoint: str, mode: str = "complete", timeout: float = 120) -> DataFrame:
    """Run a streaming result over all that is there and give its rows; a second run with the checkpoint resumes."""
    query = result.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    return result.sparkSession.table(name)


def snapshots(result: DataFrame, path: str, checkpoint: str, every: int = 1, timeout: float = 120) -> None:
    """Run a streaming aggregate over all that is there; after every `every` batches the rows so far are written to the folder
    batch=N below path. A batch that is run again overwrites its own folder."""

    def put(rows: DataFrame, batch: int) -> None:
        if (batch + 1) % every == 0:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        else:
            rows.write.format("noop").mode("overwrite").save()  # the state moves on only if the batch is computed

    query = result.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(timeout)
