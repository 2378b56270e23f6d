"""Micro-batches: reading events, idempotent writes, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A folder of JSON event files as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch under its number; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def quarantine(df: DataFrame, path: str, batch_id: int, reason: str = "bad") -> None:
    """Dead letters of a batch with reason, batch and time."""
    letters = df.select(F.to_json(F.struct(*[c for c in df.columns if c != reason])).alias("record"),
                        F.col(reason).alias("reason"), F.lit(batch_id).alias("batch_id"),
                        F.current_timestamp().alias("held_at"))
    write_batch(letters, path, batch_id)


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each batch to ``handle``; progress counts only after it returns.

    With ``every`` the stream goes on at that interval; without, it takes what
    is there and stops.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def split_handler(check: Callable[[DataFrame], DataFrame], good_path: str, bad_path: str,
                  process: Callable[[DataFrame], DataFrame] = lambda df: df, bad: str = "bad") -> Callable[[DataFrame, int], None]:
    """A handler that writes good rows on and bad rows to the dead letters."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = check(batch)
        write_batch(process(checked.where(F.col(bad).isNull()).drop(bad)), good_path, batch_id)
        quarantine(checked.where(F.col(bad).isNotNull()), bad_path, batch_id, bad)
    return handle


def stream_dedupe(stream: DataFrame, key: str, event_time: str, within: str) -> DataFrame:
    """Drop repeated keys that arrive within a delay; state stays bounded."""
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])
