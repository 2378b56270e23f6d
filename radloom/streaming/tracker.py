"""Job progress over interleaved event kinds.

Events of all kinds share one shape: ``job_id``, ``kind`` (``request``,
``collection``, ``status``), and the counts that kind carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.operators.jobs import complete_jobs, split_late, status_of
from radloom.session import pin
from radloom.streaming.microbatch import quarantine, write_batch

EVENT_SCHEMA = "job_id string, kind string, key_count long, part int, files long"
STATE_SCHEMA = "job_id string, key_count long, infos long, expected long, statuses long, status string"
_TOTALS = ("infos", "expected", "statuses")


def counts_of(events: DataFrame) -> DataFrame:
    """Counts per job of some events."""
    kind = F.col("kind")
    return events.groupBy("job_id").agg(
        F.max(F.when(kind == "request", F.col("key_count"))).alias("key_count"),
        F.count_if((kind == "collection") & (F.col("part") == 0)).alias("infos"),
        F.coalesce(F.sum(F.when(kind == "collection", F.col("files"))), F.lit(0)).alias("expected"),
        F.count_if(kind == "status").alias("statuses"))


def progress(events: DataFrame) -> DataFrame:
    """Counts and state per job; works on a stream (update mode) or a table."""
    return counts_of(events).withColumn("status", F.when(F.col("key_count").isNotNull(), status_of(
        *map(F.col, ("key_count", *_TOTALS)))))


def advance(state: DataFrame, events: DataFrame) -> DataFrame:
    """The state of all jobs after more events.

    A job keeps what it was told before: waiting for statuses is not left
    backwards, and a failed or completed job stays as it is, its counts too.
    """
    new = counts_of(events).select(F.col("job_id").alias("_job"), *[F.col(c).alias(f"_{c}") for c in ("key_count", *_TOTALS)])
    both = state.join(join_side(new, "_job"), F.col("job_id") == F.col("_job"), "full_outer")
    closed = F.coalesce(F.col("status").isin("Completed", "Failed"), F.lit(False))
    add = lambda c: F.when(closed, F.col(c)).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
    summed = both.select(F.coalesce("job_id", "_job").alias("job_id"), F.coalesce("key_count", "_key_count").alias("key_count"),
                         *[add(c) for c in _TOTALS], "status")
    before = F.coalesce("status", F.lit("WaitingForCollectionInfo"))
    moved = F.when(F.col("key_count").isNotNull(), status_of(*map(F.col, ("key_count", *_TOTALS)), before=before))
    return complete_jobs(summed.withColumn("status", moved)).select("job_id", "key_count", *_TOTALS, "status")


def track_handler(state_path: str, late_path: str, completed_path: str):
    """Batch handler for long-running tracking.

    Every batch writes the whole state once, from that of the batch before it:
    a row per job, so a batch costs what there are jobs, however long the run.
    Jobs that finish are recorded, and later events of a completed job go to the
    dead letters.  A repeated batch starts from the same state again.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _latest_before(spark, state_path, batch_id)
        state = spark.read.schema(STATE_SCHEMA).parquet(earlier) if earlier else spark.createDataFrame([], STATE_SCHEMA)
        batch, late = split_late(batch, state.where("status = 'Completed'"))
        quarantine(late.withColumn("bad", F.lit("job already completed")), late_path, batch_id)
        now = pin(advance(state, batch))
        open_before = state.where("status in ('Completed', 'Failed')").select(F.col("job_id").alias("_closed"))
        finished = now.where("status in ('Completed', 'Failed')").join(
            join_side(open_before, "_closed"), F.col("job_id") == F.col("_closed"), "left_anti")
        write_batch(finished.select("job_id", "status"), completed_path, batch_id)
        # The state comes last: a batch that broke off before it starts from the beginning.
        write_batch(now, state_path, batch_id)
    return handle


def _latest_before(spark, path: str, batch_id: int) -> str | None:
    """The folder of the last complete state before a batch."""
    from radloom.sources.sinks import _hadoop_path

    fs, folder = _hadoop_path(spark, path)
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("batch=") and n < f"batch={batch_id:012d}" and fs.exists(_hadoop_path(spark, f"{path}/{n}/_SUCCESS")[1])]
    return f"{path}/{max(done)}" if done else None
