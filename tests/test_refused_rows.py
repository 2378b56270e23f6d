"""A bucketed load loses no staged row."""

from pyspark.sql import functions as F

from radloom.operators.load import merge_live
from radloom.sources import sinks


def test_bucketed_merges_keep_refused_rows(spark, tmp_path, rows):
    path = str(tmp_path / "live")
    live = spark.createDataFrame([("1", "old"), ("2", "old")], "k string, v string").selectExpr(
        "*", "timestamp'2020-01-01' valid_from", "1 load_run_id")
    sinks.write_buckets(live, path, "k", 4)
    stage = spark.createDataFrame([("1", "new"), ("2", "a"), ("2", "b"), ("3", "new"), (None, "x")], "k string, v string")
    sinks.merge_buckets(stage, path, live.schema, "k", 4, lambda old, new: merge_live(
        old, new, "k", 2, F.lit("2024-01-01").cast("timestamp")))
    assert rows(sinks.read_buckets(spark, path, live.schema), "k", "v") == [("1", "new"), ("2", "old"), ("3", "new")]
    assert rows(sinks.read_version(spark, f"{path}/refused"), "k", "v") == [("2", "a"), ("2", "b"), (None, "x")]
