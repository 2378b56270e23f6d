"""Reconciliation by digests: the same differences as a full comparison, found in few buckets, and gone after the load."""

import pytest
from pyspark.sql import functions as F

from radloom.operators import reconcile as R
from radloom.operators.load import merge_live
from radloom.sources import sinks

COLUMNS = "k string, v string, w int"


@pytest.fixture
def sides(spark):
    store = [(str(i), f"v{i}", i % 3 or None) for i in range(200)]
    live = [r for r in store if r[0] not in ("7", "8")] + [("x", "only here", 1)]
    live = [("9", "other", r[2]) if r[0] == "9" else ("10", r[1], 99) if r[0] == "10" else ("12", r[1], 0) if r[0] == "12" else r for r in live]
    return spark.createDataFrame(store + [(None, "no key", 1)], COLUMNS), spark.createDataFrame(live, COLUMNS)


WANT = [("changed", "10"), ("changed", "12"), ("changed", "9"), ("missing", "7"), ("missing", "8"), ("surplus", "x")]


@pytest.mark.parametrize("buckets", [1, 16, 300])
def test_three_kinds(sides, rows, buckets):
    store, live = sides
    assert rows(R.reconcile_changes(store, live, "k", ["v", "w"], buckets), "kind", "k") == WANT
    assert R.reconcile_changes(store, store, "k", ["v", "w"], buckets).count() == 0
    assert rows(R.reconcile_changes(store, live, "k", ["w"], buckets).where("kind = 'changed'"), "k") == [("10",), ("12",)]
    assert R.reconcile_changes(store.limit(0), live, "k", ["v", "w"], buckets).where("kind = 'surplus'").count() == 199


def test_differing_buckets_from_the_root(sides):
    store, live = sides
    left, right = (R.bucket_digests(d, "k", ["v", "w"], 5000) for d in sides)
    found = R.differing_buckets(left, right, 5000, fan=8)
    assert found == R.differing_buckets(left, right, 5000) and 1 <= len(found) <= 6
    assert R.differing_buckets(left, left, 5000) == []


def test_nulls_and_order_count(spark):
    digest = lambda *rows: R.bucket_digests(spark.createDataFrame(list(rows), "k string, a string, b string"), "k", ["a", "b"], 1).first()
    assert digest(("1", "x", None)) != digest(("1", None, "x"))
    assert digest(("1", "x", "y"), ("2", "z", "z")) == digest(("2", "z", "z"), ("1", "x", "y"))
    assert digest(("1", "x", "y"), ("1", "x", "y")) != digest(("1", "x", "y"))


def test_tables_agree_after_the_load(spark, sides, tmp_path, rows):
    store, live = sides
    stamp = lambda df: df.where("k is not null").selectExpr("*", "timestamp'2020-01-01' valid_from", "1 load_run_id")
    paths = [str(tmp_path / n) for n in ("store", "live")]
    for df, path in zip(sides, paths):
        sinks.write_buckets(stamp(df), path, "k", 32)
    schema = stamp(live).schema
    changes = R.reconcile_tables(spark, *paths, schema, "k", ["v", "w"])
    assert rows(changes, "kind", "k") == WANT
    assert len(changes.inputFiles()) < sum(len(sinks.read_buckets(spark, p, schema).inputFiles()) for p in paths) / 2
    load = lambda stage: sinks.merge_buckets(stage, paths[1], schema, "k", 32, lambda old, new: merge_live(old, new, "k", 2, F.current_timestamp()))
    assert rows(R.bring_over(changes, load), "k") == [("x",)]
    before = set((tmp_path / "live" / "digests" / "k-v-w").glob("part-*"))
    assert rows(R.reconcile_tables(spark, *paths, schema, "k", ["v", "w"]), "kind", "k") == [("surplus", "x")]
    new = set((tmp_path / "live" / "digests" / "k-v-w").glob("part-*")) - before
    assert 1 <= spark.read.parquet(*map(str, new)).count() <= 5
    assert R.reconcile_tables(spark, paths[0], str(tmp_path / "none"), schema, "k", ["v", "w"]).where("kind = 'missing'").count() == 200
