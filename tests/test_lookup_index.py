"""The index over a catalogue's files: no file that can answer is left out, and few others are opened."""

import re

import pytest
from pyspark.sql import functions as F

from radloom.operators import cohort as C
from radloom.schemas import PATH, SERIES, SOP, STUDY, Catalogue
from radloom.sources import lookup_index as X
from workload import views as V
from workload.registry import Tables


@pytest.fixture
def catalogue(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(4000).select((F.floor(F.col("id") / 4)).cast("string").alias(STUDY), F.concat(F.lit("s"), F.floor(F.col("id") / 2)).alias(SERIES),
                             F.concat(F.lit("i"), "id").alias(SOP), F.concat(F.lit("p"), "id").alias(PATH)).repartitionByRange(20, STUDY).write.parquet(path)
    return path


def ids(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos int, key_value string")


def test_opens_only_files_that_can_hold_an_identifier(spark, catalogue, tmp_path, rows):
    index, df = str(tmp_path / "index"), spark.read.parquet(catalogue)
    assert len(X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY, SOP], 4)) == 20
    asked = ids(spark, "17", "18", "555", "555", "gone", None)
    few = X.cut_down(df, asked, "key_value", index, STUDY)
    assert 2 <= len(few.inputFiles()) <= 4
    whole, part = (C.match_images(asked, STUDY, [Catalogue("CT_x", d)], []) for d in (df, few))
    assert rows(whole) == rows(part) and part.count() == 12
    assert C.match_cohort(asked, STUDY, [Catalogue("CT_x", few)], part).count() == C.match_cohort(asked, STUDY, [Catalogue("CT_x", df)], whole).count() == 18
    assert len(X.cut_down(df, ids(spark, "i7"), "key_value", index, SOP).inputFiles()) <= 2
    assert len(X.cut_down(df, ids(spark, "gone", None), "key_value", index, STUDY).inputFiles()) <= 1
    assert X.cut_down(df, ids(spark).limit(0), "key_value", index, STUDY).count() == 0
    # Every identifier finds its file; hardly any finds another.
    every = [r[0] for r in df.select(STUDY).distinct().collect()]
    assert len(X.candidate_files(ids(spark, *every), "key_value", index, STUDY, df.inputFiles())) == 20


def test_a_load_adds_its_own_files(spark, catalogue, tmp_path, rows):
    index, df = str(tmp_path / "index"), spark.read.parquet(catalogue)
    X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 4)
    written = {p.name for p in (tmp_path / "index" / "buckets=4").glob("part-*")}
    df.where("StudyInstanceUID = '3'").withColumn(STUDY, F.lit("new")).coalesce(1).write.mode("append").parquet(catalogue)
    df = spark.read.parquet(catalogue)
    # A file the index does not know yet is opened.
    assert X.cut_down(df, ids(spark, "new"), "key_value", index, STUDY).where(F.col(STUDY) == "new").count() == 4
    assert X.cut_down(df, ids(spark, "17"), "key_value", index, STUDY).where(F.col(STUDY) == "17").count() == 4
    assert len(X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 4)) == 1 and X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 4) == []
    assert written < {p.name for p in (tmp_path / "index" / "buckets=4").glob("part-*")}
    few = X.cut_down(df, ids(spark, "new"), "key_value", index, STUDY)
    assert few.count() == 4 and len(few.inputFiles()) == 1
    with pytest.raises(ValueError, match="4 buckets"):
        X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 8)


def test_null_keys_empty_files_and_gone_files(spark, tmp_path):
    path, index = str(tmp_path / "rows"), str(tmp_path / "index")
    schema = "StudyInstanceUID string, x int"
    spark.createDataFrame([(None, 1)], schema).coalesce(1).write.parquet(path)
    spark.createDataFrame([("a", 2)], schema).coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 2)
    assert X.indexed_files(spark, index).count() == len(df.inputFiles())
    found = X.candidate_files(ids(spark, "a", None), "key_value", index, STUDY, df.inputFiles())
    assert len(found) == 1 and spark.read.parquet(*found).first().x == 2
    assert X.candidate_files(ids(spark, "a"), "key_value", index, STUDY, []) == []


def test_filters_are_those_of_a_bitmap_and_no_places_are_sorted(spark, tmp_path):
    spark.range(0, 5000, 1, 2).select(F.md5(F.col("id").cast("string")).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select("a", "b", "_metadata")
    got = X.file_rows(rows, ["a", "b"], 3)
    assert "bitmap_construct_agg" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = rows.select("_metadata.file_path", F.explode(F.array(F.struct(F.lit("a").alias("c"), F.col("a").alias("v")), F.struct(F.lit("b").alias("c"), F.col("b").alias("v")))).alias("p"))
    held = pairs.where("p.v IS NOT NULL").select("file_path", "p.c", "p.v").distinct()
    plain = held.select("file_path", "c", X._bucket(F.col("v"), 3).alias("bucket"), F.explode(X._places(F.col("v"))).alias("place")).groupBy("file_path", "c", "bucket").agg(
        (F.count("*") / X.PLACES).cast("long").alias("n"), F.bitmap_construct_agg(F.col("place").cast("long")).alias("bits"))
    ends = lambda path: path.rpartition("/")[2]
    assert {(r.column, r.bucket, ends(r.file)): (r["keys"], bytes(r.filter)) for r in got.collect()} == \
        {(r.c, r.bucket, ends(r.file_path)): (r.n, bytes(r.bits)) for r in plain.collect()}


def test_values_travel_without_their_files_path_and_identifiers_without_their_places(spark, catalogue, tmp_path, monkeypatch):
    rows, index = spark.read.parquet(catalogue).select(STUDY, SOP, "_metadata"), str(tmp_path / "index")
    got = X.file_rows(rows, [STUDY, SOP], 3)
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bfile#", got._jdf.queryExecution().executedPlan().toString())
    held = rows.select(STUDY, "_metadata.file_path").groupBy("file_path").agg(F.count_distinct(STUDY)).collect()
    assert sorted(r[0] for r in got.where(F.col("column") == STUDY).groupBy("file").agg(F.sum("keys")).select("sum(keys)").collect()) == sorted(r[1] for r in held)
    df, stored = spark.read.parquet(catalogue), []
    X.add_files(spark, index, df.inputFiles(), df.schema, [STUDY], 4)
    monkeypatch.setattr(X, "kept", lambda wanted: stored.append(wanted.columns) or wanted)
    assert len(X.candidate_files(ids(spark, "17", "18"), "key_value", index, STUDY, df.inputFiles())) < 20 and stored == [["b", "value"]]


def test_the_stored_catalogue_has_whole_studies_in_its_files_and_no_shuffle_of_its_own(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    dealt, plain = V.patient_files(t, 32), V.patient_files(t)
    assert "rangepartitioning" not in dealt._jdf.queryExecution().executedPlan().toString() and dealt.rdd.getNumPartitions() == 32
    places = dealt.select(STUDY, F.spark_partition_id().alias("at")).distinct()
    assert places.count() == plain.select(STUDY).distinct().count() and places.select("at").distinct().count() == 32
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
