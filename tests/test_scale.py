"""Plans and results where one key owns a large share of the rows."""

import re

import pytest
from pyspark.sql import functions as F

import workload
from radloom.operators import cohort as C, identity as I, load as L
from radloom.operators.rejectors import Blacklist, ColumnValues, DynamicRules, Rule, apply_rejectors
from radloom.operators.validate import ExtractionOptions
from radloom.plans.extraction import plan_extraction
from radloom.schemas import Catalogue


@pytest.fixture
def big(spark):
    """No broadcasts, and tiny limits for what counts as a skewed partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=60000):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    return spark.range(0, n, 1, 8).select("id", key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))


def test_lookups_split_a_hot_key(big):
    df = hot(big)
    mapping = df.select(F.col("k").alias("swap")).distinct().withColumn("replacement", F.md5("swap"))
    swapped = I.swap_lookup(df, "k", mapping)
    assert "skew=true" in final_plan(swapped)
    assert swapped.where("replacement = md5(k)").count() == 60000
    judged = apply_rejectors(df, [ColumnValues("k", big.createDataFrame([("HOT",)], "v string"))])
    assert "skew=true" in final_plan(judged)
    assert judged.where("reject").count() == 20000


def test_cohort_rows_split_a_hot_study(big):
    images = hot(big).select(F.col("k").alias("StudyInstanceUID"), F.lit("s").alias("SeriesInstanceUID"), F.col("id").cast("string").alias("SOPInstanceUID"),
                             F.col("payload").alias("RelativeFileArchiveURI"))
    ids = images.select(F.col("StudyInstanceUID").alias("key_value")).distinct().select(F.lit(1).alias("pos"), "key_value") \
        .union(big.createDataFrame([(2, "none")], "pos int, key_value string"))
    catalogues = [Catalogue("CT_T", images)]
    rows = C.match_cohort(ids, "StudyInstanceUID", catalogues, C.match_images(ids, "StudyInstanceUID", catalogues, []))
    assert "skew=true" in final_plan(rows)
    assert rows.count() == 60001 and rows.where("SOPInstanceUID IS NULL").first()["key_value"] == "none"


@pytest.mark.parametrize("studies,skewed", [(3000, False), (2, True)])
def test_verdicts_are_made_distinct_and_met_with_the_request_in_place(big, studies, skewed):
    """Rows move for the lists only; a large study is split all the same, and an image judged twice alike is one."""
    n = F.col("id")
    study = F.when(n % 3 > 0, (n % studies).cast("string")).otherwise("hot") if skewed else (n % studies).cast("string")
    once = big.range(0, 12000, 1, 4).select(study.alias("StudyInstanceUID"), F.concat_ws(".", study, n % 6000).alias("SeriesInstanceUID"), n.cast("string").alias("SOPInstanceUID"),
                                            F.md5(n.cast("string")).alias("RelativeFileArchiveURI"), (n % 7).cast("string").alias("PatientID"), (n % 2 == 0).alias("plain"))
    # The same images again, now decided by the rule that gives the reason of the list.
    images = once.union(once.where("PatientID = '3'").withColumn("plain", F.lit(False)))
    listed = Catalogue("Bad", big.createDataFrame([("1", None), ("20", None), (None, "12.12"), (None, "hot.12")], "StudyInstanceUID string, SeriesInstanceUID string"))
    patients = big.createDataFrame([("3",)], "PatientID string")
    rule = DynamicRules((Rule("NOT plain", f"'{ColumnValues.REASON}'"),))
    ids = once.select(F.col("StudyInstanceUID").alias("key_value")).distinct().select(F.lit(1).alias("pos"), "key_value")
    catalogues = [Catalogue("CT_T", images)]
    matched = C.match_images(ids, "StudyInstanceUID", catalogues, [rule, Blacklist(listed), ColumnValues("PatientID", patients)])
    rows = C.match_cohort(ids, "StudyInstanceUID", catalogues, matched)
    plan = final_plan(rows)
    assert ("skew=true" in plan) == skewed
    assert skewed or not re.search(r"Exchange hashpartitioning\([^)]*RelativeFileArchiveURI", plan)
    bad = [{r[0] for r in listed.df.select(c).dropna().collect()} for c in ("StudyInstanceUID", "SeriesInstanceUID")]
    expected = {(r[0], r[2], ColumnValues.REASON if not r.plain else "Blacklisted in Bad" if r[0] in bad[0] or r[1] in bad[1] else ColumnValues.REASON if r.PatientID == "3" else None)
                for r in images.collect()}
    got = [tuple(r) for r in rows.select("key_value", "SOPInstanceUID", "reason").collect()]
    assert set(got) == expected and len(got) == len(expected)


@pytest.mark.parametrize("keys,skewed", [(3000, False), (2, True)])
def test_collections_move_their_content_once(big, keys, skewed):
    n = F.col("id")
    key = F.when(n % 3 > 0, (n % keys).cast("string")).otherwise("hot") if skewed else (n % keys).cast("string")
    images = big.range(0, 12000, 1, 4).select(key.alias("StudyInstanceUID"), (n % 100).cast("string").alias("SeriesInstanceUID"), n.cast("string").alias("SOPInstanceUID"),
                                              F.md5(n.cast("string")).alias("RelativeFileArchiveURI"), n)
    ids = images.select(F.lit(1).alias("pos"), F.col("StudyInstanceUID").alias("key_value")).distinct().union(big.createDataFrame([(2, "none"), (3, "1"), (4, None)], "pos int, key_value string"))
    rules = DynamicRules((Rule("id % 5 = 0", "'fifth'"), Rule("id % 25 = 1", "'FIFTH'"), Rule("id % 7 = 0", "concat('r', id % 400)")))
    plan = plan_extraction(ids, ExtractionOptions("StudyInstanceUID"), "CT", "p/x", [Catalogue("CT_T", images)], [rules], keep=True)
    assert "FileScan parquet" in plan.matched._jdf.queryExecution().executedPlan().toString()
    packed = C.collection_messages(ids, plan.matched, plan.files, part_size=100)
    text = final_plan(packed)
    assert skewed and "skew=true" in text or not re.search(r"Exchange hashpartitioning\([^)]*part#", text)
    records = packed.collect()
    assert len({(r.key_pos, r.key_value, r.part) for r in records}) == len(records) and max(len(r.files) for r in records) < 200
    assert {(r.key_pos, r.key_value) for r in records if r.part == 0} == {(r.pos, r.key_value) for r in ids.where("key_value IS NOT NULL").collect()}
    got, asked = {}, {r.key_value for r in records}
    for r in (r for r in records if r.key_pos < 3):
        files, reasons = got.setdefault(r.key_value, ([], {}))
        assert not reasons.keys() & r.reasons.keys()
        files.extend(r.files), reasons.update(r.reasons)
    expected, least = {k: ([], {}) for k in asked}, {}
    for r in sorted(plan.matched.collect(), key=lambda r: (r.RelativeFileArchiveURI, r.SOPInstanceUID)):
        files, reasons = expected[r.key_value]
        if r.reason is None:
            files.append(f"{r.StudyInstanceUID}/{r.SeriesInstanceUID}/{r.SOPInstanceUID}-an.dcm")
        else:
            spelt = least.setdefault((r.key_value, r.reason.lower()), r.reason)
            reasons[spelt] = reasons.get(spelt, 0) + 1
    assert {k: (sorted(f), m) for k, (f, m) in got.items()} == {k: (sorted(f), m) for k, (f, m) in expected.items()}


def test_archive_of_most_entries(big):
    entries = hot(big).select(F.col("payload").alias("DicomFilePath"), F.when(F.col("k") == "hot", "big.zip").alias("archive"), F.col("id").alias("entry_pos"))
    store = entries.where((F.col("archive") == "big.zip") & (F.col("entry_pos") == 30000)).select("DicomFilePath")
    assert L.skip_existing(entries, store).groupBy("archive").count().orderBy("archive").collect()[1]["count"] == 10000


def test_no_plan_pairs_rows_or_gathers_them(big):
    """No cross or nested-loop join anywhere; one task only for totals and offsets."""
    totals = {"job_info", "apply_update_count", "update_audit", "chunk_ids", "rejected_files", "find_skip"}
    for name, query in workload.QUERIES.items():
        plan = query(big, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoop|BatchEvalPython|ArrowEvalPython", plan), name
        assert "SinglePartition" not in plan or name in totals, name


def test_isolation_joins_go_by_the_measured_size_of_bad_keys(spark):
    f = spark.range(0, 400_000, 1, 4).select((F.col("id") % 50_000).cast("string").alias("StudyInstanceUID"),
                                             (F.col("id") % 100_000).cast("string").alias("SeriesInstanceUID"), F.col("id").cast("string").alias("SOPInstanceUID"))
    study = f.select("StudyInstanceUID", F.lit(1).alias("age")).union(spark.createDataFrame([("7", 2), (None, 3), (None, 4)], "s string, age int"))
    out = L.isolate(study, f.select("StudyInstanceUID", "SeriesInstanceUID"), f.select("SeriesInstanceUID", "SOPInstanceUID"))
    assert "SortMergeJoin" not in out.good["series"]._jdf.queryExecution().executedPlan().toString()
    assert out.bad["study"].count() == 9 and out.good["study"].count() == 400_000 + 3 - 9
    assert {r.SeriesInstanceUID for r in out.bad["series"].collect()} == {"7", "50007"} and out.good["series"].count() == 400_000 - 8
    assert sorted(int(r.SOPInstanceUID) for r in out.bad["image"].collect()) == list(range(7, 400_000, 50_000)) and out.good["image"].count() == 400_000 - 8


def test_rows_that_rules_decide_meet_no_list(big):
    df = hot(big).withColumn("other", F.lit("z"))
    listed = big.createDataFrame([("HOT",)], "v string")
    judged = apply_rejectors(df, [DynamicRules((Rule("id % 2 = 0", "'even'"),)), ColumnValues("k", listed)])
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter"):]
    assert "Union" in plan and re.search(r"Filter .*% 2", join)
    counts = {r.reason: r["count"] for r in judged.groupBy("reason").count().collect()}
    assert counts == {"even": 30000, ColumnValues.REASON: 10000, None: 20000}


def test_identifiers_without_images_are_found_without_the_request(big):
    images = hot(big).select(F.col("k").alias("StudyInstanceUID"), F.lit("s").alias("SeriesInstanceUID"), F.col("id").cast("string").alias("SOPInstanceUID"),
                             F.col("payload").alias("RelativeFileArchiveURI"))
    ids, catalogues = big.createDataFrame([(1, "hot"), (2, "none"), (3, "none")], "pos int, key_value string"), [Catalogue("CT_T", images)]
    matched = big.createDataFrame([], "key_value string, RelativeFileArchiveURI string, StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, reject boolean, reason string")
    rows = C.match_cohort(ids, "StudyInstanceUID", catalogues, matched)
    assert "LeftSemi" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.pos for r in rows.collect()) == [2, 3]
