import pytest
from pyspark.sql import functions as F

from radloom.functions import paths
from radloom.operators import cohort as C
from radloom.operators.rejectors import (Blacklist, ColumnValues, DynamicRules, ModalityRules, RejectAll, apply_rejectors,
                                         select_chain)
from radloom.operators.validate import ExtractionOptions
from radloom.plans.extraction import plan_extraction
from radloom.schemas import Catalogue
from radloom.sources.cohort_csv import CohortFormatError, read_cohort

COLUMNS = "StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string, Extractable boolean, RelativeFileArchiveURI string"


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([
        ("1.1", "123.1", "1.1", True, "/images/1.dcm"), ("1.1", "123.1", "2.1", False, "/images/2.dcm"),
        ("1.1", "1234.1", "3.1", False, "/images/3.dcm"), ("1.1", "1234.1", "4.1", True, "/images/4.dcm")], COLUMNS)


def ids(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, key_value string")


def run(spark, catalogue, wanted, key="SeriesInstanceUID", base=(), **options):
    return plan_extraction(ids(spark, *wanted), ExtractionOptions(key, **options), "CT", "proj/x", [catalogue], list(base))


def test_series_lookup(spark, lookup, rows):
    plan = run(spark, Catalogue("CT_Table", lookup), ["123.1"])
    assert rows(plan.summary) == [(0, "123.1", 2, 0)]
    assert rows(plan.files, "file_path") == [("images/1.dcm",), ("images/2.dcm",)]


def test_mandatory_filter(spark, lookup, rows):
    plan = run(spark, Catalogue("CT_Table", lookup, ("Extractable = true",)), ["123.1"])
    assert rows(plan.matched, "RelativeFileArchiveURI") == [("/images/1.dcm",)]


def test_reject_all_and_no_filters(spark, lookup, rows):
    catalogue = Catalogue("CT_Table", lookup, ("Extractable = true",))
    assert rows(run(spark, catalogue, ["123.1"], base=[RejectAll()]).summary) == [(0, "123.1", 0, 1)]
    assert rows(run(spark, catalogue, ["123.1"], base=[RejectAll()], no_filters=True).summary) == [(0, "123.1", 1, 0)]


def test_repeated_and_unknown_ids_keep_their_place(spark, lookup, rows):
    plan = run(spark, Catalogue("CT_Table", lookup), ["123.1", "nope", "123.1"])
    assert rows(plan.summary) == [(0, "123.1", 2, 0), (1, "nope", 0, 0), (2, "123.1", 2, 0)]
    assert rows(plan.collections) == [(0, "123.1", 2, 0, 0), (1, "nope", 0, 0, 0), (2, "123.1", 2, 0, 0)]
    assert plan.info.first()["key_count"] == 3


def test_null_paths_vanish_and_results_are_sets(spark, lookup, rows):
    doubled = lookup.union(lookup).union(spark.createDataFrame([("1.1", "123.1", "9", True, None)], COLUMNS))
    assert rows(run(spark, Catalogue("CT_Table", doubled), ["123.1"]).summary) == [(0, "123.1", 2, 0)]


def test_super_table(spark, rows):
    table = spark.range(300).select(
        (F.col("id") % 7).cast("string").alias("StudyInstanceUID"), F.col("id").cast("string").alias("SeriesInstanceUID"),
        F.col("id").cast("string").alias("SOPInstanceUID"), F.col("id").cast("string").alias("RelativeFileArchiveURI"),
        (F.col("id") >= 10).alias("IsExtractableToDisk"), F.lit("Withheld by the site").alias("IsExtractableToDisk_Reason"))
    rules = DynamicRules.from_yaml('[{when: "NOT IsExtractableToDisk", reason: IsExtractableToDisk_Reason}]')
    plan = run(spark, Catalogue("CT_T", table), [str(i) for i in range(7)], "StudyInstanceUID", [rules])
    total = plan.summary.agg(F.sum("accepted"), F.sum("rejected")).first()
    assert tuple(total) == (290, 10)
    assert {r["reason"] for r in plan.reasons.collect()} == {"Withheld by the site"}


def test_routing(spark, lookup):
    catalogues = [Catalogue("CT_A", lookup), Catalogue("MR_A", lookup), Catalogue("CT_B", lookup.drop("SeriesInstanceUID"))]
    assert [c.name for c in C.route_catalogues(catalogues, "CT", "seriesinstanceuid")] == ["CT_A"]
    for modality in ("ct", "XX"):
        with pytest.raises(ValueError):
            C.route_catalogues(catalogues, modality, "SeriesInstanceUID")
    with pytest.raises(ValueError):
        C.route_catalogues(catalogues, "CT", "SeriesInstanceUID", "^CT_")


@pytest.mark.parametrize("column,value,hit", [
    ("StudyInstanceUID", "1.1", 4), ("SeriesInstanceUID", "123.1", 2), ("SOPInstanceUID", "3.1", 1), ("SOPInstanceUID", "z", 0)])
def test_blacklist(spark, lookup, column, value, hit):
    listed = Catalogue("Bad", spark.createDataFrame([(value,), (value,), (None,)], f"{column} string"))
    judged = apply_rejectors(lookup, [Blacklist(listed)])
    assert judged.count() == 4 and judged.where("reject").count() == hit
    assert hit == 0 or judged.where("reject").first()["reason"] == "Blacklisted in Bad"


def test_blacklist_needs_a_uid(spark, lookup):
    with pytest.raises(ValueError):
        apply_rejectors(lookup, [Blacklist(Catalogue("Bad", spark.createDataFrame([("x",)], "other string")))])


def test_column_values(spark):
    df = spark.createDataFrame([("Frank",), ("Peter",), (None,)], "PatientID string")
    listed = spark.createDataFrame([("FRANK",)], "id string")
    count = lambda r: apply_rejectors(df, [r]).where("reject").count()
    assert count(ColumnValues("PatientID", listed)) == 1
    assert count(ColumnValues("PatientID", ("FRANK",))) == 0
    assert count(ColumnValues("PatientID", ("FRANK",), ignore_case=True)) == 1
    with pytest.raises(ValueError):
        count(ColumnValues("Other", listed))


def test_rules_stop_at_the_first_and_blank_accepts(spark, rows):
    df = spark.createDataFrame([(1, True, "late"), (2, False, "late"), (3, False, None), (4, False, " ")], "n int, a boolean, b string")
    rules = DynamicRules.from_yaml("""
      - {when: "a", reason: "'first'"}
      - {when: "n > 1", reason: "b"}
      - {when: "true", reason: "'last'"}""")
    assert rows(apply_rejectors(df, [rules]), "n", "reason") == [(1, "first"), (2, "late"), (3, None), (4, None)]
    # An accepting rule set does not stop the rejectors after it.
    assert apply_rejectors(df, [rules, RejectAll()]).where("reject").count() == 4


def test_chain_choice():
    base, a, b = RejectAll(), DynamicRules(()), ColumnValues("x", ("y",))
    add, override = ModalityRules("CT,MR", a), ModalityRules("MR", b, overrides=True)
    assert select_chain("ct", [base], [add]) == [a, base]
    assert select_chain("PT", [base], [add, override]) == [base]
    assert select_chain("mr", [base], [override]) == [b]
    assert select_chain("CT", [base], [add], no_filters=True) == []
    with pytest.raises(ValueError):
        select_chain("MR", [base], [add, override])


def test_reason_spelling(spark, rows):
    matched = spark.createDataFrame(
        [("k", "b", "2", True, "No"), ("k", "a", "1", True, "NO"), ("k", "c", "3", False, None)],
        "key_value string, RelativeFileArchiveURI string, SOPInstanceUID string, reject boolean, reason string")
    assert rows(C.rejection_reasons(matched), "key_value", "reason", "n") == [("k", "NO", 2)]


def test_single_series(spark, lookup, rows):
    matched = run(spark, Catalogue("CT_T", lookup), ["1.1"], "StudyInstanceUID").matched
    assert rows(C.single_series(matched)) == [("1.1", None)]
    assert rows(C.by_series(matched)) == [("1.1", "123.1", 2, 0), ("1.1", "1234.1", 2, 0)]


def test_collection_messages_hold_everything(spark):
    files = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "big").otherwise(F.col("id").cast("string")).alias("key_value"),
                                     F.col("id").cast("string").alias("output_path"))
    path = F.col("output_path").alias("RelativeFileArchiveURI")
    matched = files.select("key_value", path, F.lit("s").alias("SOPInstanceUID"), F.lit(False).alias("reject"), F.lit(None).cast("string").alias("reason")).union(
        spark.createDataFrame([("big", "p", "s", True, "r")],
                              "key_value string, RelativeFileArchiveURI string, SOPInstanceUID string, reject boolean, reason string"))
    packed = C.collection_messages(ids(spark, "big", "none"), matched, files, part_size=100)
    big = packed.where("key_value = 'big'")
    assert big.agg(F.sum(F.size("files"))).first()[0] == 1667
    assert big.agg(F.max(F.size("files"))).first()[0] < 200
    assert big.select(F.explode("reasons")).collect()[0]["value"] == 1
    assert [(r["part"], r["files"], r["reasons"]) for r in packed.where("key_value = 'none'").collect()] == [(0, [], {})]


def test_chunks_keep_order(spark):
    wanted = [f"id{i % 40}" for i in range(105)]
    chunks = {r["chunk"]: r["identifiers"] for r in C.chunk_ids(ids(spark, *wanted), 10).collect()}
    assert [len(chunks[c]) for c in range(11)] == [10] * 10 + [5]
    assert sum((chunks[c] for c in range(11)), []) == wanted
    with pytest.raises(ValueError):
        C.chunk_ids(ids(spark, "a"), 0)


@pytest.mark.parametrize("name,identifiable,out", [
    ("file.dcm", False, "file-an.dcm"), ("file.dicom", False, "file-an.dcm"), ("file", False, "file-an.dcm"),
    ("file.foo", False, "file.foo-an.dcm"), ("foo.dcm", True, "foo.dcm"), ("foo", True, "foo.dcm"),
    ("a.dcm.dcm", False, "a-an.dcm-an.dcm")])
def test_output_names(spark, name, identifiable, out):
    df = spark.createDataFrame([("study", "series", f"foo/{name}")], "StudyInstanceUID string, SeriesInstanceUID string, RelativeFileArchiveURI string")
    assert df.select(paths.out_path_name(F.lit(identifiable))).first()[0] == f"study/series/{out}"
    assert df.select(paths.out_path_nosuffix(F.lit(identifiable))).first()[0] == f"study/series/{out}".replace("-an", "")


def test_options():
    ExtractionOptions("StudyInstanceUID").validate()
    for bad in (dict(pooled=True, identifiable=True), dict(pooled=True, no_filters=True), dict(key="PatientID"), dict(max_ids_per_message=0)):
        with pytest.raises(ValueError):
            ExtractionOptions(**{"key": "StudyInstanceUID", **bad}).validate()


def test_cohort_file(spark, tmp_path, rows):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return read_cohort(spark, str(path))

    key, df = read('SeriesInstanceUID\n 1.2 \n\n"1.3"\n1.2\n')
    assert key == "SeriesInstanceUID"
    assert [r["key_value"] for r in df.orderBy("pos").collect()] == ["1.2", "1.3", "1.2"]
    for bad in ("", "PatientID\n1\n", "SeriesInstanceUID,StudyInstanceUID\n1,2\n", "SeriesInstanceUID\n1,2\n", "SeriesInstanceUID\n", "SeriesInstanceUID\n1,\n"):
        with pytest.raises(CohortFormatError):
            read(bad)


def test_batch_function_rule(spark, rows):
    import pandas as pd

    from radloom.operators.rejectors import BatchFunction

    def odd(n: pd.Series) -> pd.Series:
        return pd.Series(["odd" if v % 2 else None for v in n])

    assert rows(apply_rejectors(spark.range(4), [BatchFunction(("id",), odd)]), "id", "reason") == [(0, None), (1, "odd"), (2, None), (3, "odd")]
