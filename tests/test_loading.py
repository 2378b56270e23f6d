import json

import pytest
from pyspark.sql import functions as F, types as T

from radloom.functions import tags as TG, text as TX
from radloom.operators import load as L, project as P, validate as VA
from radloom.plans.loading import ingest, load_relational
from radloom.sources.tables import parse_strict
from radloom.template import TemplateColumn, TemplateTable, load_tags, load_template, sql_type

TEMPLATE = load_template("""
Tables:
- TableName: study
  Columns: [{ColumnName: PatientID}, {ColumnName: StudyInstanceUID, IsPrimaryKey: true}, {ColumnName: PatientAge, AllowNulls: true}]
- TableName: series
  Columns: [{ColumnName: StudyInstanceUID}, {ColumnName: SeriesInstanceUID, IsPrimaryKey: true}, {ColumnName: Modality, AllowNulls: true}]
- TableName: image
  Columns: [{ColumnName: SeriesInstanceUID}, {ColumnName: SOPInstanceUID, IsPrimaryKey: true}, {ColumnName: RelativeFileArchiveURI}, {ColumnName: MessageGuid, AllowNulls: true}]
""")


def image(study, series, sop, patient="p1", age="030Y", path=None, **more):
    val = lambda vr, v: {"vr": vr, "val": v}
    tags = {"0020000D": val("UI", study), "0020000E": val("UI", series), "00080018": val("UI", sop), "00100020": val("LO", patient),
            "00101010": val("AS", age), "00080060": val("CS", "CT"), "7FE00010": val("OW", "AAAA"), **more}
    return (path or f"d/{sop}.dcm", study, series, sop, "guid-" + str(sop), json.dumps(tags))


def raw(spark, *images):
    return spark.createDataFrame(list(images), "DicomFilePath string, StudyInstanceUID string, SeriesInstanceUID string, "
                                               "SOPInstanceUID string, MessageGuid string, DicomDataset string")


def empty_live(spark):
    extra = [T.StructField("valid_from", T.TimestampType()), T.StructField("load_run_id", T.IntegerType())]
    return {n: spark.createDataFrame([], T.StructType(t.struct().fields + extra)) for n, t in TEMPLATE.items()}


def load(spark, batch, live, run):
    mapping = spark.createDataFrame([("p1", "anon1")], "swap string, replacement string")
    return load_relational(batch, TEMPLATE, mapping, None, live, run, F.lit(f"2024-01-0{run} 00:00:00").cast("timestamp"))


def test_isolation_end_to_end(spark, rows):
    batch = raw(spark, image("9.9", "9.9.1", "9.9.1.1"), image("1.2.3", "1.2.3.1", "a", age="030Y"), image("1.2.3", "1.2.3.1", "b", age="040Y"),
                image("8", "8.1", "8.1.1", patient="unknown"))
    out = load(spark, batch, empty_live(spark), 1)
    assert rows(out.merges["image"].live, "SOPInstanceUID") == [("9.9.1.1",)]
    assert rows(out.merges["study"].live, "PatientID", "PatientAge") == [("anon1", "030Y")]
    assert rows(out.isolated["image"], "SOPInstanceUID") == [("a",), ("b",)]
    assert out.isolated["study"].count() == 2 and out.isolated["series"].count() == 1
    assert rows(out.unmapped, "SOPInstanceUID", "fail_reason") == [("8.1.1", "No match found for 'unknown'")]


def test_second_load_archives_the_old_row(spark, rows):
    live = {n: spark.createDataFrame(m.live.collect(), m.live.schema)
            for n, m in load(spark, raw(spark, image("1", "1.1", "1.1.1"), image("2", "2.1", "2.1.1")), empty_live(spark), 1).merges.items()}
    again = load(spark, raw(spark, image("1", "1.1", "1.1.1", age="031Y"), image("3", "3.1", "3.1.1"),
                            (*image("2", "2.1", "2.1.1")[:4], "other-guid", image("2", "2.1", "2.1.1")[5])), live, 2)
    study, img = again.merges["study"], again.merges["image"]
    assert rows(study.updated, "StudyInstanceUID", "PatientAge", "load_run_id") == [("1", "031Y", 2)]
    assert rows(study.archived, "StudyInstanceUID", "PatientAge", "load_run_id") == [("1", "030Y", 1)]
    assert rows(study.live, "StudyInstanceUID", "load_run_id") == [("1", 2), ("2", 1), ("3", 2)]
    # Another message guid alone is no change.
    assert img.updated.isEmpty() and rows(img.live, "SOPInstanceUID", "load_run_id") == [("1.1.1", 1), ("2.1.1", 1), ("3.1.1", 2)]


def test_ingest(spark, rows):
    batch = raw(spark, image("1", "1.1", "a", path="x/a.dcm"), image("1", "1.1", "b", path="x/b.dcm"), image("1", " ", "c", path="x/c.dcm"),
                image("2", "2.1", "d", path="y/d.dcm"))
    lenient, strict = ingest(batch), ingest(batch, nack_if_any=True)
    assert rows(lenient.series, "DirectoryPath", "SeriesInstanceUID", "ImagesInSeries") == [("x", "1.1", 2), ("y", "2.1", 1)]
    assert rows(strict.good, "SOPInstanceUID") == [("d",)]
    assert rows(lenient.bad, "bad") == [("missing ID: SeriesInstanceUID",)]
    assert "7FE00010" not in lenient.good.first()["DicomDataset"]


def test_width(spark):
    df = spark.createDataFrame([("1342340123129473279427572495349757459347839479375974", "ok")], "AccessionNumber string, other string")
    cut = VA.enforce_width(df, {"AccessionNumber": 16}, "truncate").first()
    assert (cut["AccessionNumber"], cut["warnings"]) == ("1342340123129473", ["AccessionNumber"])
    assert VA.enforce_width(df, {"AccessionNumber": 16}, "null").first()["AccessionNumber"] is None
    assert VA.enforce_width(df, {"AccessionNumber": 16}, "corrupt").first()["corrupt"]
    assert VA.enforce_width(df, {"AccessionNumber": 16}, "none").first()["AccessionNumber"].startswith("134")


def test_bad_values(spark):
    table = TemplateTable("t", (TemplateColumn("WedgeAngleFloat", T.DecimalType(20, 5)), TemplateColumn("PatientAge")))
    df = spark.createDataFrame([("3.40282347e+038", "123Y", "123x321", "fish.dcm")], "WedgeAngleFloat string, PatientAge string, MessageGuid string, RelativeFileArchiveURI string")
    row = VA.cast_tags(df, table, "null").first()
    assert row["WedgeAngleFloat"] is None and row["PatientAge"] == "123Y"
    assert row["warnings"] == ["WedgeAngleFloat MessageGuid=123x321 file=fish.dcm"]
    assert VA.cast_tags(df, table, "corrupt").first()["corrupt"]
    with pytest.raises(Exception, match="bad value in WedgeAngleFloat"):
        VA.cast_tags(df, table, "throw").collect()


def test_flatten_from_text_and_from_map(spark):
    table = [TemplateTable("t", tuple(TemplateColumn(n) for n in ("PatientID", "ImageType", "AccessionNumber", "DerivationCodeSequence", "StudyTime", "RelativeFileArchiveURI")))]
    tags = {"00100020": {"vr": "LO", "Value": ["x", "y"]}, "00080008": {"vr": "CS", "val": "ORIGINAL\\PRIMARY"}, "00080050": {"vr": "SH"},
            "00089215": {"vr": "SQ", "val": [{"00080104": {"vr": "LO", "val": "m"}}]}}
    df = spark.createDataFrame([("p", json.dumps(tags))], "DicomFilePath string, DicomDataset string")
    for out in (P.flatten(df, table), P.flatten(df.withColumn("m", TG.parse_tags(F.col("DicomDataset"))), table, tags="m")):
        row = out.first()
        assert (row["PatientID"], row["ImageType"], row["AccessionNumber"], row["StudyTime"], row["RelativeFileArchiveURI"]) == (
            "x\\y", "ORIGINAL\\PRIMARY", None, None, "p")
        assert json.loads(row["DerivationCodeSequence"]) == tags["00089215"]["val"]


def test_variant_value(spark):
    tags = {"00100020": {"vr": "LO", "Value": ["x"]}, "00089215": {"vr": "SQ", "val": [{"00080104": {"vr": "LO", "val": "m"}}]}}
    df = spark.createDataFrame([(json.dumps(tags),)], "j string").select(F.parse_json("j").alias("v"))
    assert tuple(df.select(TG.variant_value(F.col("v"), "00100020"), TG.variant_value(F.col("v"), "00089215", "00080104")).first()) == ("x", "m")


def test_columns(spark):
    df = spark.createDataFrame([("123Y", "f.dcm", "s")], "PatientAge string, RelFileName string, AcquisitionContextSequence string")
    assert P.select_columns(df, allow=["patientage", "RelFileName"]).columns == ["PatientAge", "RelFileName"]
    assert P.select_columns(df, deny_pattern="ContextSequence").columns == ["PatientAge", "RelFileName"]


def test_template():
    assert TEMPLATE["study"].key == "StudyInstanceUID" and TEMPLATE["image"].names[0] == "SeriesInstanceUID"
    assert sql_type("varchar(16)") == (T.StringType(), 16) and sql_type("decimal(38,19)")[0] == T.DecimalType(38, 19)
    typed = load_template("Tables:\n- {TableName: t, Columns: [{ColumnName: a, Type: smallint}, {ColumnName: b, Type: 'varchar(5)'}]}")["t"]
    assert [c.dtype.simpleString() for c in typed.columns] == ["smallint", "string"] and typed.columns[1].max_length == 5


def test_modality_groups(spark):
    df = spark.createDataFrame([("MR",), ("CT",), ("other",), (None,), ("ct",)], "m string")
    assert [r[0] for r in df.select(L.modality_group(F.col("m"))).collect()] == ["MR", "CT", "OTHER", "OTHER", "OTHER"]


def test_archive_rule(spark, rows):
    batch = spark.createDataFrame([("a!1", "a", 1), ("a!2", "a", 2), ("a!3", "a", 3), ("f", None, 0), ("g", None, 0), ("b!1", "b", 1)],
                                  "DicomFilePath string, archive string, entry_pos int")
    store = spark.createDataFrame([("a!2",), ("g",)], "DicomFilePath string")
    assert rows(L.skip_existing(batch, store), "DicomFilePath") == [("a!1",), ("b!1",), ("f",)]


def test_strict_records(spark, rows):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("a", "b")])
    df = spark.createDataFrame([('{"a":"1","b":"2"}',), ('{"a":"1"}',), ('{"a":"1","b":"2","c":"3"}',), ("nonsense",), ("[1]",)], "j string")
    bad = [r["bad"] for r in parse_strict(df, F.col("j"), schema, ["b"]).collect()]
    assert bad == [None, "missing member: b", "unknown member: c", "not a JSON object", "not a JSON object"]


def test_clock_and_dates(spark):
    df = spark.createDataFrame([(3600, "20240229", "235959.5", "002W"), (90061, "20230229", "240000", "Y")], "s long, d string, t string, a string")
    got = df.select(TX.clock_duration(F.col("s")), TX.da_to_date(F.col("d")).cast("string"), TX.tm_to_seconds(F.col("t")), TX.age_in_days(F.col("a"))).collect()
    assert tuple(got[0]) == ("01:00:00", "2024-02-29", 86399, 14)
    assert tuple(got[1]) == ("1.01:01:01", None, None, None)


def test_size_guard(spark):
    df = spark.createDataFrame([("x" * 50,), ("x",)], "t string")
    assert [r["too_large"] for r in VA.guard_size(df, 30).collect()] == [True, False]


def test_lineage(spark):
    from radloom.functions import lineage

    df = spark.sql("SELECT named_struct('guid', 'b', 'original_unix', 5L, 'parents', array('a')) AS p")
    child = df.select(lineage.child_header(F.col("p"), F.lit("c"), "loader").alias("h")).select(
        "h.*", lineage.parents_to_text(F.col("h.parents")).alias("t"), lineage.is_descendant(F.col("h"), F.lit("a")).alias("of_a"),
        lineage.is_descendant(F.col("h"), F.lit("c")).alias("of_c"), lineage.text_to_parents(F.lit("")).alias("none")).first()
    assert (child["t"], child["original_unix"], child["of_a"], child["of_c"], child["none"]) == ("a->b", 5, True, False, [])


def test_unknown_columns_are_an_error(spark):
    df = spark.createDataFrame([("p", json.dumps({"00191001": {"vr": "LO", "val": "x"}, "00180081": {"vr": "DS", "val": "9"}}))], "DicomFilePath string, DicomDataset string")
    tables = list(load_template("Tables: [{TableName: t, Columns: [{ColumnName: Own, Tag: '(0019,1001)'}, {ColumnName: EchoTime}, {ColumnName: '00180081'}]}]").values())
    assert tuple(P.flatten(df, tables).drop("RelativeFileArchiveURI").first()) == ("x", "9", "9")
    odd = [TemplateTable("t", (TemplateColumn("Nope"), TemplateColumn("Neither"), TemplateColumn("EchoTime")))]
    with pytest.raises(ValueError, match="Neither, Nope"):
        P.flatten(df, odd)
    assert P.flatten(df, odd, tags_of=load_tags("{Nope: '00191001', Neither: '00191002'}")).first()["Nope"] == "x"
    with pytest.raises(ValueError, match="Nope"):
        P.elevate(df.withColumn("tags", TG.parse_tags(F.col("DicomDataset"))), [P.Elevation("c", ("Nope",))])


def test_texts_that_are_absent_are_no_copies(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, DicomDataset string")
    assert rows(L.dedupe_batch(df), "i") == [(1,), (3,), (4,)]


def test_isolation_leaves_no_orphans(spark, rows):
    study = spark.createDataFrame([("1", "a"), ("2", "a")], "StudyInstanceUID string, x string")
    series = spark.createDataFrame([("1", "1.1"), ("1", "1.2"), ("2", "2.1")], "StudyInstanceUID string, SeriesInstanceUID string")
    images = spark.createDataFrame([("1.1", "i", 1), ("1.1", "i", 2), ("1.1", "j", 1), ("1.2", "k", 1), ("2.1", "l", 1), ("9.9", "m", 1)],
                                   "SeriesInstanceUID string, SOPInstanceUID string, n int")
    out = L.isolate(study, series, images)
    assert rows(out.good["study"], "StudyInstanceUID") == [("2",)] and rows(out.good["series"], "SeriesInstanceUID") == [("2.1",)]
    assert rows(out.good["image"], "SOPInstanceUID") == [("l",), ("m",)]
    assert [out.bad[n].count() for n in ("study", "series", "image")] == [1, 2, 4]


def test_merge_keeps_what_the_stage_lacks(spark, rows):
    live = spark.createDataFrame([("a", "1", "keep"), ("b", "1", "keep")], "k string, v string, extra string").selectExpr(
        "*", "timestamp'2020-01-01' valid_from", "1 load_run_id")
    stage = spark.createDataFrame([("a", "2"), ("c", "1"), ("c", "3"), (None, "4"), ("d", "5")], "k string, v string")
    out = L.merge_live(live, stage, "k", 2, F.lit("2024-01-01").cast("timestamp"))
    assert rows(out.live, "k", "v", "extra") == [("a", "2", "keep"), ("b", "1", "keep"), ("d", "5", None)]
    assert rows(out.refused, "k", "v") == [("c", "1"), ("c", "3"), (None, "4")]


def test_a_batch_is_split_without_rows_in_both(spark, rows):
    from radloom.streaming.flows import split_load

    checked = spark.createDataFrame([(1, None, None), (2, "a", "broken"), (3, "a", None), (4, "b", None)], "i int, k string, bad string")
    good, bad = split_load(checked, "k")
    assert rows(good, "i") == [(4,)] and rows(bad, "i", "bad") == [
        (1, "no key"), (2, "broken"), (3, "shares its key with a bad row")]
