import pytest
from pyspark.sql import functions as F

from radloom.operators import jobs as J, validate as VA
from radloom.operators.files import plan_files
from radloom.plans.reporting import CompletedJobs, write_reports
from radloom.streaming.microbatch import read_events, run, split_handler, stream_dedupe
from radloom.streaming.tracker import EVENT_SCHEMA, progress, track_handler

REPORT = "[{'Parts': [{'Classification': 3, 'Offset': 0, 'Word': 'FOO'}], 'Resource': '/foo1.dcm', 'ResourcePrimaryKey': '1.2.3.4', 'ProblemField': 'ScanOptions', 'ProblemValue': 'FOO'}]"
INFO = "job_id string, key_value string, part int, files array<string>, reasons map<string,bigint>"
STATUS = "job_id string, file_path string, output_path string, status string, message string"
VERIFY = "job_id string, file_path string, output_path string, status string, report string"


def bumpy(spark):
    """One valid file, one rejected, one not anonymised, one with personal data."""
    jobs = spark.createDataFrame([("j", 2, False)], "job_id string, key_count long, identifiable boolean")
    infos = spark.createDataFrame([("j", "series-1", 0, ["s1/a-an.dcm"], {"burnt-in text": 1}),
                                   ("j", "series-2", 0, ["s2/a-an.dcm", "s2/b-an.dcm"], {})], INFO)
    failed = spark.createDataFrame([("j", "s2/a.dcm", "s2/a-an.dcm", "ErrorWontRetry", "Couldn't anonymise")], STATUS)
    screened = spark.createDataFrame([
        ("j", "s1/a.dcm", "s1/a-an.dcm", "NotIdentifiable", "[]"),
        ("j", "s2/b.dcm", "s2/b-an.dcm", "IsIdentifiable", "\n[{'Parts': [], 'Resource': 'x', 'ResourcePrimaryKey': '1.2.3.4', 'ProblemField': 'ScanOptions', 'ProblemValue': 'FOO'}]")], VERIFY)
    return jobs, infos, J.statuses(failed, screened)


def test_bumpy_road(spark, rows):
    jobs, infos, done = bumpy(spark)
    status = J.job_status(J.job_counts(jobs, J.info_counts(infos), done))
    assert rows(status, "infos", "expected", "statuses", "status") == [(2, 3, 3, "ReadyForChecks")]
    assert rows(J.complete_jobs(status), "status") == [("Completed",)]
    assert rows(J.report_rejected(J.rejections_of(infos)), "ExtractionKey", "Count", "Reason") == [("series-1", 1, "burnt-in text")]
    assert rows(J.report_errors(jobs, done), "DicomFilePath", "Reason") == [("s2/a.dcm", "Couldn't anonymise")]
    assert rows(J.report_verification(jobs, done), "Resource", "ProblemField", "PartWords") == [("s2/b-an.dcm", "ScanOptions", "")]


@pytest.mark.parametrize("before,key_count,infos,expected,done,after", [
    (None, 2, 1, 1, 1, "WaitingForCollectionInfo"), (None, 2, 3, 3, 3, "WaitingForCollectionInfo"), (None, 2, 2, 3, 2, "WaitingForStatuses"),
    (None, 2, 2, 3, 4, "WaitingForStatuses"), (None, 2, 2, 3, 3, "ReadyForChecks"), ("WaitingForStatuses", 2, 3, 3, 3, "ReadyForChecks"),
    ("Failed", 2, 2, 3, 3, "Failed"), ("Completed", 2, 2, 3, 3, "Completed")])
def test_states(spark, before, key_count, infos, expected, done, after):
    df = spark.createDataFrame([("j", key_count, infos, expected, done)], "job_id string, key_count long, infos long, expected long, statuses long")
    assert J.job_status(df if before is None else df.withColumn("status", F.lit(before))).first()["status"] == after


def test_all_rejected_job_fails(spark):
    df = spark.createDataFrame([("j", 1, 1, 0, 0)], "job_id string, key_count long, infos long, expected long, statuses long")
    assert J.complete_jobs(J.job_status(df)).first()["status"] == "Failed"


def completed(spark, identifiable=False):
    jobs = spark.createDataFrame([("d0b6", "1234-5678", "1234-5678/extractions/test-1", "SeriesInstanceUID", None, 123, "testUser", identifiable, False,
                                   "2021-05-01T10:00:00", "2021-05-01T11:00:00")],
                                 "job_id string, project string, directory string, key_tag string, modality string, key_count long, user_name string, "
                                 "identifiable boolean, no_filters boolean, submitted string, completed string")
    jobs = jobs.withColumn("submitted_at", F.to_timestamp("submitted")).withColumn("completed_at", F.to_timestamp("completed"))
    infos = spark.createDataFrame([("d0b6", "1.2.3.4", 0, [], {"Some error": 123}), ("d0b6", "9", 0, [], {})], INFO)
    failed = spark.createDataFrame([("d0b6", "p1/gone.dcm", None, "FileMissing", "not there"), ("d0b6", "1/2/3.dcm", None, "ErrorWontRetry", "Corrupt file"),
                                    ("d0b6", "1/2/c.dcm", "o", "Copied", None)], STATUS)
    screened = spark.createDataFrame([("d0b6", "1/2/3.dcm", "1/2/3-an.dcm", "IsIdentifiable", REPORT), ("d0b6", "1/2/4.dcm", "1/2/4-an.dcm", "ErrorWontRetry", "oops, no")], VERIFY)
    return CompletedJobs(jobs, infos, J.statuses(failed, screened))


def read(folder):
    return "".join(p.read_text() for p in sorted([*folder.glob("header*"), *folder.glob("part-*")]))


README = """# Extraction validation report for 1234-5678 test-1

Job info:
-   Job submitted at:             2021-05-01T10:00:00
-   Job completed at:             2021-05-01T11:00:00
-   Job duration:                 01:00:00
-   Job extraction id:            d0b6
-   Extraction tag:               SeriesInstanceUID
-   Extraction modality:          Unspecified
-   Requested identifier count:   123
-   User name:                    testUser
-   Identifiable extraction:      {}
-   Filtered extraction:          Yes
"""


def test_report_files(spark, tmp_path):
    write_reports(completed(spark), "d0b6", str(tmp_path))
    target = tmp_path / "1234-5678" / "extractions" / "reports" / "test-1"
    assert read(target / "README").rstrip("\n") == README.format("No").rstrip("\n")
    assert read(target / "rejected_files") == "ExtractionKey,Count,Reason\n1.2.3.4,123,Some error\n"
    assert read(target / "processing_errors") == ("DicomFilePath,Reason\np1/gone.dcm,Missing\n1/2/3.dcm,Corrupt file\n"
                                                  "1/2/4.dcm,\"oops, no\"\np1/gone.dcm,not there\n")
    assert read(target / "verification_failures") == (
        "Resource,ResourcePrimaryKey,ProblemField,ProblemValue,PartWords,PartClassifications,PartOffsets\n1/2/3-an.dcm,1.2.3.4,ScanOptions,FOO,FOO,Person,0\n")
    with pytest.raises(ValueError, match="already exists"):
        write_reports(completed(spark), "d0b6", str(tmp_path))
    with pytest.raises(ValueError, match="no completed document"):
        write_reports(completed(spark), "other", str(tmp_path))


def test_identifiable_reports(spark, tmp_path):
    write_reports(completed(spark, identifiable=True), "d0b6", str(tmp_path), "\r\n")
    target = tmp_path / "1234-5678" / "extractions" / "reports" / "test-1"
    assert not (target / "verification_failures").exists()
    assert (target / "processing_errors").is_dir() and b"".join(p.read_bytes() for p in sorted((target / "processing_errors").glob("[hp]*"))) == b"DicomFilePath,Reason\r\np1/gone.dcm,Missing\r\n"
    assert "Identifiable extraction:      Yes" in read(target / "README")


def test_rejection_order(spark):
    infos = spark.createDataFrame([("j", "a", 0, [], {"x": 1, "y": 5}), ("j", "b", 0, [], {"z": 9}), ("j", "c", 0, [], {})], INFO)
    got = [tuple(r) for r in J.report_rejected(J.rejections_of(infos)).drop("job_id").collect()]
    assert got == [("b", 9, "z"), ("a", 5, "y"), ("a", 1, "x")]


def test_event_checks(spark, rows):
    failed = spark.createDataFrame([("None",), ("Anonymised",), ("FileMissing",), (None,)], "status string")
    assert [r["bad"] for r in VA.validate_status(failed).collect()] == ["status was None", "success on the failure route", None, "status was None"]
    screened = spark.createDataFrame([("a", "IsIdentifiable", "[]"), (" ", "NotIdentifiable", "[]"), ("a", "NotIdentifiable", " "),
                                      ("a", "NotIdentifiable", "broken"), ("a", "ErrorWontRetry", "free text"), ("a", "IsIdentifiable", REPORT)],
                                     "output_path string, status string, report string")
    assert [r["bad"] for r in VA.validate_verification(screened).collect()] == [
        "identifiable without failures", "no output path", "no report", "report is not JSON", None, None]


def test_file_plan(spark, rows):
    wanted = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "file_path string, identifiable boolean")
    here = spark.createDataFrame([("a",), ("a",)], "file_path string")
    assert rows(plan_files(wanted, here, True), "file_path", "bad", "status", "message") == [
        ("a", None, "Copied", None), ("b", None, "FileMissing", "Could not find 'b'"), ("c", "wrong route", None, None)]


# --- streams -------------------------------------------------------------------------

def events(spark, path, *rows_):
    spark.createDataFrame(list(rows_), EVENT_SCHEMA).coalesce(1).write.mode("append").json(str(path))


def test_tracker_over_batches(spark, tmp_path):
    source, counts, late, finished = (str(tmp_path / n) for n in ("source", "counts", "late", "finished"))
    schema = spark.createDataFrame([], EVENT_SCHEMA).schema
    handler = track_handler(counts, late, finished)

    def step(*rows_):
        events(spark, source, *rows_)
        run(read_events(spark, source, schema), handler, str(tmp_path / "progress")).awaitTermination()

    step(("j", "request", 1, None, None), ("j", "collection", None, 0, 2), ("k", "status", None, None, None))
    step(("j", "collection", None, 1, 1), ("j", "status", None, None, None))
    state = lambda: {r["job_id"]: r["status"] for r in spark.read.schema("job_id string, status string").option("recursiveFileLookup", "true").parquet(finished).collect()}
    assert state() == {}
    step(("j", "status", None, None, None), ("j", "status", None, None, None), ("r", "request", 1, None, None), ("r", "collection", None, 0, 0))
    assert state() == {"j": "Completed", "r": "Failed"}
    step(("j", "status", None, None, None), ("k", "request", 1, None, None), ("k", "collection", None, 0, 1))
    assert state() == {"j": "Completed", "r": "Failed", "k": "Completed"}
    letters = spark.read.option("recursiveFileLookup", "true").parquet(late).collect()
    assert [(r["reason"], '"job_id":"j"' in r["record"]) for r in letters] == [("job already completed", True)]
    # A repeated batch changes nothing.
    handler(spark.read.schema(schema).json(source).where("job_id = 'j' AND kind = 'status'").limit(1), 3)
    assert state()["j"] == "Completed"


def test_native_streaming_state(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], EVENT_SCHEMA).schema
    events(spark, source, ("j", "request", 1, None, None), ("j", "collection", None, 0, 1))
    events(spark, source, ("j", "status", None, None, None))
    (progress(read_events(spark, source, schema, max_files=1)).writeStream.format("memory").queryName("tracked").outputMode("update")
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    assert {r["status"] for r in spark.table("tracked").collect()} >= {"ReadyForChecks"}


def test_bad_rows_go_to_the_dead_letters(spark, tmp_path, rows):
    source, good, bad = (str(tmp_path / n) for n in ("in", "good", "bad"))
    spark.createDataFrame([("p1", "p1/x"), ("p2", "other/x")], "project string, directory string").write.json(source)
    schema = spark.createDataFrame([], "project string, directory string").schema
    handler = split_handler(VA.validate_requests, good, bad, lambda df: df.withColumn("seen", F.lit(True)))
    run(read_events(spark, source, schema), handler, str(tmp_path / "cp")).awaitTermination()
    read_all = lambda p: spark.read.option("recursiveFileLookup", "true").parquet(p)
    assert rows(read_all(good), "project", "seen") == [("p1", True)]
    assert [r["reason"] for r in read_all(bad).collect()] == ["ExtractionDirectory"]


def test_stream_dedupe(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:00:30' UNION ALL SELECT 'b', timestamp'2024-01-01 00:00:31'") \
         .coalesce(1).write.json(source)
    stream = read_events(spark, source, spark.createDataFrame([], "k string, ts timestamp").schema)
    (stream_dedupe(stream, "k", "ts", "10 minutes").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    assert rows(spark.table("once"), "k") == [("a",), ("b",)]


def test_flows_over_streams(spark, tmp_path, rows):
    import json

    from radloom.functions.tags import parse_tags
    from radloom.operators.rejectors import DynamicRules
    from radloom.operators.screening import RuleClassifier, default_rules
    from radloom.streaming import flows

    source = str(tmp_path / "in")
    tags = lambda p: json.dumps({"00100020": {"vr": "LO", "val": p}})
    spark.createDataFrame([("a", True, "0101010101", tags("p1")), ("b", True, "fine", tags("p2"))], "resource string, present boolean, t string, tags string").write.json(source)
    stream = read_events(spark, source, spark.read.json(source).schema).withColumn("tags", parse_tags(F.col("tags")))
    mapping = spark.createDataFrame([("p1", "x1")], "swap string, replacement string")

    def result(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert rows(result(flows.swap_stream(stream, mapping), "swapped"), "resource", "fail_reason") == [("a", None), ("b", "No match found for 'p2'")]
    assert rows(result(flows.screen_stream(stream, RuleClassifier(("t",), tuple(default_rules()))), "screened"), "resource", "status") == [("a", "IsIdentifiable"), ("b", "NotIdentifiable")]
    rules = DynamicRules.from_yaml('[{when: "t = \'fine\'", reason: "\'dull\'"}]')
    assert rows(result(flows.reject_stream(stream, [rules]), "judged"), "resource", "reason") == [("a", None), ("b", "dull")]


def test_load_and_reprocess_handlers(spark, tmp_path, rows):
    from radloom.streaming.flows import load_handler, reprocess_handler

    read_all = lambda n: spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / n))
    at = lambda n: str(tmp_path / n)
    ids = "StudyInstanceUID string, SeriesInstanceUID string, SOPInstanceUID string"
    batch = spark.createDataFrame([("1", "1", "1", "t1"), ("1", "1", "1", "t1"), ("1", " ", "2", "t2"), ("1", "1", "3", "t3")], ids + ", DicomDataset string")
    handler = load_handler(VA.require_ids, "SOPInstanceUID", at("good"), at("bad"))
    handler(batch, 0)
    handler(batch, 0)
    assert rows(read_all("good"), "SOPInstanceUID") == [("1",), ("3",)] and read_all("bad").count() == 1
    docs = spark.createDataFrame([(("p", 5), "1", "1", "1", "t"), (None, "1", "1", "2", "t"), (("p", None), "1", "1", "3", " "), (("q", None), "2", "1", "4", "t")],
                                 f"header struct<DicomFilePath:string,DicomFileSize:bigint>, {ids}, dataset string")
    reprocess_handler('{"find": {"StudyInstanceUID": "1"}}', at("sent"), at("failed"), at("counts"))(docs, 7)
    assert [tuple(r) for r in read_all("counts").collect()] == [(1, 2)]
    assert rows(read_all("sent"), "DicomFilePath", "DicomFileSize") == [("p", 5)]
    assert rows(read_all("failed"), "reason") == [("message was not valid",), ("no header",)]


def test_closing_jobs(spark, rows):
    from radloom.plans.reporting import close_jobs

    jobs, infos, done = bumpy(spark)
    jobs = jobs.union(spark.createDataFrame([("waiting", 5, False), ("rejected", 1, False)], jobs.schema))
    infos = infos.union(spark.createDataFrame([("rejected", "k", 0, [], {"r": 3}), ("waiting", "k", 0, ["f"], {})], INFO))
    completed, failed = close_jobs(jobs, infos, done, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert rows(completed.jobs, "job_id", "status") == [("j", "Completed")] and rows(failed, "job_id") == [("rejected",)]
    assert (completed.infos.count(), completed.statuses.count()) == (2, 3)


def test_states_are_kept_between_batches(spark, tmp_path):
    state, late, finished = (str(tmp_path / n) for n in ("state", "late", "finished"))
    handler = track_handler(state, late, finished)
    deal = lambda n, *rows_: handler(spark.createDataFrame(list(rows_), EVENT_SCHEMA), n)
    now = lambda n: {r["job_id"]: r["status"] for r in spark.read.parquet(f"{state}/batch={n:012d}").collect()}
    deal(0, ("f", "request", 1, None, None), ("f", "collection", None, 0, 0), ("w", "request", 1, None, None), ("w", "collection", None, 0, 2))
    assert now(0) == {"f": "Failed", "w": "WaitingForStatuses"}
    deal(1, ("f", "collection", None, 1, 1), ("f", "status", None, None, None), ("w", "collection", None, 0, 1))
    assert now(1) == {"f": "Failed", "w": "WaitingForStatuses"}
    deal(2, *[("w", "status", None, None, None)] * 3)
    deal(2, *[("w", "status", None, None, None)] * 3)
    assert now(2) == {"f": "Failed", "w": "Completed"}
