"""Job tracking and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions.ordering import with_position
from radloom.operators import jobs as J, validate as VA
from radloom.operators.files import plan_files
from radloom.session import pin
from radloom.streaming.tracker import STATE_SCHEMA, advance, progress
from workload import views as V
from workload.registry import query

_COUNTS = ("job_id", "key_count", "infos", "expected", "statuses")


def _done(t):
    return J.statuses(V.file_status(t), V.verification(t))


def _status(t):
    return J.job_status(J.job_counts(V.jobs(t), J.info_counts(V.infos(t)), _done(t)))


@query("job_counts", f"WITH {V.SQL_JOBS} SELECT job_id, key_count, infos, expected, statuses FROM status")
def job_counts(t):
    return J.job_counts(V.jobs(t), J.info_counts(V.infos(t)), _done(t)).select(*_COUNTS)


@query("job_status", f"WITH {V.SQL_JOBS} SELECT job_id, status FROM status")
def job_status(t):
    return _status(t).select("job_id", "status")


@query("complete_jobs", f"""WITH {V.SQL_JOBS} SELECT job_id, CASE WHEN status = 'ReadyForChecks' AND (infos = 0 OR statuses = 0) THEN 'Failed'
  WHEN status = 'ReadyForChecks' THEN 'Completed' ELSE status END AS status FROM status""")
def complete_jobs(t):
    return J.complete_jobs(_status(t)).select("job_id", "status")


@query("track_jobs", f"WITH {V.SQL_JOBS} SELECT job_id, key_count, infos, expected, statuses, status FROM status")
def track_jobs(t):
    """The tracker's running state over one table of interleaved events."""
    none = F.lit(None).cast("long")
    requests = V.jobs(t).select("job_id", F.lit("request").alias("kind"), "key_count", F.lit(None).cast("int").alias("part"), none.alias("files"))
    collections = V.infos(t).select("job_id", F.lit("collection").alias("kind"), none.alias("key_count"), "part", F.size("files").cast("long").alias("files"))
    done = _done(t).select("job_id", F.lit("status").alias("kind"), none.alias("key_count"), F.lit(None).cast("int").alias("part"), none.alias("files"))
    return progress(requests.unionByName(collections).unionByName(done))


def _dealt(t, n):
    """The interleaved events in ``n`` batches: those of a job come in the order of their kinds, spread by their number."""
    none = F.lit(None).cast("long")
    e = V.job_events(t)
    kind = F.when(F.col("event_type").isin("view", "signup"), "collection").otherwise("status")
    files = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 2).cast("long")
    rows = e.select("job_id", kind.alias("kind"), none.alias("key_count"), F.when(kind == "collection", F.lit(0)).alias("part"), files.alias("files"),
                    (F.col("event_id") % n).alias("batch"))
    asked = e.groupBy("job_id").agg(F.count_if(F.col("event_type").isin("view", "signup")).alias("key_count")).select(
        "job_id", F.lit("request").alias("kind"), "key_count", F.lit(None).cast("int").alias("part"), none.alias("files"), F.lit(0).alias("batch"))
    return rows.unionByName(asked)


def _sql_batches(n):
    """The state machine over ``n`` batches, one step of SQL each."""
    steps = [f"""{V.SQL_EVENTS}, asked AS (SELECT job_id, COUNT(*) FILTER (event_type IN ('view', 'signup')) AS key_count FROM ev GROUP BY 1),
      s0 AS (SELECT job_id, 0::BIGINT AS infos, 0::BIGINT AS expected, 0::BIGINT AS statuses, 'WaitingForCollectionInfo' AS status FROM asked)"""]
    for i in range(n):
        steps.append(f"""c{i} AS (SELECT job_id, COUNT(*) FILTER (event_type IN ('view', 'signup')) AS infos,
          COALESCE(SUM(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 END), 0)::BIGINT AS expected,
          COUNT(*) FILTER (event_type NOT IN ('view', 'signup')) AS statuses FROM ev WHERE event_id % {n} = {i} GROUP BY 1),
        t{i} AS (SELECT s.job_id, key_count, s.status AS before, CASE WHEN s.status IN ('Failed', 'Completed') THEN 0 ELSE 1 END AS more,
          s.infos + more * COALESCE(c.infos, 0) AS infos, s.expected + more * COALESCE(c.expected, 0) AS expected,
          s.statuses + more * COALESCE(c.statuses, 0) AS statuses FROM s{i} s JOIN asked USING (job_id) LEFT JOIN c{i} c USING (job_id)),
        m{i} AS (SELECT *, CASE WHEN before IN ('Failed', 'Completed') THEN before WHEN before = 'WaitingForStatuses' OR key_count = infos
          THEN CASE WHEN expected = statuses THEN 'ReadyForChecks' ELSE 'WaitingForStatuses' END ELSE 'WaitingForCollectionInfo' END AS moved FROM t{i}),
        s{i + 1} AS (SELECT job_id, infos, expected, statuses, CASE WHEN moved = 'ReadyForChecks' THEN CASE WHEN infos = 0 OR statuses = 0
          THEN 'Failed' ELSE 'Completed' END ELSE moved END AS status FROM m{i})""")
    return f"WITH {', '.join(steps)} SELECT * FROM s{n}"


@query("track_batches", _sql_batches(4))
def track_batches(t):
    """The tracker's stored state after four batches; a state once reached is kept."""
    events = _dealt(t, 4)
    state = t.spark.createDataFrame([], STATE_SCHEMA)
    for i in range(4):
        state = pin(advance(state, events.where(F.col("batch") == i)))
    return state.drop("key_count")


@query("job_status_stored", f"""WITH {V.SQL_JOBS}, stored AS (SELECT *, CASE WHEN key_count % 3 = 0 THEN 'Failed' WHEN key_count % 3 = 1
  THEN 'WaitingForStatuses' ELSE 'WaitingForCollectionInfo' END AS before FROM status)
SELECT job_id, CASE WHEN before = 'Failed' THEN before WHEN before = 'WaitingForStatuses' OR key_count = infos
  THEN CASE WHEN expected = statuses THEN 'ReadyForChecks' ELSE 'WaitingForStatuses' END ELSE before END AS status FROM stored""")
def job_status_stored(t):
    """States that follow from the counts and an earlier stored state."""
    counts = J.job_counts(V.jobs(t), J.info_counts(V.infos(t)), _done(t))
    before = F.when(F.col("key_count") % 3 == 0, "Failed").when(F.col("key_count") % 3 == 1, "WaitingForStatuses").otherwise("WaitingForCollectionInfo")
    return J.job_status(counts.withColumn("status", before)).select("job_id", "status")


@query("late_events", f"""WITH {V.SQL_JOBS}, done AS (SELECT job_id FROM status WHERE status = 'ReadyForChecks' AND infos > 0 AND statuses > 0)
SELECT event_id, job_id IN (FROM done) AS late FROM ev""")
def late_events(t):
    """Every event, told apart by whether its job is already completed."""
    completed = J.complete_jobs(_status(t)).where(F.col("status") == "Completed")
    timely, late = J.split_late(V.job_events(t), completed)
    return timely.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


_SQL_REJECTIONS = f"""{V.SQL_EVENTS}, rej AS (
  SELECT job_id, CAST(event_id AS VARCHAR) AS key_value, 'rejected - low' AS reason, CAST(1 + k AS BIGINT) AS n FROM ev
    WHERE event_type IN ('view', 'signup') AND value > 10
  UNION ALL SELECT job_id, CAST(event_id AS VARCHAR), 'rejected - high', 2 FROM ev WHERE event_type IN ('view', 'signup') AND value > 10)"""


@query("report_rejected", f"WITH {_SQL_REJECTIONS} SELECT job_id, key_value AS ExtractionKey, n AS Count, reason AS Reason FROM rej")
def report_rejected(t):
    return J.report_rejected(J.rejections_of(V.infos(t)))


@query("rejected_files", f"""WITH {_SQL_REJECTIONS}, tot AS (SELECT job_id, key_value, SUM(n) AS total FROM rej GROUP BY ALL)
SELECT job_id || ' ' || key_value || ' ' || reason AS row, row_number() OVER (ORDER BY job_id, total DESC, key_value, n DESC, reason) - 1 AS pos
FROM rej JOIN tot USING (job_id, key_value)""")
def rejected_files(t):
    """The order of the rejections report, as explicit positions."""
    report = J.report_rejected(J.rejections_of(V.infos(t)), with_position)
    return report.select(F.concat_ws(" ", "job_id", "ExtractionKey", "Reason").alias("row"), "pos")


@query("report_errors", f"""WITH {V.SQL_JOBS}, st AS (SELECT job_id, event_id || '.dcm' AS path, k < 50 AS missing, k >= 50 AND k < 60 AS copied,
    CASE WHEN k < 50 THEN 'Could not find ' || event_id || '.dcm' ELSE 'Not de-identified' END AS message FROM ev WHERE event_type = 'error'),
  scr AS (SELECT job_id, event_id || '.dcm' AS path FROM ev WHERE event_type IN ('click', 'purchase') AND value < 3)
SELECT job_id, CAST(0 AS INTEGER) AS section, path AS DicomFilePath, 'Missing' AS Reason FROM st WHERE missing
UNION ALL SELECT job_id, 1, path, message FROM st JOIN jobs USING (job_id) WHERE NOT copied AND NOT identifiable
UNION ALL SELECT job_id, 1, path, 'File could not be scanned' FROM scr JOIN jobs USING (job_id) WHERE NOT identifiable""")
def report_errors(t):
    return J.report_errors(V.jobs(t), _done(t))


@query("report_verification", f"""WITH {V.SQL_JOBS} SELECT job_id, event_id || '-an.dcm' AS Resource, CAST(event_id AS VARCHAR) AS ResourcePrimaryKey,
  'ScanOptions' AS ProblemField, 'Alder of Leith' AS ProblemValue, 'Alder###Leith' AS PartWords, 'Person###Location' AS PartClassifications,
  k || '###9' AS PartOffsets FROM ev JOIN jobs USING (job_id) WHERE event_type = 'purchase' AND value >= 3 AND NOT identifiable""")
def report_verification(t):
    return J.report_verification(V.jobs(t), _done(t))


_FACT = lambda label, value: f"'-   ' || rpad('{label}', 30, ' ') || {value}"
_TWO = lambda number: f"lpad(CAST(CAST(floor({number}) AS BIGINT) AS VARCHAR), 2, '0')"
_LINES = ", ".join([
    _FACT("Job submitted at:", "strftime(submitted_at, '%Y-%m-%dT%H:%M:%S')"),
    _FACT("Job completed at:", "strftime(completed_at, '%Y-%m-%dT%H:%M:%S')"),
    _FACT("Job duration:", f"{_TWO('s / 3600')} || ':' || {_TWO('s % 3600 / 60')} || ':' || {_TWO('s % 60')}"),
    _FACT("Job extraction id:", "job_id"), _FACT("Extraction tag:", "'StudyInstanceUID'"),
    _FACT("Extraction modality:", "'Unspecified'"), _FACT("Requested identifier count:", "key_count"),
    _FACT("User name:", "'u' || user_id"),
    _FACT("Identifiable extraction:", "CASE WHEN identifiable THEN 'Yes' ELSE 'No' END"),
    _FACT("Filtered extraction:", "CASE WHEN key_count > 1 THEN 'No' ELSE 'Yes' END")])


@query("report_readme", f"""WITH {V.SQL_JOBS}, secs AS (SELECT *, CAST(epoch(date_trunc('second', completed_at)) - epoch(date_trunc('second', submitted_at)) AS BIGINT) AS s FROM jobs)
SELECT job_id, concat_ws(chr(10), '# Extraction validation report for P' || user_id || ' ' || user_id, '', 'Job info:', {_LINES}, '') AS readme FROM secs""")
def report_readme(t):
    jobs = V.jobs(t).select(
        "job_id", "key_count", "identifiable", "submitted_at", "completed_at", F.concat(F.lit("P"), F.col("user_id")).alias("project"),
        F.concat_ws("/", F.lit("x/extractions"), F.col("user_id")).alias("directory"), F.lit("StudyInstanceUID").alias("key_tag"),
        F.lit(None).cast("string").alias("modality"), F.concat(F.lit("u"), F.col("user_id")).alias("user_name"),
        (F.col("key_count") > 1).alias("no_filters"))
    return J.report_readme(jobs)


@query("validate_events", """SELECT event_id, CASE
  WHEN event_type = 'error' THEN CASE WHEN k < 30 THEN 'status was None' WHEN k < 60 THEN 'success on the failure route' END
  WHEN k < 10 THEN 'no output path' WHEN k < 20 THEN 'no report'
  WHEN k < 30 AND event_type = 'purchase' THEN 'identifiable without failures' WHEN k >= 90 AND event_type <> 'view' THEN 'report is not JSON' END AS bad
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def validate_events(t):
    e = V.job_events(t)
    failed = e.where(F.col("event_type") == "error").select(
        "event_id", F.when(F.col("k") < 30, F.lit(None)).when(F.col("k") < 60, "Anonymised").otherwise("FileMissing").alias("status"))
    screened = e.where(F.col("event_type") != "error").select(
        "event_id",
        F.when(F.col("event_type") == "purchase", "IsIdentifiable").when(F.col("event_type") == "view", "ErrorWontRetry").otherwise("NotIdentifiable").alias("status"),
        F.when(F.col("k") < 10, " ").otherwise("a-an.dcm").alias("output_path"),
        F.when(F.col("k") < 20, "").when(F.col("k") < 30, "[]").when(F.col("k") >= 90, "could not be scanned")
         .otherwise("[{'Parts': [], 'Resource': 'x', 'ProblemField': 'y', 'ProblemValue': 'z'}]").alias("report"))
    return VA.validate_status(failed).select("event_id", "bad").unionByName(VA.validate_verification(screened).select("event_id", "bad"))


@query("plan_files", """WITH inv AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS p FROM lineitem)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'wrong route' END AS bad,
  CASE WHEN o_orderstatus = 'P' THEN NULL WHEN CAST(o_orderkey AS VARCHAR) IN (FROM inv) THEN 'Anonymised' ELSE 'FileMissing' END AS status,
  CASE WHEN o_orderstatus <> 'P' AND CAST(o_orderkey AS VARCHAR) NOT IN (FROM inv) THEN 'Could not find ''' || o_orderkey || '''' END AS message FROM orders""")
def planned_files(t):
    """Studies as files: those without images are missing on disk."""
    wanted = t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("file_path"),
                             (F.col("o_orderstatus") == "P").alias("identifiable"))
    here = t.lineitem.select(F.col("l_orderkey").cast("string").alias("file_path"))
    return plan_files(wanted, here, identifiable_route=False).select("o_orderkey", "bad", "status", "message")
