"""The supplied tables in the roles of an imaging archive, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radloom.schemas import PATH, SERIES, SOP, STUDY, Catalogue
from radloom.operators.rejectors import Blacklist, ColumnValues, DynamicRules

# ---- images: line items as images, orders as studies, parts give the modality ----


def _sop():
    return F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def _flags():
    return [
        (F.col("l_returnflag") != "R").alias("IsOriginal"),
        (F.col("l_linestatus") == "F").alias("IsPrimary"),
        (F.col("l_discount") < 0.09).alias("IsExtractableToDisk"),
        F.when(F.col("l_tax") >= 0.05, "Withheld by the site").when(F.col("l_tax") >= 0.03, "WITHHELD by the SITE")
         .alias("IsExtractableToDisk_Reason"),
    ]


def _uids():
    day = F.date_format("l_shipdate", "yyyy/MM/dd")
    return [
        F.col("l_orderkey").cast("string").alias(STUDY),
        F.concat_ws(".", "l_orderkey", "l_suppkey").alias(SERIES),
        _sop().alias(SOP),
        F.concat_ws("/", day, F.col("l_orderkey"), F.concat(_sop(), F.lit(".dcm"))).alias(PATH),
    ]


def files(t) -> DataFrame:
    """Image rows without patient and modality: no join needed."""
    return t.lineitem.select(*_uids(), *_flags())


def images(t) -> DataFrame:
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_custkey").cast("string").alias("PatientID"), *_uids(), F.col("p_type").alias("Modality"), *_flags()))


def patient_files(t, parts: int | None = None) -> DataFrame:
    """Image rows with patient but without modality, joined on the study's identifier, by which they are looked up.

    With ``parts`` they come in so many, a study in one of them, each a few runs sorted by study: short ones sort in memory.
    """
    study = lambda c: F.col(c).cast("string")
    lines, orders = t.lineitem, t.orders
    if parts is not None:
        lines, orders = (df.repartition(parts * 8, study(key)) for df, key in ((lines, "l_orderkey"), (orders, "o_orderkey")))
    joined = (lines.join(orders, study("l_orderkey") == study("o_orderkey"))
              .select(F.col("o_custkey").cast("string").alias("PatientID"), *_uids(), *_flags()))
    return joined if parts is None else joined.coalesce(parts)


SQL_UIDS = """CAST(l_orderkey AS VARCHAR) AS StudyInstanceUID,
  l_orderkey || '.' || l_suppkey AS SeriesInstanceUID,
  l_orderkey || '.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber AS SOPInstanceUID,
  strftime(l_shipdate, '%Y/%m/%d') || '/' || l_orderkey || '/' || l_orderkey || '.' || l_partkey || '.' || l_suppkey
    || '.' || l_linenumber || '.dcm' AS RelativeFileArchiveURI,
  l_returnflag <> 'R' AS IsOriginal, l_linestatus = 'F' AS IsPrimary, l_discount < 0.09 AS IsExtractableToDisk,
  CASE WHEN l_tax >= 0.05 THEN 'Withheld by the site' WHEN l_tax >= 0.03 THEN 'WITHHELD by the SITE' END AS IsExtractableToDisk_Reason"""
SQL_FILES = f"files AS (SELECT {SQL_UIDS} FROM lineitem)"
SQL_IMAGES = f"""images AS (SELECT CAST(o_custkey AS VARCHAR) AS PatientID, {SQL_UIDS}, p_type AS Modality
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SQL_PATIENT_FILES = f"""images AS (SELECT CAST(o_custkey AS VARCHAR) AS PatientID, {SQL_UIDS}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# ---- the request: every order's study, urgent ones asked for twice ---------------


def request(t) -> DataFrame:
    o = t.orders
    once = o.select((F.col("o_orderkey") * 2).alias("pos"), F.col("o_orderkey").cast("string").alias("key_value"))
    again = o.where(F.col("o_orderpriority") == "1-URGENT").select(
        (F.col("o_orderkey") * 2 + 1).alias("pos"), F.col("o_orderkey").cast("string").alias("key_value"))
    return once.unionByName(again)


SQL_REQUEST = """request AS (
  SELECT o_orderkey * 2 AS pos, CAST(o_orderkey AS VARCHAR) AS key_value FROM orders
  UNION ALL SELECT o_orderkey * 2 + 1, CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')"""

# ---- rejection: rules, blacklist of studies and series, patients who opted out ---

RULES = DynamicRules.from_yaml("""
- {when: "NOT IsOriginal", reason: "'no original image'"}
- {when: "NOT IsPrimary", reason: "'no primary image'"}
- {when: "NOT IsExtractableToDisk", reason: "IsExtractableToDisk_Reason"}
""")


def blacklist(t) -> Catalogue:
    studies = t.orders.where(F.col("o_orderpriority") == "5-LOW").select(
        F.col("o_orderkey").cast("string").alias(STUDY), F.lit(None).cast("string").alias(SERIES))
    # Suppliers in debt: their series, as they occur in the archive.
    debtors = t.supplier.where(F.col("s_acctbal") < 0).select("s_suppkey")
    series = (t.lineitem.join(debtors, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
              .select(F.lit(None).cast("string").alias(STUDY), F.concat_ws(".", "l_orderkey", "l_suppkey").alias(SERIES)).distinct())
    return Catalogue("Blacklist", studies.unionByName(series))


def opted_out(t) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").cast("string").alias("PatientID"))


def chain(t) -> list:
    return [RULES, Blacklist(blacklist(t)), ColumnValues("PatientID", opted_out(t))]


SQL_RULES = """CASE WHEN NOT IsOriginal THEN 'no original image'
  WHEN NOT IsPrimary THEN 'no primary image'
  WHEN NOT IsExtractableToDisk THEN IsExtractableToDisk_Reason END"""
SQL_BLACKLISTED = """CASE WHEN StudyInstanceUID IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')
  OR SeriesInstanceUID IN (SELECT l_orderkey || '.' || l_suppkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    WHERE s_acctbal < 0) THEN 'Blacklisted in Blacklist' END"""
SQL_OPTED_OUT = """CASE WHEN PatientID IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY')
  THEN 'Patient or Identifier was in reject list' END"""
SQL_REASON = f"COALESCE({SQL_RULES}, {SQL_BLACKLISTED}, {SQL_OPTED_OUT})"
# Verdicts of every image anybody asked for, as a set.
SQL_MATCHED = f"""{SQL_PATIENT_FILES}, {SQL_REQUEST}, matched AS (
  SELECT DISTINCT StudyInstanceUID AS key_value, RelativeFileArchiveURI, StudyInstanceUID, SeriesInstanceUID, SOPInstanceUID,
    {SQL_REASON} AS reason FROM images WHERE StudyInstanceUID IN (SELECT key_value FROM request))"""

# ---- identifiers: customers map to a digest of their name ------------------------


def mapping(t) -> DataFrame:
    """Current map; customers in debt have no replacement yet."""
    return t.customer.where(F.col("c_acctbal") >= 0).select(
        F.col("c_custkey").cast("string").alias("swap"), F.md5("c_name").alias("replacement"))


def surrogates(t) -> DataFrame:
    """Surrogates handed out so far: to customers without a replacement."""
    return t.customer.where(F.col("c_acctbal") < 0).select(
        F.col("c_custkey").cast("string").alias("swap"), F.md5(F.concat(F.lit("surrogate"), F.col("c_custkey"))).alias("guid"))


SQL_MAPPING = "mapping AS (SELECT CAST(c_custkey AS VARCHAR) AS swap, md5(c_name) AS replacement FROM customer WHERE c_acctbal >= 0)"
SQL_SURROGATES = "surrogates AS (SELECT CAST(c_custkey AS VARCHAR) AS swap, md5('surrogate' || c_custkey) AS guid FROM customer WHERE c_acctbal < 0)"

# ---- tag sets: one JSON text per image -------------------------------------------


def tagsets(t) -> DataFrame:
    """Images as tag-set JSON, in both dialects and with odd patient values.

    Patient values by return flag and status: plain, repeated, conflicting,
    second dialect, blank, absent.
    """
    bs = r'\\'
    pid = F.col("o_custkey").cast("string")
    flag = F.concat("l_returnflag", "l_linestatus")
    entry = lambda v: F.concat(F.lit('"00100020":{"vr":"LO","val":"'), v, F.lit('"},'))
    patient = (F.when(flag == "AF", entry(pid))
               .when(flag == "AO", entry(F.concat(pid, F.lit(bs), pid)))
               .when(flag == "NF", entry(F.concat(pid, F.lit(bs + "x"))))
               .when(flag == "NO", F.concat(F.lit('"00100020":{"vr":"LO","Value":["'), pid, F.lit('"]},')))
               .when(flag == "RF", entry(F.lit("  "))).otherwise(F.lit("")))
    day = F.date_format("l_shipdate", "yyyyMMdd")
    json = F.concat(
        F.lit("{"), patient,
        F.lit('"00080020":{"vr":"DA","val":"'), day,
        F.lit('"},"00080060":{"vr":"CS","val":"'), F.when(F.col("l_quantity") < 25, "CT").otherwise("MR"),
        F.lit('"},"0020000D":{"vr":"UI","val":"'), F.col("l_orderkey").cast("string"),
        F.lit('"},"00080050":{"vr":"SH"},"00091001":{"vr":"LO","val":"private"},'
              '"60003000":{"vr":"OW","val":"AAAA"},"7FE00010":{"vr":"OW","val":"BBBB"},"00180050":{"vr":"DS","val":"'),
        F.col("l_quantity").cast("int").cast("string"), F.lit('"}}'))
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(*_uids(), pid.alias("PatientID"), flag.alias("flag"), day.alias("day"),
                    F.col("l_quantity").cast("int").alias("thickness"), json.alias("DicomDataset")))


SQL_TAGSETS = f"""tagsets AS (SELECT {SQL_UIDS}, CAST(o_custkey AS VARCHAR) AS PatientID, l_returnflag || l_linestatus AS flag,
  strftime(l_shipdate, '%Y%m%d') AS day, l_shipdate, CAST(l_quantity AS INTEGER) AS thickness,
  CASE WHEN l_quantity < 25 THEN 'CT' ELSE 'MR' END AS modality FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# ---- extraction jobs: a user's events of one day ----------------------------------


def job_events(t) -> DataFrame:
    return t.events.select(
        F.concat_ws("/", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        "event_id", "event_type", "ts", "value", "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def jobs(t) -> DataFrame:
    e = job_events(t)
    info = F.col("event_type").isin("view", "signup")
    return e.groupBy("job_id").agg(
        F.count_if(info | (F.col("k") >= 90)).alias("key_count"), (F.min("value") < 5).alias("identifiable"),
        F.min("ts").alias("submitted_at"), F.max("ts").alias("completed_at"), F.min("user_id").alias("user_id"))


def infos(t) -> DataFrame:
    """Collection records; a view sends one file, a signup two."""
    e = job_events(t).where(F.col("event_type").isin("view", "signup"))
    file = lambda n: F.concat_ws("-", "event_id", F.lit(n))
    reasons = F.when(F.col("value") > 10, F.create_map(
        F.lit("rejected - low"), F.lit(1).cast("long") + F.col("k"), F.lit("rejected - high"), F.lit(2).cast("long")))
    return e.select(
        "job_id", F.col("event_id").cast("string").alias("key_value"), F.lit(0).alias("part"),
        F.when(F.col("event_type") == "view", F.array(file(1))).otherwise(F.array(file(1), file(2))).alias("files"),
        F.coalesce(reasons, F.create_map().cast("map<string,bigint>")).alias("reasons"))


def file_status(t) -> DataFrame:
    e = job_events(t).where(F.col("event_type") == "error")
    missing = F.col("k") < 50
    path = F.concat(F.col("event_id"), F.lit(".dcm"))
    return e.select(
        "job_id", path.alias("file_path"), F.lit(None).cast("string").alias("output_path"),
        F.when(missing, "FileMissing").when(F.col("k") < 60, "Copied").otherwise("ErrorWontRetry").alias("status"),
        F.when(missing, F.concat(F.lit("Could not find "), path)).otherwise(F.lit("Not de-identified")).alias("message"))


def verification(t) -> DataFrame:
    e = job_events(t).where(F.col("event_type").isin("click", "purchase"))
    path = F.concat(F.col("event_id"), F.lit(".dcm"))
    out = F.concat(F.col("event_id"), F.lit("-an.dcm"))
    found = F.concat(
        F.lit("[{'Parts': [{'Classification': 3, 'Offset': "), F.col("k").cast("string"),
        F.lit(", 'Word': 'Alder'}, {'Classification': 2, 'Offset': 9, 'Word': 'Leith'}], 'Resource': '/x.dcm', 'ResourcePrimaryKey': '"),
        F.col("event_id").cast("string"), F.lit("', 'ProblemField': 'ScanOptions', 'ProblemValue': 'Alder of Leith'}]"))
    failed = F.col("value") < 3
    return e.select(
        "job_id", path.alias("file_path"), out.alias("output_path"),
        F.when(failed, "ErrorWontRetry").when(F.col("event_type") == "click", "NotIdentifiable").otherwise("IsIdentifiable").alias("status"),
        F.when(failed, "File could not be scanned").when(F.col("event_type") == "click", "[]").otherwise(found).alias("report"))


SQL_EVENTS = """ev AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS job_id, event_id, event_type, ts, value, user_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
SQL_JOBS = f"""{SQL_EVENTS}, jobs AS (SELECT job_id,
    COUNT(*) FILTER (WHERE event_type IN ('view', 'signup') OR k >= 90) AS key_count, MIN(value) < 5 AS identifiable,
    MIN(ts) AS submitted_at, MAX(ts) AS completed_at, MIN(user_id) AS user_id FROM ev GROUP BY job_id),
  counts AS (SELECT job_id, COUNT(*) FILTER (WHERE event_type IN ('view', 'signup')) AS infos,
    CAST(COALESCE(SUM(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 END), 0) AS BIGINT) AS expected,
    COUNT(*) FILTER (WHERE event_type IN ('click', 'purchase', 'error')) AS statuses FROM ev GROUP BY job_id),
  status AS (SELECT job_id, key_count, infos, expected, statuses,
    CASE WHEN key_count <> infos THEN 'WaitingForCollectionInfo' WHEN expected <> statuses THEN 'WaitingForStatuses'
      ELSE 'ReadyForChecks' END AS status FROM jobs JOIN counts USING (job_id))"""

# ---- the archive as files: some studies keep series folders, some files are odd ----


def archive_files(t) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy/MM/dd")
    name = F.concat(_sop(), F.when(F.col("l_tax") >= 0.08, ".zip").when(F.col("l_tax") >= 0.07, ".txt").otherwise(".dcm"))
    return t.lineitem.select(
        F.when(F.col("l_linestatus") == "F", F.concat_ws("/", day, F.col("l_suppkey"), name))
         .otherwise(F.concat_ws("/", day, F.col("l_suppkey"), F.concat_ws(".", "l_orderkey", "l_suppkey"), name)).alias("path"))


SQL_ARCHIVE = """arch AS (SELECT strftime(l_shipdate, '%Y/%m/%d') || '/' || l_suppkey || '/' ||
    CASE WHEN l_linestatus = 'F' THEN '' ELSE l_orderkey || '.' || l_suppkey || '/' END ||
    l_orderkey || '.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber ||
    CASE WHEN l_tax >= 0.08 THEN '.zip' WHEN l_tax >= 0.07 THEN '.txt' ELSE '.dcm' END AS path FROM lineitem),
  parents AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM arch)"""
