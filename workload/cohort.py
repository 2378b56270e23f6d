"""Cohort selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions import paths
from radloom.operators import cohort as C
from radloom.operators.rejectors import (Blacklist, ColumnValues, ModalityRules, RejectAll, apply_by_modality,
                                         apply_rejectors)
from radloom.operators.validate import ExtractionOptions
from radloom.plans.extraction import plan_extraction
from radloom.schemas import PATH, SERIES, SOP, STUDY, Catalogue
from radloom.session import shared_folder
from radloom.sources import lookup_index
from workload import views as V
from workload.registry import query

KEY = STUDY
DIRECTORY = "proj/extractions/first/"


def extraction(t, keep=False, **options):
    """The flagship request over one catalogue; one of another modality is not asked."""
    catalogues = [Catalogue("CT_ImageTable", V.patient_files(t)), Catalogue("MR_ImageTable", V.patient_files(t))]
    return plan_extraction(V.request(t), ExtractionOptions(KEY, **options), "CT", DIRECTORY, catalogues, V.chain(t), keep=keep)


@query("match_summary", f"""WITH {V.SQL_MATCHED}
SELECT pos, key_value, COALESCE(accepted, 0) AS accepted, COALESCE(rejected, 0) AS rejected FROM request LEFT JOIN (
  SELECT key_value, COUNT(*) FILTER (WHERE reason IS NULL) AS accepted, COUNT(*) FILTER (WHERE reason IS NOT NULL) AS rejected
  FROM matched GROUP BY key_value) USING (key_value)""")
def match_summary(t):
    return extraction(t).summary


@query("cohort_match", f"""WITH {V.SQL_MATCHED}
SELECT pos, key_value, RelativeFileArchiveURI, SeriesInstanceUID, SOPInstanceUID, reason FROM request LEFT JOIN matched USING (key_value)""")
def cohort_match(t):
    return extraction(t).per_request.select("pos", "key_value", PATH, SERIES, SOP, "reason")


@query("cohort_indexed", f"""WITH {V.SQL_MATCHED}
SELECT pos, key_value, RelativeFileArchiveURI, SeriesInstanceUID, SOPInstanceUID, reason FROM request LEFT JOIN matched USING (key_value)""")
def cohort_indexed(t):
    """The same request over a stored catalogue of many files, of which only those are opened that can hold a requested study."""
    folder = shared_folder(t.spark, "catalogue")
    V.patient_files(t, 32).write.option("compression", "zstd").parquet(f"{folder}/rows")
    stored = t.spark.read.parquet(f"{folder}/rows")
    lookup_index.add_files(t.spark, f"{folder}/index", stored.inputFiles(), stored.schema, [STUDY, SERIES], 8)
    few = lookup_index.cut_down(stored, V.request(t), "key_value", f"{folder}/index", KEY)
    plan = plan_extraction(V.request(t), ExtractionOptions(KEY), "CT", DIRECTORY, [Catalogue("CT_ImageTable", few)], V.chain(t))
    return plan.per_request.select("pos", "key_value", PATH, SERIES, SOP, "reason")


@query("rejection_reasons", f"""WITH {V.SQL_MATCHED}
SELECT key_value, arg_min(reason, RelativeFileArchiveURI || ' ' || SOPInstanceUID) AS reason, COUNT(*) AS n
FROM matched WHERE reason IS NOT NULL GROUP BY key_value, lower(reason)""")
def rejection_reasons(t):
    return extraction(t).reasons


@query("by_series", f"""WITH {V.SQL_MATCHED}
SELECT key_value, SeriesInstanceUID, COUNT(*) AS images, COUNT(*) FILTER (WHERE reason IS NOT NULL) AS rejected
FROM matched GROUP BY ALL""")
def by_series(t):
    return C.by_series(extraction(t).matched)


@query("single_series", f"""WITH {V.SQL_MATCHED}
SELECT key_value, CASE WHEN COUNT(DISTINCT SeriesInstanceUID) = 1 THEN MIN(SeriesInstanceUID) END AS SeriesInstanceUID
FROM matched GROUP BY key_value""")
def single_series(t):
    return C.single_series(extraction(t).matched)


@query("dispatch", f"""WITH {V.SQL_MATCHED}
SELECT key_value, 'anon' AS route, RelativeFileArchiveURI AS file_path, 'proj/extractions/first' AS directory,
  StudyInstanceUID || '/' || SeriesInstanceUID || '/' || SOPInstanceUID || '-an.dcm' AS output_path
FROM matched WHERE reason IS NULL""")
def dispatch(t):
    return extraction(t).files


@query("collection_info", f"""WITH {V.SQL_MATCHED}
SELECT pos, key_value, COALESCE(dispatched, 0) AS dispatched, COALESCE(rejected, 0) AS rejected, COALESCE(reasons, 0) AS reasons
FROM request LEFT JOIN (SELECT key_value, COUNT(*) FILTER (WHERE reason IS NULL) AS dispatched,
  COUNT(*) FILTER (WHERE reason IS NOT NULL) AS rejected, COUNT(DISTINCT lower(reason)) AS reasons FROM matched GROUP BY key_value)
USING (key_value)""")
def collection_info(t):
    return extraction(t).collections


@query("collection_messages", f"""WITH {V.SQL_MATCHED}
SELECT pos AS key_pos, key_value, COALESCE(files, 0) AS files, COALESCE(rejected, 0) AS rejected
FROM request LEFT JOIN (SELECT key_value, COUNT(*) FILTER (WHERE reason IS NULL) AS files,
  COUNT(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM matched GROUP BY key_value) USING (key_value)""")
def collection_messages(t):
    """The packed records, unpacked again to counts per requested identifier."""
    e = extraction(t, keep=True)
    packed = C.collection_messages(V.request(t), e.matched, e.files, part_size=2)
    rejected = F.aggregate(F.map_values("reasons"), F.lit(0).cast("long"), lambda a, n: a + n)
    return packed.groupBy("key_pos", "key_value").agg(
        F.sum(F.size("files")).alias("files"), F.sum(rejected).alias("rejected"))


@query("no_filters", f"""WITH {V.SQL_FILES}, {V.SQL_REQUEST}
SELECT key_value, COUNT(DISTINCT RelativeFileArchiveURI || SOPInstanceUID) AS images FROM files
JOIN (SELECT DISTINCT key_value FROM request) ON StudyInstanceUID = key_value WHERE IsExtractableToDisk GROUP BY key_value""")
def no_filters(t):
    """No rejector is asked, but the catalogue's own filter still holds."""
    catalogue = Catalogue("CT_ImageTable", V.files(t), ("IsExtractableToDisk = true",))
    plan = plan_extraction(V.request(t), ExtractionOptions(KEY, no_filters=True), "CT", DIRECTORY, [catalogue], V.chain(t))
    return plan.matched.groupBy("key_value").agg(F.count("*").alias("images"))


@query("union_catalogues", f"""WITH {V.SQL_FILES}
SELECT SeriesInstanceUID AS key_value, RelativeFileArchiveURI, SOPInstanceUID FROM files
WHERE IsPrimary OR IsOriginal GROUP BY ALL""")
def union_catalogues(t):
    """Two overlapping catalogues of one modality give each image once."""
    rows = V.files(t)
    both = [Catalogue("CT_Primary", rows, ("IsPrimary",)), Catalogue("CT_Original", rows, ("IsOriginal",))]
    ids = rows.select(F.lit(0).alias("pos"), F.col(SERIES).alias("key_value")).distinct()
    routed = C.route_catalogues(both, "CT", SERIES)
    return C.match_images(ids, SERIES, routed, []).select("key_value", PATH, SOP)


@query("route_modality", """SELECT name, regexp_extract(name, '^([A-Z]+)_.*$', 1) AS modality FROM (
SELECT p_type || '_' || p_brand AS name FROM part UNION ALL SELECT lower(p_type) || '_' || p_brand FROM part)""")
def route_modality(t):
    upper = t.part.select(F.concat_ws("_", "p_type", "p_brand").alias("name"))
    lower = t.part.select(F.concat_ws("_", F.lower("p_type"), "p_brand").alias("name"))
    return upper.union(lower).select("name", C.routed_modality(F.col("name")).alias("modality"))


_VERDICT = "SOPInstanceUID, reason IS NOT NULL AS reject, reason"


@query("apply_rejectors", f"WITH {V.SQL_PATIENT_FILES} SELECT {_VERDICT} FROM (SELECT *, {V.SQL_REASON} AS reason FROM images)")
def all_rejectors(t):
    return apply_rejectors(V.patient_files(t), V.chain(t)).select(SOP, "reject", "reason")


@query("dynamic_rules", f"WITH {V.SQL_FILES} SELECT {_VERDICT} FROM (SELECT *, {V.SQL_RULES} AS reason FROM files)")
def dynamic_rules(t):
    return apply_rejectors(V.files(t), [V.RULES]).select(SOP, "reject", "reason")


@query("rules_explain", f"""WITH {V.SQL_FILES} SELECT SOPInstanceUID, NOT IsOriginal AS rule_1, NOT IsPrimary AS rule_2,
  NOT IsExtractableToDisk AS rule_3, reason IS NOT NULL AS reject, reason FROM (SELECT *, {V.SQL_RULES} AS reason FROM files)""")
def rules_explain(t):
    return V.RULES.explain(V.files(t)).select(SOP, "rule_1", "rule_2", "rule_3", "reject", "reason")


@query("reject_blacklist", f"WITH {V.SQL_FILES} SELECT {_VERDICT} FROM (SELECT *, {V.SQL_BLACKLISTED} AS reason FROM files)")
def reject_blacklist(t):
    return apply_rejectors(V.files(t), [Blacklist(V.blacklist(t))]).select(SOP, "reject", "reason")


@query("reject_values", """SELECT o_orderkey, reason IS NOT NULL AS reject, reason FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P'
  AND c_name IN (SELECT c_name FROM customer WHERE c_mktsegment = 'MACHINERY')
  THEN 'Patient or Identifier was in reject list' END AS reason FROM orders JOIN customer ON o_custkey = c_custkey)""")
def reject_values(t):
    """Names in other letter case on the list; orders without a name pass."""
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("c_name")).alias("name"))
    listed = t.customer.where(F.col("c_mktsegment") == "MACHINERY").select(F.upper("c_name").alias("name"))
    return apply_rejectors(named, [ColumnValues("name", listed)]).select("o_orderkey", "reject", "reason")


@query("reject_all", f"WITH {V.SQL_FILES} SELECT SOPInstanceUID, TRUE AS reject, 'Rejector is RejectAll' AS reason FROM files")
def reject_all(t):
    return apply_rejectors(V.files(t), [RejectAll()]).select(SOP, "reject", "reason")


@query("modality_rules", f"""WITH {V.SQL_IMAGES} SELECT {_VERDICT} FROM (SELECT *, CASE
  WHEN Modality = 'PROMO' THEN 'Rejector is RejectAll'
  WHEN Modality IN ('LARGE', 'SMALL') THEN COALESCE({V.SQL_OPTED_OUT}, {V.SQL_RULES}) ELSE {V.SQL_RULES} END AS reason FROM images)""")
def modality_rules(t):
    specific = [ModalityRules("promo", RejectAll(), overrides=True),
                ModalityRules("Large,SMALL", ColumnValues("PatientID", V.opted_out(t)))]
    judged = apply_by_modality(V.images(t), "Modality", ["PROMO", "LARGE", "SMALL"], [V.RULES], specific)
    return judged.select(SOP, "reject", "reason")


# --- output paths ------------------------------------------------------------------

_NAMED = """named AS (SELECT SOPInstanceUID, StudyInstanceUID, SeriesInstanceUID, IsOriginal, CASE
  WHEN IsPrimary THEN 'a/' || SOPInstanceUID || '.dcm.dcm' WHEN IsOriginal THEN 'a/' || SOPInstanceUID || '.dicom'
  ELSE 'a/b-an/' || SOPInstanceUID || '-an.foo' END AS RelativeFileArchiveURI FROM files)"""
_NAME = "regexp_replace(RelativeFileArchiveURI, '^.*/', '')"
_SUFFIX = "CASE WHEN IsOriginal THEN '.dcm' ELSE '-an.dcm' END"
_OUT = f"""StudyInstanceUID || '/' || SeriesInstanceUID || '/' || CASE
  WHEN {_NAME} LIKE '%.dcm' THEN replace({_NAME}, '.dcm', {_SUFFIX}) WHEN {_NAME} LIKE '%.dicom' THEN replace({_NAME}, '.dicom', {_SUFFIX})
  ELSE {_NAME} || {_SUFFIX} END"""


def _oddly_named(t):
    sop = F.col(SOP)
    odd = (F.when(F.col("IsPrimary"), F.concat(F.lit("a/"), sop, F.lit(".dcm.dcm")))
           .when(F.col("IsOriginal"), F.concat(F.lit("a/"), sop, F.lit(".dicom")))
           .otherwise(F.concat(F.lit("a/b-an/"), sop, F.lit("-an.foo"))))
    return V.files(t).withColumn(PATH, odd)


@query("out_path_sop", f"WITH {V.SQL_FILES} SELECT SOPInstanceUID, StudyInstanceUID || '/' || SeriesInstanceUID || '/' || SOPInstanceUID || {_SUFFIX} AS output_path FROM files")
def out_path_sop(t):
    return V.files(t).select(SOP, paths.out_path_sop(F.col("IsOriginal")).alias("output_path"))


@query("out_path_name", f"WITH {V.SQL_FILES}, {_NAMED} SELECT SOPInstanceUID, {_OUT} AS output_path FROM named")
def out_path_name(t):
    return _oddly_named(t).select(SOP, paths.out_path_name(F.col("IsOriginal")).alias("output_path"))


@query("out_path_nosuffix", f"WITH {V.SQL_FILES}, {_NAMED} SELECT SOPInstanceUID, replace({_OUT}, '-an', '') AS output_path FROM named")
def out_path_nosuffix(t):
    return _oddly_named(t).select(SOP, paths.out_path_nosuffix(F.col("IsOriginal")).alias("output_path"))


@query("path_parts", r"""SELECT page_id, replace(regexp_replace(p, '^[/\\]+', ''), '\', '/') AS path,
  regexp_extract(p, '([^/\\]*)[/\\]*$', 1) AS name, regexp_replace(p, '[/\\]?[^/\\]*[/\\]*$', '') AS project_dir
FROM (SELECT page_id, '/\' || replace(url, '/fr/', '\fr/') AS p FROM pages)""")
def path_parts(t):
    p = t.pages.select("page_id", F.concat(F.lit("/\\"), F.replace(F.col("url"), F.lit("/fr/"), F.lit("\\fr/"))).alias("p"))
    return p.select("page_id", paths.normalise(F.col("p")).alias("path"), paths.extraction_name(F.col("p")).alias("name"),
                    paths.project_dir(F.col("p")).alias("project_dir"))


# --- job submission ------------------------------------------------------------------

@query("job_info", f"WITH {V.SQL_REQUEST} SELECT 'StudyInstanceUID' AS key_tag, COUNT(*) AS key_count FROM request")
def job_info(t):
    return C.job_info(V.request(t), KEY)


@query("chunk_ids", f"""WITH {V.SQL_REQUEST}, placed AS (SELECT key_value, row_number() OVER (ORDER BY pos) - 1 AS place FROM request)
SELECT CAST(floor(place / 1000) AS BIGINT) AS chunk, COUNT(*) AS n, string_agg(key_value, ',' ORDER BY place) AS ids FROM placed GROUP BY 1""")
def chunk_ids(t):
    return C.chunk_ids(V.request(t)).select("chunk", F.size("identifiers").cast("long").alias("n"),
                                            F.array_join("identifiers", ",").alias("ids"))
