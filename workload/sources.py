"""Discovery, file inspection, cohort list and document-store queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from radloom.functions import paths, text as TX
from radloom.schemas import PATH, SOP
from radloom.session import ensure_checkpoint_dir
from radloom.sources import cohort_csv, directories as D, documents, files as FS, sinks
from workload import views as V
from workload.registry import query

_HOLD = "hold AS (SELECT DISTINCT dir FROM parents WHERE path LIKE '%.dcm')"


@query("dirs_default", f"""WITH {V.SQL_ARCHIVE}, {_HOLD} SELECT dir FROM hold h
WHERE NOT EXISTS (SELECT 1 FROM hold u WHERE u.dir = regexp_replace(h.dir, '/[^/]*$', ''))""")
def dirs_default(t):
    return D.find_dirs(V.archive_files(t))


@query("dirs_pacs", f"WITH {V.SQL_ARCHIVE} SELECT DISTINCT regexp_extract(dir, '^(20[0-9]{{2}}/[0-9]{{2}}/[0-9]{{2}}/[^/]+)', 1) AS dir FROM parents WHERE dir LIKE '20%'")
def dirs_pacs(t):
    dirs = V.archive_files(t).select(paths.parent_dir(F.col("path")).alias("dir"))
    return D.find_dirs_pacs(dirs, "")


@query("dirs_list", f"""WITH {V.SQL_ARCHIVE}, {_HOLD} SELECT d AS dir FROM (SELECT strftime(l_shipdate, '%Y/%m/%d') || '/' || l_suppkey AS d, l_linestatus FROM lineitem)
WHERE l_linestatus = 'F' AND d LIKE '20%' AND d IN (FROM hold)""")
def dirs_list(t):
    """A list with commas; lines without their last separator do not count."""
    d = F.concat_ws("/", F.date_format("l_shipdate", "yyyy/MM/dd"), F.col("l_suppkey"))
    lines = t.lineitem.select(F.when(F.col("l_linestatus") == "F", F.concat(d, F.lit("/,,"))).otherwise(d).alias("value"))
    return D.list_dirs(lines, V.archive_files(t))


@query("dirs_zips", f"WITH {V.SQL_ARCHIVE} SELECT DISTINCT dir FROM parents WHERE path LIKE '%.dcm' OR path LIKE '%.zip' OR path LIKE '%.tar'")
def dirs_zips(t):
    return D.find_dirs_zips(V.archive_files(t))


@query("file_kind", "SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'dicom' ELSE 'archive' END AS kind FROM pages")
def file_kind(t):
    """Pages as file contents behind a preamble; secure ones carry the magic."""
    magic = F.when(F.startswith(F.col("url"), F.lit("https")), "DICM").otherwise("DICX")
    content = F.encode(F.concat(F.repeat(F.lit("p"), 128), magic, F.col("html")), "UTF-8")
    return FS.classify_files(t.pages.select("page_id", content.alias("content"))).select("page_id", "kind")


@query("include_filter", f"WITH {V.SQL_ARCHIVE} SELECT path FROM arch WHERE path LIKE '2000/%' AND path LIKE '%.dcm'")
def include_filter(t):
    return FS.find_files(V.archive_files(t), F.startswith(F.col("path"), F.lit("2000/")) & F.endswith(F.col("path"), F.lit(".dcm")))


@query("cohort_parse", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(o_custkey AS VARCHAR) ELSE o_custkey || ',2' END AS key_value,
  FALSE AS bad FROM orders WHERE o_orderstatus IN ('O', 'F')""")
def cohort_parse(t):
    """Lines with outer blanks, quotes around a comma, or nothing."""
    line = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("  "), F.col("o_custkey"), F.lit(" ")))
            .when(F.col("o_orderstatus") == "F", F.concat(F.lit('"'), F.col("o_custkey"), F.lit(',2"'))).otherwise("   "))
    return cohort_csv.parse_cohort(t.orders.select("o_orderkey", line.alias("value"))).select("o_orderkey", "key_value", "bad")


@query("find_eq", "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO'")
def find_eq(t):
    return documents.find(t.part, '{"find": {"p_type": "PROMO"}}').select("p_partkey", "p_name")


@query("find_regex", f"WITH {V.SQL_FILES} SELECT SOPInstanceUID, RelativeFileArchiveURI FROM files WHERE regexp_matches(RelativeFileArchiveURI, '^2000/0')")
def find_regex(t):
    return documents.find(V.files(t), '{"find": {"RelativeFileArchiveURI": {"$regex": "^2000/0"}}}').select(SOP, PATH)


@query("find_operators", """SELECT p_partkey FROM part WHERE (p_size BETWEEN 10 AND 20 AND p_type IN ('PROMO', 'SMALL')) OR p_brand = 'Brand#1' AND p_type <> 'LARGE'""")
def find_operators(t):
    return documents.find(t.part, """{"find": {"$or": [
        {"p_size": {"$gte": 10, "$lte": 20}, "p_type": {"$in": ["PROMO", "SMALL"]}},
        {"$and": [{"p_brand": "Brand#1"}, {"p_type": {"$ne": "LARGE"}}, {"p_name": {"$exists": true}}]}]}}""").select("p_partkey")


@query("date_forms", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) % 86400 AS seconds,
  CASE user_id % 4 WHEN 0 THEN k WHEN 1 THEN k * 7 WHEN 2 THEN k * 30 ELSE k * 365 END AS days, CAST(NULL AS DATE) IS NULL AS odd
FROM (SELECT event_id, ts, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""")
def date_forms(t):
    """Dates, times and ages in the forms of tags, back to values; text in no such form gives null."""
    k, unit = F.get_json_object("props", "$.k").cast("int"), F.get(F.array(*map(F.lit, "DWMY")), (F.col("user_id") % 4).cast("int"))
    rows = t.events.select("event_id", F.date_format("ts", "yyyyMMdd").alias("da"), F.date_format("ts", "HHmmss").alias("tm"),
                           F.concat(F.format_string("%03d", k), unit).alias("age"))
    odd = TX.da_to_date(F.concat(F.lit("x"), "da")).isNull() & TX.tm_to_seconds(F.concat(F.lit("9"), "tm")).isNull() & TX.age_in_days(F.lit("3Y")).isNull()
    return rows.select("event_id", F.date_format(TX.da_to_date(F.col("da")), "yyyy-MM-dd").alias("day"), TX.tm_to_seconds(F.col("tm")).alias("seconds"),
                       TX.age_in_days(F.col("age")).alias("days"), odd.alias("odd"))


@query("store_images", """SELECT CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'CT' ELSE 'OTHER' END AS modality_group, COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS size
FROM part GROUP BY 1""")
def store_images(t):
    """Images written to the document store by modality group and read back."""
    spark = t.spark
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/images-{uuid.uuid4().hex}"
    modality = F.when(F.col("p_type").isin("PROMO", "SMALL"), "CT").otherwise(F.lit("XX"))
    if not sinks.write_images(t.part.select("p_partkey", "p_size", modality.alias("Modality")), path).isEmpty():
        raise ValueError("there are parts over the size limit")
    return spark.read.parquet(path).groupBy("modality_group").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("size"))


@query("find_skip", "SELECT p_partkey, p_type FROM part WHERE p_type <> 'LARGE' ORDER BY p_partkey OFFSET 123")
def find_skip(t):
    """All rows of a query but the first ones, in their order."""
    return documents.find(t.part, '{"find": {"p_type": {"$ne": "LARGE"}}, "sort": {"p_partkey": 1}, "skip": 123}').select("p_partkey", "p_type")


@query("find_sort_skip_limit", "SELECT p_partkey FROM part WHERE p_type <> 'LARGE' ORDER BY p_partkey DESC LIMIT 456 OFFSET 123")
def find_sort_skip_limit(t):
    """The query form whose feature is a sorted page of results."""
    query_text = '{"find": {"p_type": {"$ne": "LARGE"}}, "sort": {"p_partkey": -1}, "skip": 123, "limit": 456}'
    return documents.find(t.part, query_text).select("p_partkey")
