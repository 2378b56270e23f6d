"""Validation, projection, roll-up, isolation and merge queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from radloom.functions import lineage, paths, tags as TG
from radloom.operators import load as L, project as P, reconcile as RC, validate as VA
from radloom.schemas import PATH, SERIES, SOP, STUDY
from radloom.session import shared_folder
from radloom.sources import lookup_index, sinks
from radloom.sources.tables import parse_strict
from radloom.streaming.flows import split_load
from radloom.template import TemplateColumn, TemplateTable, load_template
from workload import views as V
from workload.registry import query

# --- validation ------------------------------------------------------------------------


def _with_gaps(t):
    """Images some of whose identifiers are blank or missing."""
    return V.files(t).select(
        "IsOriginal", "IsPrimary", PATH,
        F.when(F.col("IsOriginal"), F.col(STUDY)).otherwise("  ").alias(STUDY),
        F.when(F.col("IsPrimary"), F.col(SERIES)).alias(SERIES), F.col(SOP).alias("image"), SOP)


@query("require_ids", f"""WITH {V.SQL_FILES} SELECT SOPInstanceUID, CASE WHEN NOT IsOriginal AND NOT IsPrimary
  THEN 'missing ID: StudyInstanceUID,SeriesInstanceUID' WHEN NOT IsOriginal THEN 'missing ID: StudyInstanceUID'
  WHEN NOT IsPrimary THEN 'missing ID: SeriesInstanceUID' END AS bad FROM files""")
def require_ids(t):
    return VA.require_ids(_with_gaps(t)).select(SOP, "bad")


@query("nack_directory", f"""WITH {V.SQL_FILES}, d AS (SELECT SOPInstanceUID, regexp_replace(RelativeFileArchiveURI, '/[^/]*$', '') AS dir,
  IsExtractableToDisk AND IsOriginal AS good FROM files)
SELECT SOPInstanceUID, dir FROM d WHERE dir NOT IN (SELECT dir FROM d WHERE NOT good)""")
def nack_directory(t):
    bad = F.when(~(F.col("IsExtractableToDisk") & F.col("IsOriginal")), F.lit("unreadable"))
    rows = V.files(t).select(SOP, paths.parent_dir(F.col(PATH)).alias("dir"), bad.alias("bad"))
    return VA.drop_bad(rows, "dir", nack_if_any=True).select(SOP, "dir")


_WIDTHS = {"SOPInstanceUID": 16, "SeriesInstanceUID": 7}
_WIDE = """CASE WHEN length(SOPInstanceUID) > 16 AND length(SeriesInstanceUID) > 7 THEN 'SOPInstanceUID,SeriesInstanceUID'
  WHEN length(SOPInstanceUID) > 16 THEN 'SOPInstanceUID' WHEN length(SeriesInstanceUID) > 7 THEN 'SeriesInstanceUID' ELSE '' END AS warnings"""


def _widths(t, mode):
    out = VA.enforce_width(V.files(t).select(SOP, SERIES, PATH), _WIDTHS, mode)
    return out.select(PATH, SOP, SERIES, F.array_join("warnings", ",").alias("warnings"), "corrupt")


@query("width_truncate", f"""WITH {V.SQL_FILES} SELECT RelativeFileArchiveURI, substr(SOPInstanceUID, 1, 16) AS SOPInstanceUID,
  substr(SeriesInstanceUID, 1, 7) AS SeriesInstanceUID, {_WIDE}, FALSE AS corrupt FROM files""")
def width_truncate(t):
    return _widths(t, "truncate")


@query("width_null", f"""WITH {V.SQL_FILES} SELECT RelativeFileArchiveURI, CASE WHEN length(SOPInstanceUID) <= 16 THEN SOPInstanceUID END AS SOPInstanceUID,
  CASE WHEN length(SeriesInstanceUID) <= 7 THEN SeriesInstanceUID END AS SeriesInstanceUID, {_WIDE}, FALSE AS corrupt FROM files""")
def width_null(t):
    return _widths(t, "null")


@query("width_corrupt", f"""WITH {V.SQL_FILES} SELECT RelativeFileArchiveURI, SOPInstanceUID, SeriesInstanceUID, {_WIDE},
  length(SOPInstanceUID) > 16 OR length(SeriesInstanceUID) > 7 AS corrupt FROM files""")
def width_corrupt(t):
    return _widths(t, "corrupt")


@query("guard_size", "SELECT doc_id, octet_length(encode(CAST(to_json(struct_pack(doc_id := doc_id, text := text)) AS VARCHAR))) > 8000 AS too_large FROM documents")
def guard_size(t):
    return VA.guard_size(t.documents.select("doc_id", "text"), 8000).select("doc_id", "too_large")


_CASTS = TemplateTable("t", (TemplateColumn("n", T.IntegerType()), TemplateColumn("x", T.DecimalType(10, 2)), TemplateColumn("s")))


@query("cast_null", """SELECT o_orderkey, CAST(TRY_CAST(n AS INTEGER) AS VARCHAR) AS n, CAST(TRY_CAST(x AS DECIMAL(10,2)) AS VARCHAR) AS x, o_orderpriority AS s,
  CASE WHEN o_orderstatus = 'P' THEN 'n MessageGuid=' || o_custkey || ' file=' || o_orderkey ELSE '' END AS warnings
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN CAST(o_custkey AS VARCHAR) END AS n,
  CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS VARCHAR) AS x FROM orders)""")
def cast_null(t):
    rows = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
         .when(F.col("o_orderstatus") == "O", F.col("o_custkey").cast("string")).alias("n"),
        F.col("o_totalprice").cast("decimal(10,2)").cast("string").alias("x"), F.col("o_orderpriority").alias("s"),
        F.col("o_custkey").cast("string").alias("MessageGuid"), F.col("o_orderkey").cast("string").alias(PATH))
    out = VA.cast_tags(rows, _CASTS, "null")
    return out.select(F.col(PATH).cast("long").alias("o_orderkey"), F.col("n").cast("string").alias("n"), F.col("x").cast("string").alias("x"), "s",
                      F.array_join("warnings", ";").alias("warnings"))


@query("cast_corrupt", """SELECT o_orderkey, o_orderstatus = 'P' AS corrupt FROM orders""")
def cast_corrupt(t):
    rows = t.orders.select(
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("n"),
        F.col("o_orderkey").cast("string").alias(PATH))
    return VA.cast_tags(rows, _CASTS, "corrupt").select(F.col(PATH).cast("long").alias("o_orderkey"), "corrupt")


@query("cast_sequences", """SELECT o_orderkey, o_orderstatus <> 'P' AS kept, CASE WHEN o_orderstatus = 'P' THEN 'Codes file=' || o_orderkey ELSE '' END AS warnings FROM orders""")
def cast_sequences(t):
    """A number in a nested item that is none takes the whole sequence with it."""
    value = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string"))
    items = F.concat(F.lit('[{"00180050":{"vr":"DS","val":"1.5"}},{"00180050":{"vr":"DS","Value":["2","'), value, F.lit('"]}}]'))
    out = VA.check_sequences(t.orders.select(F.col("o_orderkey").cast("string").alias(PATH), items.alias("Codes")), ["Codes"])
    return out.select(F.col(PATH).cast("long").alias("o_orderkey"), F.col("Codes").isNotNull().alias("kept"), F.array_join("warnings", ";").alias("warnings"))


@query("validate_requests", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'ExtractionDirectory' END AS bad FROM orders""")
def validate_requests(t):
    return VA.validate_requests(t.orders.select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("project"),
        F.when(F.col("o_orderstatus") == "P", "other/extractions/1").otherwise(F.concat(F.col("o_custkey"), F.lit("/extractions/1")))
         .alias("directory"))).select("o_orderkey", "bad")


_MESSAGE = T.StructType([T.StructField(n, T.StringType()) for n in ("DicomFilePath", "StudyInstanceUID", "SOPInstanceUID")])


@query("parse_strict", f"""WITH {V.SQL_FILES} SELECT SOPInstanceUID, CASE WHEN NOT IsPrimary THEN 'unknown member: Extra,More'
  WHEN NOT IsOriginal THEN 'missing member: StudyInstanceUID' END AS bad, CASE WHEN IsOriginal THEN StudyInstanceUID END AS study FROM files""")
def strict_messages(t):
    text = F.to_json(F.struct(
        F.col(PATH).alias("DicomFilePath"), F.when(F.col("IsOriginal"), F.col(STUDY)).alias(STUDY), SOP,
        F.when(~F.col("IsPrimary"), F.lit("x")).alias("More"), F.when(~F.col("IsPrimary"), F.lit("y")).alias("Extra")))
    parsed = parse_strict(V.files(t).withColumn("message", text), F.col("message"), _MESSAGE, _MESSAGE.names)
    return parsed.select(F.col(f"record.{SOP}").alias(SOP), "bad", F.col(f"record.{STUDY}").alias("study"))


@query("below_root", f"""WITH {V.SQL_ARCHIVE}, dirs AS (SELECT DISTINCT dir FROM parents),
  n AS (SELECT dir, COUNT(*) AS n FROM parents WHERE path LIKE '%.dcm' OR path LIKE '%.zip' GROUP BY dir)
SELECT dir, COALESCE(n, 0) AS n_files, CASE WHEN NOT starts_with(dir, '20') THEN 'not below root' WHEN n IS NULL THEN 'no files' END AS bad
FROM dirs LEFT JOIN n USING (dir)""")
def below_root(t):
    files = V.archive_files(t)
    dirs = files.select(paths.parent_dir(F.col("path")).alias("dir")).distinct()
    return VA.require_below_root(dirs, files, "20")


@query("reprocess", f"""WITH {V.SQL_TAGSETS} SELECT SOPInstanceUID, CASE WHEN flag IN ('RF', 'RO') THEN 'no header'
  WHEN flag = 'NF' THEN 'message was not valid' END AS bad,
  CAST(CASE WHEN flag = 'AF' THEN thickness ELSE -1 END AS BIGINT) AS size FROM tagsets""")
def reprocess(t):
    docs = V.tagsets(t).select(
        SOP, F.when(F.col("flag") != "NF", F.col(STUDY)).otherwise("").alias(STUDY), SERIES,
        F.when(F.col("flag").substr(1, 1) != "R", F.struct(
            F.col(PATH).alias("DicomFilePath"),
            F.when(F.col("flag") == "AF", F.col("thickness").cast("long")).alias("DicomFileSize"))).alias("header"),
        F.col("DicomDataset").alias("dataset"))
    return VA.rebuild_messages(docs).select(SOP, "bad", F.col("DicomFileSize").alias("size"))


# --- projection ------------------------------------------------------------------------


@query("strip_bulk_keys", f"""WITH {V.SQL_TAGSETS} SELECT SOPInstanceUID, CASE WHEN flag = 'RO' THEN '00080020,00080050,00080060,00091001,00180050,0020000D'
  ELSE '00080020,00080050,00080060,00091001,00100020,00180050,0020000D' END AS tags FROM tagsets""")
def strip_bulk_keys(t):
    slim = TG.strip_bulk(TG.parse_tags(F.col("DicomDataset")))
    return V.tagsets(t).select(SOP, F.array_join(F.array_sort(F.map_keys(slim)), ",").alias("tags"))


TEMPLATE = """
Tables:
- TableName: StudyTable
  Columns:
  - ColumnName: PatientID
  - {ColumnName: StudyInstanceUID, IsPrimaryKey: true}
  - {ColumnName: StudyDate, AllowNulls: true}
- TableName: ImageTable
  Columns:
  - {ColumnName: SOPInstanceUID, IsPrimaryKey: true}
  - {ColumnName: Modality, AllowNulls: true}
  - {ColumnName: SliceThickness, AllowNulls: true}
  - {ColumnName: AccessionNumber, AllowNulls: true}
  - {ColumnName: RelativeFileArchiveURI, AllowNulls: true}
"""


@query("flatten_props", f"""WITH {V.SQL_TAGSETS} SELECT RelativeFileArchiveURI, CASE WHEN flag IN ('AF', 'NO') THEN PatientID
  WHEN flag = 'AO' THEN PatientID || '\\' || PatientID WHEN flag = 'NF' THEN PatientID || '\\x' WHEN flag = 'RF' THEN '  ' END AS PatientID,
  StudyInstanceUID, day AS StudyDate, modality AS Modality, CAST(thickness AS VARCHAR) AS SliceThickness,
  CAST(NULL AS VARCHAR) AS AccessionNumber FROM tagsets""")
def flatten_props(t):
    flat = P.flatten(V.tagsets(t), list(load_template(TEMPLATE).values()), path=PATH)
    return flat.drop(SOP)


_WIDE_TEMPLATE = """
Tables:
- TableName: t
  Columns: [{ColumnName: EchoTime}, {ColumnName: PixelSpacing}, {ColumnName: ScanOptions}, {ColumnName: AcquisitionTime},
            {ColumnName: LossyImageCompressionRatio}, {ColumnName: OwnValue, Tag: '(0019,100A)'}, {ColumnName: MessageGuid, AllowNulls: true}]
"""


@query("flatten_wide", """SELECT CAST(p_partkey AS VARCHAR) AS RelativeFileArchiveURI, p_type AS EchoTime, CAST(p_size AS VARCHAR) || '\\' || CAST(p_size AS VARCHAR) AS PixelSpacing,
  p_brand AS ScanOptions, p_name AS AcquisitionTime, CAST(NULL AS VARCHAR) AS LossyImageCompressionRatio, CAST(p_partkey AS VARCHAR) AS OwnValue,
  CAST(NULL AS VARCHAR) AS MessageGuid FROM part""".replace("\\\\", "\\"))
def flatten_wide(t):
    """Columns whose tags lie outside the common ones, one of them named by the template itself."""
    text = lambda c: F.struct(F.lit("LO").alias("vr"), c.cast("string").alias("val"))
    size = F.col("p_size").cast("string")
    tags = F.to_json(F.create_map(
        F.lit("00180081"), text(F.col("p_type")), F.lit("00280030"), text(F.concat(size, F.lit("\\"), size)), F.lit("00180022"), text(F.col("p_brand")),
        F.lit("00080032"), text(F.col("p_name")), F.lit("0019100A"), text(F.col("p_partkey"))))
    rows = t.part.select(F.col("p_partkey").cast("string").alias("DicomFilePath"), tags.alias("DicomDataset"))
    return P.flatten(rows, list(load_template(_WIDE_TEMPLATE).values()))


@query("flatten_brackets", """SELECT CAST(p_partkey AS VARCHAR) AS RelativeFileArchiveURI, concat('[', p_name) AS EchoTime,
  concat('[', p_size, '] see ', p_brand) AS PixelSpacing, concat(p_type, '^', p_brand, '=', p_name) AS ScanOptions, concat(p_size, chr(92), p_size, '.5') AS AcquisitionTime,
  concat('["', p_brand, '"]') AS LossyImageCompressionRatio, concat('[', p_name, chr(92), p_size) AS OwnValue, CAST(NULL AS VARCHAR) AS MessageGuid FROM part""")
def flatten_brackets(t):
    """Texts with a bracket in front, person names, numbers and lists, in both dialects and with a tag in lower case."""
    second = F.col("p_partkey") % 2 == 0
    quoted = lambda text: F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', "$1")
    size, name = F.col("p_size").cast("string"), F.concat(F.lit("["), F.col("p_name"))

    def element(tag: str, vr: str, *values) -> Column:
        listed = F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]"))
        plain = values[0] if len(values) == 1 else listed
        return F.concat(F.lit(f'"{tag}":{{"vr":"{vr}",'), F.when(second, F.concat(F.lit('"Value":'), listed)).otherwise(F.concat(F.lit('"val":'), plain)), F.lit("}"))

    person = F.concat(F.lit('{"Alphabetic":"'), F.col("p_type"), F.lit("^"), F.col("p_brand"), F.lit('","Ideographic":"'), F.col("p_name"), F.lit('"}'))
    json = F.concat(F.lit("{"), F.concat_ws(
        ",", element("00180081", "LO", quoted(name)), element("00280030", "LO", quoted(F.concat(F.lit("["), size, F.lit("] see "), F.col("p_brand")))),
        element("00180022", "PN", person), element("00080032", "DS", size, F.concat(size, F.lit(".5"))),
        element("00282112", "LO", quoted(F.concat(F.lit('["'), F.col("p_brand"), F.lit('"]')))), element("0019100a", "LO", quoted(name), size)), F.lit("}"))
    rows = t.part.select(F.col("p_partkey").cast("string").alias("DicomFilePath"), json.alias("DicomDataset"))
    tables = list(load_template(_WIDE_TEMPLATE).values())
    read = P.flatten(rows, tables)
    parsed = P.flatten(rows.withColumn("m", TG.parse_tags(F.col("DicomDataset"))), tables, tags="m")
    return read.join(parsed, PATH).select(PATH, *[
        F.when(read[c].eqNullSafe(parsed[c]), read[c]).otherwise("the two readers differ").alias(c) for c in read.columns if c != PATH])


@query("select_tags", f"""WITH {V.SQL_TAGSETS} SELECT SOPInstanceUID, CASE WHEN flag = 'RO' THEN '00180050' ELSE '00100020,00180050' END AS tags FROM tagsets""")
def select_tags(t):
    kept = TG.select_tags(TG.parse_tags(F.col("DicomDataset")), ["00100020", "00180050", "00080060"], "^0008")
    return V.tagsets(t).select(SOP, F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("tags"))


@query("elevate", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || '\\' || o_custkey
  WHEN o_orderstatus = 'F' THEN o_orderpriority END AS meaning, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW'
  THEN o_orderpriority || '\\' || o_custkey WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN o_orderpriority END AS low FROM orders""")
def elevate(t):
    """Code meanings out of a sequence: two items, one item, or no sequence."""
    item = lambda c: F.concat(F.lit('{"00080104":{"vr":"LO","val":"'), c.cast("string"), F.lit('"}}'))
    items = F.when(F.col("o_orderstatus") == "O", F.concat(item(F.col("o_orderpriority")), F.lit(","), item(F.col("o_custkey")))) \
             .otherwise(item(F.col("o_orderpriority")))
    text = F.when(F.col("o_orderstatus") == "P", F.lit('{"00080060":{"vr":"CS","val":"CT"}}')).otherwise(
        F.concat(F.lit('{"00089215":{"vr":"SQ","val":['), items, F.lit("]}}")))
    rules = P.load_elevations("""<TagElevationRequestCollection>
      <TagElevationRequest><ColumnName>meaning</ColumnName><ElevationPathway>DerivationCodeSequence->CodeMeaning</ElevationPathway></TagElevationRequest>
      <TagElevationRequest><ColumnName>low</ColumnName><ElevationPathway>DerivationCodeSequence->CodeMeaning</ElevationPathway>
        <Conditional><ConditionalPathway>DerivationCodeSequence->CodeMeaning</ConditionalPathway><ConditionalRegex>^5-</ConditionalRegex></Conditional>
      </TagElevationRequest></TagElevationRequestCollection>""")
    rows = t.orders.select("o_orderkey", TG.parse_tags(text).alias("tags"))
    return P.elevate(rows, rules).drop("tags")


@query("stage_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def stage_distinct(t):
    target = t.customer.select("c_mktsegment", "c_nationkey", F.lit(1).alias("only_there"))
    return P.project_common(t.customer.select("c_name", F.col("c_nationkey").alias("C_NATIONKEY"), "c_mktsegment"), target)


@query("lineage", """SELECT event_id, 'g' || event_id AS guid, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS original_unix,
  'root->u' || user_id || '->e' || event_id AS parents, event_type = 'view' AS from_root FROM events""")
def lineage_headers(t):
    parent = F.struct(F.concat(F.lit("e"), F.col("event_id")).alias("guid"), F.unix_timestamp("ts").alias("original_unix"),
                      lineage.text_to_parents(F.concat(F.lit("root->u"), F.col("user_id"))).alias("parents"))
    child = lineage.child_header(F.col("parent"), F.concat(F.lit("g"), F.col("event_id")), "loader")
    rows = t.events.withColumn("parent", parent).withColumn("h", child)
    asked = F.when(F.col("event_type") == "view", "root").otherwise("nobody")
    return rows.select("event_id", "h.guid", "h.original_unix", lineage.parents_to_text(F.col("h.parents")).alias("parents"),
                       lineage.is_descendant(F.col("h"), asked).alias("from_root"))


@query("relativise", "SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN trim(substr(url, 13), '/\\') END AS path FROM pages")
def relativise(t):
    return t.pages.select("page_id", paths.relativise(F.col("url"), "https://www.").alias("path"))


# --- roll-up and levels ----------------------------------------------------------------


def _messages(t):
    """One message per image; the directory is the study's day folder."""
    return V.files(t).select(STUDY, SERIES, SOP, F.col(PATH).alias("DicomFilePath"),
                             paths.parent_dir(F.col(PATH)).alias("DirectoryPath"), F.md5(SOP).alias("DicomDataset"))


@query("series_rollup", f"""WITH {V.SQL_FILES} SELECT regexp_replace(RelativeFileArchiveURI, '/[^/]*$', '') AS DirectoryPath, SeriesInstanceUID,
  COUNT(*) AS ImagesInSeries, arg_min(StudyInstanceUID, RelativeFileArchiveURI) AS StudyInstanceUID,
  arg_min(md5(SOPInstanceUID), RelativeFileArchiveURI) AS DicomDataset FROM files GROUP BY 1, 2""")
def series_rollup(t):
    return L.series_from_images(_messages(t))


@query("series_recount", f"WITH {V.SQL_FILES} SELECT SeriesInstanceUID, COUNT(*) AS ImagesInSeries FROM files GROUP BY 1")
def series_recount(t):
    return L.recount_series(V.files(t))


@query("modality_groups", """SELECT CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'CT' WHEN p_type = 'LARGE' THEN 'MR' ELSE 'OTHER' END AS modality_group,
  COUNT(*) AS n FROM part GROUP BY 1""")
def modality_groups(t):
    modality = (F.when(F.col("p_type").isin("PROMO", "SMALL"), "CT").when(F.col("p_type") == "LARGE", "MR")
                .when(F.col("p_type") == "MEDIUM", F.lit(None)).otherwise(F.col("p_type")))
    return t.part.groupBy(L.modality_group(modality).alias("modality_group")).agg(F.count("*").alias("n"))


@query("dedupe_batch", """WITH d AS (SELECT doc_id, CASE WHEN source <> 'src1' THEN text END AS text FROM documents)
SELECT MIN(doc_id) AS doc_id, md5(text) AS digest FROM d WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, NULL FROM d WHERE text IS NULL""")
def dedupe_batch(t):
    """Texts once; the rows of one source have none and all stay."""
    rows = t.documents.select("doc_id", F.when(F.col("source") != "src1", F.col("text")).alias("text"))
    return L.dedupe_batch(rows, "text").select("doc_id", F.md5("text").alias("digest"))


_LEVELS = load_template("""
Tables:
- TableName: study
  Columns: [{ColumnName: PatientID}, {ColumnName: StudyInstanceUID, IsPrimaryKey: true}]
- TableName: series
  Columns: [{ColumnName: StudyInstanceUID}, {ColumnName: SeriesInstanceUID, IsPrimaryKey: true}]
- TableName: image
  Columns: [{ColumnName: SeriesInstanceUID}, {ColumnName: SOPInstanceUID, IsPrimaryKey: true}, {ColumnName: IsOriginal}]
""")


def _levels(t):
    return L.split_levels(V.patient_files(t), _LEVELS)


@query("split_study", f"WITH {V.SQL_PATIENT_FILES} SELECT DISTINCT PatientID, StudyInstanceUID FROM images")
def split_study(t):
    return _levels(t)["study"]


@query("split_series", f"WITH {V.SQL_FILES} SELECT DISTINCT StudyInstanceUID, SeriesInstanceUID FROM files")
def split_series(t):
    return L.split_levels(V.files(t), _LEVELS)["series"]


@query("join_levels", f"WITH {V.SQL_PATIENT_FILES} SELECT DISTINCT SOPInstanceUID, SeriesInstanceUID, StudyInstanceUID, PatientID, IsOriginal FROM images")
def join_levels(t):
    levels = _levels(t)
    return L.join_levels(levels["study"], levels["series"], levels["image"])


# --- isolation ---------------------------------------------------------------------------

_ISO = f"""{V.SQL_FILES}, study AS (SELECT DISTINCT StudyInstanceUID, IsPrimary AS age FROM files),
  series AS (SELECT DISTINCT StudyInstanceUID, SeriesInstanceUID FROM files),
  image AS (SELECT DISTINCT SeriesInstanceUID, SOPInstanceUID, IsOriginal FROM files),
  bad_study AS (SELECT StudyInstanceUID FROM study GROUP BY 1 HAVING COUNT(*) > 1),
  bad_series AS (SELECT SeriesInstanceUID FROM series GROUP BY 1 HAVING COUNT(*) > 1),
  bad_image AS (SELECT SOPInstanceUID FROM image GROUP BY 1 HAVING COUNT(*) > 1),
  touched AS (FROM bad_series UNION SELECT SeriesInstanceUID FROM image WHERE SOPInstanceUID IN (FROM bad_image)),
  studies AS (FROM bad_study UNION SELECT StudyInstanceUID FROM series WHERE SeriesInstanceUID IN (FROM touched)),
  all_series AS (FROM touched UNION SELECT SeriesInstanceUID FROM series WHERE StudyInstanceUID IN (FROM studies)),
  hit AS (FROM bad_image UNION SELECT SOPInstanceUID FROM image WHERE SeriesInstanceUID IN (FROM all_series))"""


def _isolated(t):
    """Studies whose images disagree on a study attribute collide.  Rows repeat per image; results are made distinct after the joins."""
    f = V.files(t)
    return L.isolate(f.select(STUDY, F.col("IsPrimary").alias("age")), f.select(STUDY, SERIES), f.select(SERIES, SOP, "IsOriginal"))


@query("isolate_bad", f"WITH {_ISO} SELECT SOPInstanceUID, SeriesInstanceUID, IsOriginal FROM image WHERE SOPInstanceUID IN (FROM hit)")
def isolate_bad(t):
    return _isolated(t).bad["image"].distinct()


@query("isolate_good", f"WITH {_ISO} SELECT SOPInstanceUID, SeriesInstanceUID, IsOriginal FROM image WHERE SOPInstanceUID NOT IN (FROM hit)")
def isolate_good(t):
    return _isolated(t).good["image"].distinct()


@query("isolate_good_series", f"WITH {_ISO} SELECT StudyInstanceUID, SeriesInstanceUID FROM series WHERE SeriesInstanceUID NOT IN (FROM all_series)")
def isolate_good_series(t):
    return _isolated(t).good["series"].distinct()


@query("isolate_bad_study", f"WITH {_ISO} SELECT StudyInstanceUID, age FROM study WHERE StudyInstanceUID IN (FROM studies)")
def isolate_bad_study(t):
    return _isolated(t).bad["study"].distinct()


@query("except_corrupt", f"WITH {V.SQL_FILES} SELECT SOPInstanceUID, SeriesInstanceUID FROM files WHERE SOPInstanceUID NOT IN (SELECT SOPInstanceUID FROM files WHERE NOT IsExtractableToDisk)")
def except_corrupt(t):
    f = V.files(t)
    return L.split_corrupt(f.select(SOP, SERIES), f.where(~F.col("IsExtractableToDisk")).select(SOP), SOP)


# --- reloading ---------------------------------------------------------------------------


def _entries(t):
    """Line items as entries of one archive per study; urgent orders are files."""
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        *V._uids(), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("entry_pos"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.col("l_orderkey"), F.lit(".zip"))).alias("archive"))


_SKIP = """WITH e AS (SELECT l_orderkey || '.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber AS path, l_partkey AS pos, l_returnflag,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN l_orderkey || '.zip' END AS archive FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  store AS (SELECT DISTINCT path FROM e WHERE l_returnflag = 'R'),
  stop AS (SELECT archive, MIN(pos) AS stop FROM e WHERE path IN (FROM store) AND archive IS NOT NULL GROUP BY archive)
SELECT path, archive FROM e LEFT JOIN stop USING (archive) WHERE (archive IS NULL AND path NOT IN (FROM store))
  OR (archive IS NOT NULL AND (stop IS NULL OR pos < stop))"""


@query("skip_existing", _SKIP)
def skip_existing(t):
    entries = _entries(t).select(F.col(SOP).alias("path"), "archive", "entry_pos", "flag")
    store = entries.where(F.col("flag") == "R").select("path")
    return L.skip_existing(entries, store, path="path").select("path", "archive")


@query("skip_existing_indexed", _SKIP)
def skip_existing_indexed(t):
    """The same over a stored list of known paths, opening only the files that can hold one of the batch; the index follows two loads."""
    entries = _entries(t).select(F.col(SOP).alias("path"), "archive", "entry_pos", "flag")
    folder = shared_folder(t.spark, "known")
    store, path = entries.where(F.col("flag") == "R").select("path"), f"{folder}/rows"
    for half in (0, 1):
        store.where(F.pmod(F.xxhash64("path"), F.lit(2)) == half).repartitionByRange(4, "path").write.mode("append").parquet(path)
        known = t.spark.read.schema(store.schema).parquet(path)
        lookup_index.add_files(t.spark, f"{folder}/index", known.inputFiles(), known.schema, ["path"], 16)
    few = lookup_index.cut_down(known, entries, "path", f"{folder}/index", "path")
    return L.skip_existing(entries, few, path="path").select("path", "archive")


@query("replace_conflicts", f"""WITH {V.SQL_FILES}, batch AS (SELECT * FROM files WHERE IsOriginal AND IsPrimary)
SELECT RelativeFileArchiveURI, SOPInstanceUID, 'old' AS source FROM files WHERE RelativeFileArchiveURI NOT IN (SELECT RelativeFileArchiveURI FROM batch)
  AND SOPInstanceUID NOT IN (SELECT SOPInstanceUID FROM batch) UNION ALL SELECT RelativeFileArchiveURI, SOPInstanceUID, 'new' FROM batch""")
def replace_conflicts(t):
    store = V.files(t).select(PATH, SOP, F.lit("old").alias("source"))
    batch = V.files(t).where(F.col("IsOriginal") & F.col("IsPrimary")).select(PATH, SOP, F.lit("new").alias("source"))
    return L.replace_conflicts(store, batch, PATH)


# --- merge ---------------------------------------------------------------------------------

_STAMP = "2024-06-01 12:00:00"


def _merge_sides(t):
    """Orders not urgent are live; the archive's studies are staged over them."""
    live = t.orders.where(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").alias("study"), F.col("o_orderstatus").alias("status"), F.lit("old").alias("MessageGuid"),
        F.col("o_orderdate").alias("valid_from"), F.lit(1).alias("load_run_id"))
    stage = t.lineitem.groupBy(F.col("l_orderkey").alias("study")).agg(
        F.when(F.bool_or(F.col("l_linestatus") == "O"), "O").otherwise("F").alias("status"), F.lit("new").alias("MessageGuid"))
    return live, stage


def _merge(t):
    return L.merge_live(*_merge_sides(t), "study", 2, F.lit(_STAMP).cast("timestamp"))


_MERGE = f"""live AS (SELECT o_orderkey AS study, o_orderstatus AS status, 'old' AS MessageGuid, o_orderdate AS valid_from,
    1 AS load_run_id FROM orders WHERE o_orderpriority <> '1-URGENT'),
  stage AS (SELECT l_orderkey AS study, MAX(l_linestatus) AS status FROM lineitem GROUP BY 1)"""
_NEW = f"s.study, s.status, 'new' AS MessageGuid, TIMESTAMP '{_STAMP}' AS valid_from, 2 AS load_run_id"


@query("merge_inserted", f"WITH {_MERGE} SELECT {_NEW} FROM stage s WHERE study NOT IN (SELECT study FROM live)")
def merge_inserted(t):
    return _merge(t).inserted


@query("merge_updated", f"WITH {_MERGE} SELECT {_NEW} FROM stage s JOIN live l USING (study) WHERE s.status <> l.status")
def merge_updated(t):
    return _merge(t).updated


@query("merge_archive", f"WITH {_MERGE} SELECT l.* FROM stage s JOIN live l USING (study) WHERE s.status <> l.status")
def merge_archive(t):
    return _merge(t).archived


@query("merge_live", f"""WITH {_MERGE}, changed AS (SELECT study FROM stage s JOIN live l USING (study) WHERE s.status <> l.status)
SELECT * FROM live WHERE study NOT IN (FROM changed) UNION ALL
SELECT {_NEW} FROM stage s WHERE study IN (FROM changed) OR study NOT IN (SELECT study FROM live)""")
def merge_live(t):
    return _merge(t).live


def _bucketed(t):
    """The same merge through the bucketed table, committed once; its folder and the schema of its rows."""
    live, stage = _merge_sides(t)
    folder = shared_folder(t.spark, "live")
    sinks.write_buckets(live, folder, "study", 16)
    sinks.merge_buckets(stage, folder, live.schema, "study", 16,
                        lambda old, new: L.merge_live(old, new, "study", 2, F.lit(_STAMP).cast("timestamp"), pin_changes=True))
    return folder, live.schema


_CHANGED = "changed AS (SELECT study FROM stage s JOIN live l USING (study) WHERE s.status <> l.status)"


@query("merge_bucket_live", f"""WITH {_MERGE}, {_CHANGED}
SELECT * FROM live WHERE study NOT IN (FROM changed) UNION ALL
SELECT {_NEW} FROM stage s WHERE study IN (FROM changed) OR study NOT IN (SELECT study FROM live)""")
def merge_bucket_live(t):
    folder, schema = _bucketed(t)
    return sinks.read_buckets(t.spark, folder, schema)


@query("merge_bucket_archive", f"WITH {_MERGE} SELECT l.* FROM stage s JOIN live l USING (study) WHERE s.status <> l.status")
def merge_bucket_archive(t):
    folder, schema = _bucketed(t)
    return sinks.read_part(t.spark, folder, "archive", schema)


def _partial(t, repeat):
    """The stage knows the key and the status, not the clerk; ``repeat`` stages some keys twice."""
    live = t.orders.where(F.col("o_orderpriority") != "1-URGENT").select(
        F.col("o_orderkey").alias("study"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"),
        F.col("o_orderdate").alias("valid_from"), F.lit(1).alias("load_run_id"))
    stage = t.lineitem.groupBy(F.col("l_orderkey").alias("study")).agg(F.max("l_linestatus").alias("status"))
    if repeat:
        stage = t.lineitem.select(F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("study"), F.col("l_linestatus").alias("status")).distinct()
    return L.merge_live(live, stage, "study", 2, F.lit(_STAMP).cast("timestamp"))


_PARTIAL = """live AS (SELECT o_orderkey AS study, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderpriority <> '1-URGENT'),
  stage AS (SELECT l_orderkey AS study, MAX(l_linestatus) AS status FROM lineitem GROUP BY 1)"""


@query("merge_partial_columns", f"""WITH {_PARTIAL} SELECT study, COALESCE(s.status, l.status) AS status, CAST(l.owner AS VARCHAR) AS owner FROM live l FULL JOIN stage s USING (study)""")
def merge_partial_columns(t):
    return _partial(t, False).live.select("study", "status", F.col("owner").cast("string").alias("owner"))


@query("merge_repeated_keys", """WITH given AS (SELECT DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS study, l_linestatus AS status FROM lineitem)
SELECT CAST(study AS VARCHAR) AS study, status FROM given WHERE study IS NULL OR study IN (SELECT study FROM given WHERE study IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)""")
def merge_repeated_keys(t):
    """Staged rows that are refused: without a key, or of a key staged twice."""
    return _partial(t, True).refused.select(F.col("study").cast("string").alias("study"), "status")


_CHECKED = """checked AS (SELECT DISTINCT CASE WHEN l_returnflag <> 'N' OR l_linenumber > 1 THEN l_orderkey END AS k, l_partkey AS i,
    CASE WHEN l_quantity > 49 THEN 'broken' END AS bad FROM lineitem),
  marked AS (SELECT k, i, COALESCE(bad, CASE WHEN k IS NULL THEN 'no key' END) AS bad FROM checked),
  parts AS (SELECT k, i, COALESCE(bad, CASE WHEN k IN (SELECT k FROM marked WHERE bad IS NOT NULL AND k IS NOT NULL)
    THEN 'shares its key with a bad row' END) AS bad FROM marked)"""


def _split(t):
    rows = t.lineitem.select(F.when((F.col("l_returnflag") != "N") | (F.col("l_linenumber") > 1), F.col("l_orderkey")).alias("k"), F.col("l_partkey").alias("i"),
                             F.when(F.col("l_quantity") > 49, F.lit("broken")).alias("bad")).distinct()
    return split_load(rows, "k")


@query("load_batch_good", f"WITH {_CHECKED} SELECT k, i FROM parts WHERE bad IS NULL")
def load_batch_good(t):
    return _split(t)[0]


@query("load_batch_bad", f"WITH {_CHECKED} SELECT CAST(k AS VARCHAR) AS k, i, bad FROM parts WHERE bad IS NOT NULL")
def load_batch_bad(t):
    return _split(t)[1].withColumn("k", F.col("k").cast("string"))


@query("reconcile", f"WITH {V.SQL_FILES} SELECT SOPInstanceUID, RelativeFileArchiveURI FROM files WHERE SOPInstanceUID NOT IN (SELECT SOPInstanceUID FROM files WHERE IsPrimary)")
def reconcile(t):
    f = V.files(t)
    return L.reconcile(f.select(SOP, PATH), f.where("IsPrimary"))


@query("reconcile_changes", """WITH s AS (SELECT o_orderkey AS k, o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_orderkey % 11 <> 0),
  l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS owner, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status
    FROM orders WHERE o_orderkey % 13 <> 0)
SELECT COALESCE(s.k, l.k) AS k, CASE WHEN l.k IS NULL THEN 'missing' WHEN s.k IS NULL THEN 'surplus' ELSE 'changed' END AS kind, CAST(s.owner AS VARCHAR) AS stored_owner, l.status AS live_status
FROM s FULL JOIN l ON s.k = l.k WHERE l.k IS NULL OR s.k IS NULL OR s.owner IS DISTINCT FROM l.owner OR s.status IS DISTINCT FROM l.status""")
def reconcile_changes(t):
    """Missing, changed and surplus rows of a store and a live table, from the buckets whose digests differ."""
    rows = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status"))
    live = rows.where("k % 13 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("owner") + 1).otherwise(F.col("owner")).alias("owner"),
                                            F.when(F.col("k") % 5 != 0, F.col("status")).alias("status"))
    return RC.reconcile_changes(rows.where("k % 11 <> 0"), live, "k", ["owner", "status"], 4096).select(
        "k", "kind", F.col("stored.owner").cast("string").alias("stored_owner"), F.col("live.status").alias("live_status"))
