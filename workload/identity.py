"""Identifier, de-identification and mapping-update queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions import tags as TG
from radloom.operators import deid as D, identity as I, updates as U
from radloom.operators.validate import UpdateSpec
from radloom.plans.propagation import propagate
from radloom.schemas import SOP
from workload import views as V
from workload.registry import query

# --- identifiers ---------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS pid FROM orders"


def _patients(t):
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("pid"))


@query("swap_lookup", f"""WITH {V.SQL_MAPPING} SELECT o_orderkey, replacement,
  CASE WHEN replacement IS NULL THEN 'No match found for ''' || pid || '''' END AS fail_reason
FROM ({_ORDERS}) LEFT JOIN mapping ON pid = swap""")
def swap_lookup(t):
    return I.swap_lookup(_patients(t), "pid", V.mapping(t)).drop("pid")


@query("swap_fallback", f"""WITH {V.SQL_MAPPING}, {V.SQL_SURROGATES}
SELECT o_orderkey, COALESCE(replacement, guid) AS replacement FROM ({_ORDERS}) LEFT JOIN mapping m ON pid = m.swap
LEFT JOIN surrogates s ON pid = s.swap""")
def swap_fallback(t):
    return I.swap_with_fallback(_patients(t), "pid", V.mapping(t), V.surrogates(t)).select("o_orderkey", "replacement")


@query("allocate_surrogates", """SELECT swap, md5('new' || swap) AS guid FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS swap FROM orders)
WHERE swap NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0)""")
def allocate_surrogates(t):
    return I.allocate_surrogates(_patients(t), "pid", V.surrogates(t), max_length=10,
                                 surrogate=F.md5(F.concat(F.lit("new"), F.col("swap"))))


@query("swap_stats", f"""WITH {V.SQL_MAPPING} SELECT CASE WHEN length(trim(COALESCE(pid, ''))) = 0 THEN 'invalid'
  WHEN replacement IS NULL THEN 'fail' ELSE 'success' END AS outcome, COUNT(*) AS n
FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE CAST(o_custkey AS VARCHAR) END AS pid FROM orders)
LEFT JOIN mapping ON pid = swap GROUP BY 1""")
def swap_stats(t):
    ids = t.orders.select(F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_custkey").cast("string")).alias("pid"))
    return I.swap_stats(I.swap_lookup(ids, "pid", V.mapping(t)), "pid")


@query("swap_patient_id", f"""WITH {V.SQL_TAGSETS}, {V.SQL_MAPPING}
SELECT SOPInstanceUID, CASE WHEN flag IN ('RO') THEN 'Dataset did not contain PatientID' WHEN flag = 'RF' THEN 'PatientID was blank'
  WHEN flag = 'NF' THEN 'multiple values for PatientID' WHEN replacement IS NULL THEN 'No match found for ''' || PatientID || '''' END AS fail_reason,
  CASE WHEN flag IN ('AF', 'AO', 'NO') AND replacement IS NOT NULL THEN replacement WHEN flag = 'AF' THEN PatientID
    WHEN flag = 'AO' THEN PatientID || '\\' || PatientID WHEN flag = 'NF' THEN PatientID || '\\x' WHEN flag = 'NO' THEN PatientID
    WHEN flag = 'RF' THEN '  ' END AS patient,
  day FROM tagsets LEFT JOIN mapping ON PatientID = swap""".replace("\\\\", "\\"))
def swap_patient_id(t):
    parsed = V.tagsets(t).select(SOP, TG.parse_tags(F.col("DicomDataset")).alias("tags"))
    swapped = I.swap_patient_id(parsed, V.mapping(t))
    return swapped.select(SOP, "fail_reason", TG.tag_text(F.col("tags"), TG.PATIENT_ID).alias("patient"),
                          TG.tag_text(F.col("tags"), "00080020").alias("day"))


@query("lookup_swapper", """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN md5(CAST(c_custkey AS VARCHAR)) END AS replacement,
  CASE WHEN c_custkey % 3 = 0 THEN concat('No match found for ', chr(39), c_custkey, chr(39)) END AS fail_reason FROM customer""")
def lookup_swapper(t):
    """A swapper by its protocol, over a checked map."""
    rows = t.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("id"))
    mapping = rows.where(F.col("c_custkey") % 3 != 0).select(F.col("id").alias("swap"), F.md5("id").alias("replacement"))
    return I.LookupSwapper(I.require_unique(mapping)).swap(rows, "id").drop("id")


# --- de-identification -----------------------------------------------------------------

SCRIPT = """<script>
 <p t="UIDROOT">9999</p> <p t="SITEID">99</p>
 <e en="T" t="00080020" n="StudyDate">{date}</e>
 <e en="T" t="00080050" n="AccessionNumber">@remove()</e>
 <e en="T" t="00080060" n="Modality">@require()</e>
 <e en="T" t="00080070" n="Manufacturer">@require()</e>
 <e en="T" t="00100020" n="PatientID">{patient}</e>
 <e en="F" t="00180050" n="SliceThickness">@remove()</e>
 <e en="T" t="0020000d" n="StudyInstanceUID">{study}</e>
 <e en="T" t="00120062" n="PatientIdentityRemoved">@always()YES</e>
 <k en="T" t="0018">x</k>
 <r en="T" t="overlays">x</r>
 <r en="T" t="privategroups">x</r>
 <r en="T" t="unspecifiedelements">x</r>
</script>"""
SALT = "pepper"


def _deid(t, **actions):
    parsed = V.tagsets(t).select(SOP, "flag", TG.parse_tags(F.col("DicomDataset")).alias("tags"))
    return D.deidentify(parsed, D.load_script(SCRIPT.format(**actions)), SALT)


def _tag(tag, name):
    return F.try_element_at("tags", F.lit(tag))["val"].alias(name)


@query("deid_actions", f"""WITH {V.SQL_TAGSETS}
SELECT SOPInstanceUID, CASE WHEN flag = 'RO' THEN '00080020,00080060,00080070,00120062,00180050,0020000D'
  ELSE '00080020,00080060,00080070,00100020,00120062,00180050,0020000D' END AS tags,
  '' AS day, modality, '' AS maker, CASE WHEN flag <> 'RO' THEN 'SUBJECT' END AS patient, CAST(thickness AS VARCHAR) AS thickness,
  'YES' AS removed FROM tagsets""")
def deid_actions(t):
    out = _deid(t, date="@empty()", patient="SUBJECT", study="@keep()")
    return out.select(SOP, F.array_join(F.array_sort(F.map_keys("tags")), ",").alias("tags"), _tag("00080020", "day"),
                      _tag("00080060", "modality"), _tag("00080070", "maker"), _tag("00100020", "patient"),
                      _tag("00180050", "thickness"), _tag("00120062", "removed"))


_SHA = "sha256('pepper' || {})"
_TEN = "upper(substr(sha256('pepper' || {}), 1, 10))"


@query("deid_hash", f"""WITH {V.SQL_TAGSETS}
SELECT SOPInstanceUID, '9999.' || CAST(('0x' || substr({_SHA.format('StudyInstanceUID')}, 1, 15))::BIGINT AS VARCHAR)
  || lpad(CAST(('0x' || substr({_SHA.format('StudyInstanceUID')}, 16, 15))::BIGINT AS VARCHAR), 19, '0') AS study,
  CASE WHEN flag IN ('AF', 'NO') THEN {_TEN.format('PatientID')} WHEN flag = 'AO' THEN {_TEN.format('PatientID')} || '\\' || {_TEN.format('PatientID')}
    WHEN flag = 'NF' THEN {_TEN.format('PatientID')} || '\\' || {_TEN.format("'x'")} WHEN flag = 'RF' THEN {_TEN.format("'  '")} END AS patient FROM tagsets""")
def deid_hash(t):
    """Patients and study UIDs hashed value by value, in every spelling of a tag set."""
    out = _deid(t, date="@remove()", patient="@hash(this,10)", study="@hashuid(@UIDROOT,this)")
    return out.select(SOP, _tag("0020000D", "study"), _tag("00100020", "patient"))


@query("deid_nested", f"""SELECT o_orderkey, {_TEN.format('CAST(o_custkey AS VARCHAR)')} AS outer_patient,
  CASE WHEN o_orderstatus <> 'P' THEN {_TEN.format('CAST(o_custkey AS VARCHAR)')} END AS inner_patient,
  CASE WHEN o_orderstatus <> 'P' THEN '00100020,00180050' END AS inner_tags FROM orders""")
def deid_nested(t):
    """The patient inside a kept sequence is hashed as outside of it, in both dialects; unlisted elements of the item go."""
    patient = F.col("o_custkey").cast("string")
    value = lambda v: F.when(F.col("o_orderstatus") == "O", F.concat(F.lit('{"vr":"LO","Value":["'), v, F.lit('"]}'))).otherwise(
        F.concat(F.lit('{"vr":"LO","val":"'), v, F.lit('"}')))
    item = F.concat(F.lit('{"00100020":'), value(patient), F.lit(',"00100010":'), value(F.lit("a name")), F.lit(',"00180050":'), value(F.lit("3")), F.lit("}"))
    inner = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(',"00089215":{"vr":"SQ","Value":['), item, F.lit("]}"))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit(',"00089215":{"vr":"SQ","val":['), item, F.lit("]}"))).otherwise(F.lit(""))
    rows = t.orders.select("o_orderkey", TG.parse_tags(F.concat(F.lit('{"00100020":'), value(patient), inner, F.lit("}"))).alias("tags"))
    script = D.load_script(SCRIPT.format(date="@remove()", patient="@hash(this,10)", study="@keep()").replace(
        "<k ", '<e en="T" t="00089215" n="x">@keep()</e><k ', 1))
    items = F.from_json(_tag("00089215", "x"), "array<map<string,struct<vr:string,val:string>>>")
    return D.deidentify(rows, script, SALT).select(
        "o_orderkey", _tag("00100020", "outer_patient"), items[0]["00100020"]["val"].alias("inner_patient"),
        F.when(items.isNotNull(), F.array_join(F.array_sort(F.map_keys(items[0])), ",")).alias("inner_tags"))


@query("deid_names", """SELECT s_suppkey, concat('Doe^', s_name) AS person, concat('Doe^', s_name) AS inner_person,
  CASE s_suppkey % 4 WHEN 0 THEN concat('[', s_name) WHEN 1 THEN concat('[{see ', s_name, '} ok]') WHEN 2 THEN concat('["', s_name, '"]')
    ELSE concat('[a', chr(92), s_name) END AS place, '00081030,00089215,00100010' AS tags, '00081030,00100010' AS inner_tags FROM supplier""")
def deid_names(t):
    """Kept names and kept texts that look like lists, outside and inside of a sequence, in both dialects; private elements go however they are spelled."""
    name, second = F.col("s_name"), F.col("s_suppkey") % 2 == 0
    place = (F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("["), name)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("[{see "), name, F.lit("} ok]")))
             .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit('["'), name, F.lit('"]'))).otherwise(F.concat(F.lit("[a\\"), name)))
    quoted = F.regexp_replace(F.to_json(F.struct(place.alias("x"))), r'^\{"x":(.*)\}$', "$1")
    person = F.concat(F.lit('{"Alphabetic":"Doe^'), name, F.lit('"}'))
    value = lambda plain: F.when(second, F.concat(F.lit('"Value":['), plain, F.lit("]}"))).otherwise(F.concat(F.lit('"val":'), plain, F.lit("}")))
    elements = F.concat(F.lit('"00100010":{"vr":"PN",'), value(person), F.lit(',"00081030":{"vr":"LO",'), value(quoted),
                        F.lit(',"000b1001":{"vr":"LO","val":"secret"},"000B1001":{"vr":"LO","val":"secret"}'))
    item = F.concat(F.lit(',"00089215":{"vr":"SQ",'), F.when(second, F.lit('"Value":[{')).otherwise('"val":[{'), elements, F.lit("}]}"))
    rows = t.supplier.select("s_suppkey", TG.parse_tags(F.concat(F.lit("{"), elements, item, F.lit("}"))).alias("tags"))
    script = D.load_script("<script>" + "".join(f'<e en="T" t="{tag}">@keep()</e>' for tag in ("00100010", "00081030", "00089215"))
                           + '<r en="T" t="privategroups"/></script>')
    items = TG.parse_items(_tag("00089215", "x"))
    listed = lambda tags: F.array_join(F.array_sort(F.map_keys(tags)), ",")
    return D.deidentify(rows, script, SALT).select(
        "s_suppkey", _tag("00100010", "person"), items[0]["00100010"]["val"].alias("inner_person"),
        F.when(_tag("00081030", "x") == items[0]["00081030"]["val"], _tag("00081030", "x")).alias("place"),
        listed(F.col("tags")).alias("tags"), listed(items[0]).alias("inner_tags"))


@query("deid_dates", f"""WITH {V.SQL_TAGSETS}
SELECT SOPInstanceUID, strftime(CAST(l_shipdate AS DATE) - CAST(('0x' || substr({_SHA.format('StudyInstanceUID')}, 1, 8))::BIGINT % 3650 AS INTEGER), '%Y%m%d') AS day
FROM tagsets""")
def deid_dates(t):
    """Dates moved by a shift that belongs to the study."""
    out = _deid(t, date="@hashdate(this,StudyInstanceUID)", patient="@remove()", study="@keep()")
    return out.select(SOP, _tag("00080020", "day"))


@query("anon_status", """SELECT event_id, CASE WHEN event_type = 'click' THEN event_id || '-an.dcm' END AS output_path,
  CASE WHEN event_type = 'click' THEN 'verify' ELSE 'noverify' END AS route FROM events""")
def anon_status(t):
    done = t.events.select("event_id", F.concat(F.col("event_id"), F.lit("-an.dcm")).alias("output_path"),
                           F.when(F.col("event_type") == "click", "Anonymised").otherwise("ErrorWontRetry").alias("status"))
    return D.anon_status(done).drop("status")


# --- mapping updates -----------------------------------------------------------------------

SINCE = "2024-01-10"


def _current(t):
    """Newest mapping of each user: valid from the user's last signup."""
    e = t.events.where(F.col("event_type") == "signup")
    return e.groupBy(F.col("user_id").cast("string").alias("swap")).agg(
        F.max("ts").alias("valid_from"), F.md5(F.max("event_id").cast("string")).alias("replacement"))


def _archive(t):
    """Earlier mappings: purchases; a low value stands for an archived null."""
    return t.events.where(F.col("event_type") == "purchase").select(
        F.col("user_id").cast("string").alias("swap"), F.col("ts").alias("valid_from"),
        F.when(F.col("value") >= 10, F.md5(F.col("event_id").cast("string"))).alias("replacement"))


def _handed_out(t):
    return t.events.where(F.col("event_type") == "error").groupBy(F.col("user_id").cast("string").alias("swap")).agg(
        F.md5(F.min("event_id").cast("string")).alias("guid"))


_SQL_ARCHIVE = """archive AS (SELECT CAST(user_id AS VARCHAR) AS swap, ts AS valid_from,
  CASE WHEN value >= 10 THEN md5(CAST(event_id AS VARCHAR)) END AS replacement FROM events WHERE event_type = 'purchase'),
latest AS (SELECT swap, replacement AS old FROM (SELECT *, row_number() OVER (PARTITION BY swap ORDER BY valid_from DESC) AS rn FROM archive) WHERE rn = 1)"""


@query("latest_archive", f"WITH {_SQL_ARCHIVE} SELECT swap, old FROM latest")
def latest_archive(t):
    return U.latest_archive(_archive(t))


@query("detect_updates", f"""WITH {_SQL_ARCHIVE}, cur AS (SELECT CAST(user_id AS VARCHAR) AS swap, MAX(ts) AS valid_from,
    md5(CAST(MAX(event_id) AS VARCHAR)) AS want FROM events WHERE event_type = 'signup' GROUP BY 1),
  changed AS (SELECT * FROM cur WHERE valid_from >= TIMESTAMP '{SINCE} 00:00:00'),
  guids AS (SELECT CAST(user_id AS VARCHAR) AS swap, md5(CAST(MIN(event_id) AS VARCHAR)) AS guid FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT swap, CAST(1 AS INTEGER) AS step, old AS have, want FROM changed JOIN latest USING (swap)
UNION ALL SELECT swap, 2, guid, want FROM changed JOIN guids USING (swap)""")
def detect_updates(t):
    return U.detect_updates(_current(t), _archive(t), _handed_out(t), F.lit(SINCE).cast("timestamp"))


_SPEC = UpdateSpec(["o_orderstatus", "o_totalprice"], ["P", 100000.0], ["o_orderpriority"], ["9-NONE"], ["=", ">="])


@query("apply_update", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice >= 100000.0 THEN '9-NONE'
  ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def apply_update(t):
    return U.apply_updates({"orders": t.orders, "customer": t.customer}, _SPEC)["orders"].select("o_orderkey", "o_orderpriority")


@query("apply_update_count", """SELECT 'orders' AS "table", COUNT(*) AS affected FROM orders WHERE o_orderstatus = 'P' AND o_totalprice >= 100000.0""")
def apply_update_count(t):
    return U.affected_rows({"orders": t.orders, "customer": t.customer}, _SPEC)


@query("update_operators", """SELECT o_orderkey, o_orderstatus = 'P' AS eq, o_totalprice <> 5 AS ne, o_totalprice < 90000 AS lt,
  o_totalprice >= 90000 AS ge, o_orderpriority LIKE '%O%' AS lk, FALSE AS eq_null, p IS NULL AS is_null, p IS NOT NULL AS not_null
FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS p FROM orders)""")
def update_operators(t):
    one = lambda name, value, op: U.where_expr(UpdateSpec([name], [value], ["o_custkey"], [0], [op]))
    rows = t.orders.withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return rows.select(
        "o_orderkey", one("o_orderstatus", "P", None).alias("eq"), one("o_totalprice", 5, "<>").alias("ne"),
        one("o_totalprice", 90000, "<").alias("lt"), one("o_totalprice", 90000, ">=").alias("ge"),
        one("o_orderpriority", "%O%", "like").alias("lk"), one("p", None, "=").alias("eq_null"),
        one("p", None, "is").alias("is_null"), one("p", None, "IS NOT").alias("not_null"))


def _pairs(t):
    """An update per order: its customer's value becomes one drawn from its price."""
    return t.orders.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("have"),
                           F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 500)).alias("want"))


@query("update_chain", """WITH p AS (SELECT o_orderkey AS seq, o_custkey AS have,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 500) AS BIGINT) END AS want FROM orders),
  moved AS (WITH RECURSIVE walk(origin, held, seq, done) AS (
    SELECT c_custkey, c_custkey, CAST(-1 AS BIGINT), FALSE FROM customer
    UNION ALL SELECT origin, p.want, p.seq, p.want IS NULL FROM walk JOIN p ON p.have = walk.held AND p.seq = (
      SELECT MIN(q.seq) FROM p q WHERE q.have = walk.held AND q.seq > walk.seq) WHERE NOT done)
  SELECT origin, arg_max(struct_pack(v := held), seq) AS last FROM walk GROUP BY origin)
SELECT origin AS c_custkey, CAST(last.v AS VARCHAR) AS value FROM moved""")
def update_chain(t):
    resolved = U.resolve_chain(_pairs(t))
    rows = t.customer.select("c_custkey", F.col("c_custkey").alias("value"))
    return U.apply_chain(rows, "value", resolved).select("c_custkey", F.col("value").cast("string").alias("value"))


@query("update_audit", """WITH p AS (SELECT o_orderkey AS seq, o_custkey AS have,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 500) AS BIGINT) END AS want FROM orders),
  steps AS (WITH RECURSIVE walk(origin, held, seq, done) AS (
    SELECT id, id, CAST(-1 AS BIGINT), FALSE FROM (SELECT c_custkey AS id FROM customer UNION SELECT user_id FROM events)
    UNION ALL SELECT origin, p.want, p.seq, p.want IS NULL FROM walk JOIN p ON p.have = walk.held AND p.seq = (
      SELECT MIN(q.seq) FROM p q WHERE q.have = walk.held AND q.seq > walk.seq) WHERE NOT done)
  SELECT origin, COUNT(*) - 1 AS n FROM walk GROUP BY origin)
SELECT 'customer' AS "table", (SELECT COUNT(*) FROM p) AS queries, CAST(SUM(n) AS BIGINT) AS affected FROM customer JOIN steps ON origin = c_custkey
UNION ALL SELECT 'events', (SELECT COUNT(*) FROM p), CAST(SUM(n) AS BIGINT) FROM events JOIN steps ON origin = user_id""")
def update_audit(t):
    """Updates sent, and rows affected by each in its order, cascades included."""
    tables = {"customer": t.customer.select(F.col("c_custkey").alias("id")), "events": t.events.select(F.col("user_id").alias("id"))}
    return U.update_audit(tables, "id", _pairs(t))


@query("propagate", f"""WITH {_SQL_ARCHIVE}, cur AS (SELECT CAST(user_id AS VARCHAR) AS swap, MAX(ts) AS valid_from,
    md5(CAST(MAX(event_id) AS VARCHAR)) AS want FROM events WHERE event_type = 'signup' GROUP BY 1),
  changed AS (SELECT * FROM cur WHERE valid_from >= TIMESTAMP '{SINCE} 00:00:00'),
  guids AS (SELECT CAST(user_id AS VARCHAR) AS swap, md5(CAST(MIN(event_id) AS VARCHAR)) AS guid FROM events WHERE event_type = 'error' GROUP BY 1),
  moves AS (SELECT old AS have, want FROM changed JOIN latest USING (swap) WHERE old IS NOT NULL
    UNION ALL SELECT guid, want FROM changed JOIN guids USING (swap))
SELECT event_id, COALESCE(want, md5(CAST(event_id AS VARCHAR))) AS PatientID FROM events LEFT JOIN moves ON have = md5(CAST(event_id AS VARCHAR))""")
def propagated(t):
    """From the changed map to the table that holds replaced identifiers."""
    live = t.events.select("event_id", F.md5(F.col("event_id").cast("string")).alias("PatientID"))
    return propagate(_current(t), _archive(t), _handed_out(t), F.lit(SINCE).cast("timestamp"), {"events": live}, "PatientID")["events"]
