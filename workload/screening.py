"""Personal-data screening queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.operators import screening as S
from workload import views as V
from workload.registry import query

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
CARD = "[0-9]{16}"
ADDRESS = r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"

RULES = S.load_rules(f"""
BasicRules:
- {{Action: Ignore, IfColumn: lang}}
- {{Action: Ignore, IfColumn: source, IfPattern: '^src[0-4]$'}}
- {{Action: Report, IfColumn: source, IfPattern: '^SRC', As: Organization}}
- {{Action: Report, IfPattern: '{EMAIL}', As: Person}}
- {{Action: Report, IfPattern: '{CARD}', As: PrivateIdentifier}}
- {{Action: Report, IfPattern: '{ADDRESS}', As: Location, CaseSensitive: true}}
""")


def _cells(t):
    return S.to_cells(t.documents.select("doc_id", "text", "lang", "source"), "doc_id")


_FAIL = f"""cells AS (SELECT doc_id AS resource, 'text' AS col, text AS value FROM documents UNION ALL SELECT doc_id, 'lang', lang FROM documents
    UNION ALL SELECT doc_id, 'source', source FROM documents),
  hits AS (SELECT *, CASE WHEN col = 'lang' THEN NULL WHEN col = 'source' AND regexp_matches(value, '(?i)^src[0-4]$') THEN NULL
    WHEN col = 'source' AND regexp_matches(value, '(?i)^SRC') THEN 'Organization' WHEN regexp_matches(value, '{EMAIL}') THEN 'Person'
    WHEN regexp_matches(value, '{CARD}') THEN 'PrivateIdentifier' WHEN regexp_matches(value, '{ADDRESS}') THEN 'Location' END AS class FROM cells),
  fails AS (SELECT *, CASE class WHEN 'Organization' THEN '(?i)^SRC' WHEN 'Person' THEN '{EMAIL}' WHEN 'PrivateIdentifier' THEN '{CARD}'
    ELSE '{ADDRESS}' END AS pat FROM hits WHERE class IS NOT NULL),
  parts AS (SELECT resource, col, value, class, CASE class WHEN 'Organization' THEN regexp_extract_all(value, '(?i)^SRC')
    WHEN 'Person' THEN regexp_extract_all(value, '{EMAIL}') WHEN 'PrivateIdentifier' THEN regexp_extract_all(value, '{CARD}')
    ELSE regexp_extract_all(value, '{ADDRESS}') END AS words FROM fails)"""


_ODD = S.load_rules("""
BasicRules:
- {Action: Ignore, IfPattern: '^x(y)z$'}
- {Action: Ignore, IfPattern: '^([a-z])[a-z]*\\1$'}
- {Action: Ignore, IfPattern: '^(?:for|und)$'}
- {Action: Report, IfPattern: '^[a-zA-Z]+$', As: Person}
""")


@query("screen_backrefs", """WITH w AS (SELECT doc_id, string_split(text, ' ')[1] AS word FROM documents)
SELECT doc_id, word, regexp_full_match(word, '[a-zA-Z]+') AND NOT (length(word) > 1 AND regexp_full_match(word, '[a-zA-Z]+') AND lower(word)[1] = lower(word)[-1])
  AND lower(word) NOT IN ('xyz', 'for', 'und') AS reported FROM w""")
def screen_backrefs(t):
    """Neighbouring Ignore rules with groups of their own: a back-reference still means its own group."""
    words = t.documents.select("doc_id", F.split("text", " ")[0].alias("word"))
    cells = words.select(F.col("doc_id").cast("string").alias("resource"), F.lit("word").alias("column"), F.col("word").alias("value"))
    hit = S.screen(cells, _ODD).select(F.col("resource").cast("long").alias("doc_id"), F.lit(True).alias("hit"))
    return words.join(hit, "doc_id", "left").select("doc_id", "word", F.coalesce("hit", F.lit(False)).alias("reported"))


@query("screen_rules", f"""WITH {_FAIL} SELECT resource, col AS "column", class AS first_class, CAST(len(words) AS BIGINT) AS n_parts,
  array_to_string(words, '|') AS words, CAST(instr(value, words[1]) - 1 AS BIGINT) AS first_offset FROM parts""")
def screen_rules(t):
    p = F.element_at("parts", 1)
    return S.screen(_cells(t), RULES).select(
        "resource", "column", p["Classification"].alias("first_class"), F.size("parts").cast("long").alias("n_parts"),
        F.array_join(F.transform("parts", lambda x: x["Word"]), "|").alias("words"), p["Offset"].cast("long").alias("first_offset"))


ALLOW = S.load_allow_rules("""
WhiteListRules:
- {Action: Ignore, IfPartPattern: '^SRC', As: Organization}
- {Action: Ignore, IfPartPattern: '^1', As: Location}
- {Action: Ignore, IfPartPattern: '^[a-m]', IfColumn: text, As: Person}
- {Action: Ignore, IfPartPattern: '^4', IfPattern: 'e'}
""")


@query("allowlist_filter", f"""WITH {_FAIL}, kept AS (SELECT resource, col, value, list_filter(words, lambda w: NOT (
    (class = 'Organization' AND regexp_matches(w, '(?i)^SRC')) OR (class = 'Location' AND regexp_matches(w, '^1'))
    OR (class = 'Person' AND col = 'text' AND regexp_matches(w, '(?i)^[a-m]')) OR (regexp_matches(w, '^4') AND regexp_matches(value, '(?i)e')))) AS words FROM parts)
SELECT resource, col AS "column", array_to_string(words, '|') AS words FROM kept WHERE len(words) > 0
  AND value NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def allowlist_filter(t):
    """Part rules, then whole values listed: texts with a toxic label."""
    kept = S.filter_failures(S.screen(_cells(t), RULES), ALLOW)
    listed = t.documents.join(t.labels.where(F.col("toxic") == 1), "doc_id").select("text")
    return S.drop_listed(kept, listed).select(
        "resource", "column", F.array_join(F.transform("parts", lambda x: x["Word"]), "|").alias("words"))


@query("find_chi", f"""WITH {V.SQL_FILES}, c AS (SELECT SOPInstanceUID, 'id ' || lpad(CAST(CAST(l_quantity * 60 AS INTEGER) AS VARCHAR), 4, '0') || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS a,
    lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || 'x' AS b, lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '.' AS c
  FROM (SELECT *, l_orderkey || '.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber AS SOPInstanceUID FROM lineitem))
SELECT SOPInstanceUID AS sop, CASE WHEN regexp_matches(a, '\\b[0-3][0-9][0-1][0-9][0-9]{{6}}\\b') THEN 'Found chi in field a'
  WHEN regexp_matches(b, '\\b[0-3][0-9][0-1][0-9][0-9]{{6}}\\b') THEN 'Found chi in field b'
  WHEN regexp_matches(c, '\\b[0-3][0-9][0-1][0-9][0-9]{{6}}\\b') THEN 'Found chi in field c' END AS problem FROM c""")
def find_chi(t):
    """Numbers padded to ten digits: some look like the identifier."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    rows = t.lineitem.select(
        F.struct(F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("sop")).alias("k"),
        F.concat(F.lit("id "), pad((F.col("l_quantity") * 60).cast("int"), 4), pad(F.col("l_partkey"), 6)).alias("a"),
        F.concat(pad(F.col("l_suppkey"), 10), F.lit("x")).alias("b"),
        F.concat(pad(F.col("l_partkey"), 10), F.lit(".")).alias("c"))
    return S.find_chi(rows).select("k.sop", "problem")


@query("find_chi_text", r"""SELECT 'doc' || doc_id AS id, CASE WHEN regexp_matches(text, '\b[0-3][0-9][0-1][0-9][0-9]{6}\b') THEN 'Found chi in field text' END AS problem FROM documents
UNION ALL SELECT 'conv' || conv_id || '.' || turn, CASE WHEN regexp_matches(text, '\b[0-3][0-9][0-1][0-9][0-9]{6}\b') THEN 'Found chi in field text' END FROM conversations""")
def find_chi_text(t):
    texts = t.documents.select(F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), "text").unionByName(
        t.conversations.select(F.concat(F.lit("conv"), F.concat_ws(".", "conv_id", "turn")).alias("id"), "text"))
    return S.find_chi(texts.select(F.struct("id").alias("k"), "text")).select("k.id", "problem")


@query("verdict", f"""WITH {_FAIL}, n AS (SELECT resource, COUNT(*) AS n FROM fails GROUP BY 1)
SELECT doc_id AS resource, CASE WHEN quality = 0 THEN 'ErrorWontRetry' WHEN n > 0 THEN 'IsIdentifiable' ELSE 'NotIdentifiable' END AS status,
  CASE WHEN quality = 0 THEN 0 ELSE COALESCE(n, 0) END AS n_failures,
  CASE WHEN quality = 0 THEN 'Could not find file to process ''' || doc_id || '''' WHEN n > 0 THEN 'listed' ELSE '[]' END AS report
FROM documents LEFT JOIN n ON doc_id = resource LEFT JOIN labels USING (doc_id)""")
def verdict(t):
    """Documents as files; those labelled as poor are gone from disk."""
    poor = t.labels.where(F.col("quality") == 0).select(F.col("doc_id").alias("_d"), F.lit(True).alias("_poor"))
    files = t.documents.join(poor, F.col("doc_id") == F.col("_d"), "left").select(
        F.col("doc_id").alias("resource"), "text", "lang", "source", F.col("_poor").isNull().alias("present"))
    judged = S.verdict(S.screen_rows(files, RULES, ["text", "lang", "source"]))
    return judged.select("resource", "status", "n_failures",
                         F.when(F.col("n_failures") > 0, "listed").otherwise(F.col("report")).alias("report"))


@query("screen_words", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), d AS (SELECT DISTINCT word FROM w)
SELECT word FROM d WHERE regexp_full_match(word, '[a-zA-Z]+') AND NOT (length(word) > 1 AND lower(word)[1] = lower(word)[-1]) AND lower(word) NOT IN ('xyz', 'for', 'und')""")
def screen_words(t):
    """As ``screen_backrefs``, over every word of every whole text."""
    words = t.documents.select(F.explode(F.array_distinct(F.split("text", " "))).alias("value")).distinct()
    cells = words.select(F.lit("w").alias("resource"), F.lit("word").alias("column"), "value")
    return S.screen(cells, _ODD).select(F.col("value").alias("word"))


@query("screen_offsets", f"""WITH {_FAIL}, cut AS (SELECT resource, col, class, words, CASE class WHEN 'Organization' THEN regexp_split_to_array(value, '(?i)^SRC')
    WHEN 'Person' THEN regexp_split_to_array(value, '{EMAIL}') WHEN 'PrivateIdentifier' THEN regexp_split_to_array(value, '{CARD}') ELSE regexp_split_to_array(value, '{ADDRESS}') END AS gaps FROM parts)
SELECT resource, col AS "column", class, array_to_string(words, '|') AS words,
  array_to_string([CAST(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(w) for w in words[1:i-1]]), 0) AS BIGINT) for i in range(1, len(words) + 1)], ',') AS offsets FROM cut""")
def screen_offsets(t):
    """Every part of every failing cell with its place in the whole text."""
    return S.screen(_cells(t), RULES).select(
        "resource", "column", F.element_at("parts", 1)["Classification"].alias("class"), F.array_join(F.transform("parts", lambda p: p["Word"]), "|").alias("words"),
        F.array_join(F.transform("parts", lambda p: p["Offset"].cast("string")), ",").alias("offsets"))


_PHRASES = "license terms warranty copyright liability software granted hereby notice permission subject without".split()
_MANY = [S.ScreenRule("Ignore", pattern=f"^{a} {b}$") for a in _PHRASES for b in _PHRASES] + [
    *[S.ScreenRule("Report", pattern=rf"{w}[a-z]* [a-z]+", classification="Organization") for w in _PHRASES], *RULES]


@query("screen_many_rules", f"""WITH c AS (SELECT doc_id, text, CASE {" ".join(f"WHEN regexp_matches(text, '(?i){w}[a-z]* [a-z]+') THEN {i}" for i, w in enumerate(_PHRASES))}
  WHEN regexp_matches(text, '(?i){EMAIL}') THEN 100 WHEN regexp_matches(text, '{CARD}') THEN 101 WHEN regexp_matches(text, '{ADDRESS}') THEN 102 END AS n FROM documents)
SELECT doc_id AS resource, CASE WHEN n < 100 THEN 'Organization' WHEN n = 100 THEN 'Person' WHEN n = 101 THEN 'PrivateIdentifier' ELSE 'Location' END AS class,
  array_to_string(CASE {" ".join(f"WHEN n = {i} THEN regexp_extract_all(text, '(?i){w}[a-z]* [a-z]+')" for i, w in enumerate(_PHRASES))}
  WHEN n = 100 THEN regexp_extract_all(text, '(?i){EMAIL}') WHEN n = 101 THEN regexp_extract_all(text, '{CARD}') ELSE regexp_extract_all(text, '{ADDRESS}') END, '|') AS words
FROM c WHERE n IS NOT NULL""")
def screen_many_rules(t):
    """Whole texts under 162 rules, most of which are not tried because their words do not occur."""
    cells = S.to_cells(t.documents.select("doc_id", "text"), "doc_id")
    return S.screen(cells, _MANY).select("resource", F.element_at("parts", 1)["Classification"].alias("class"),
                                         F.array_join(F.transform("parts", lambda p: p["Word"]), "|").alias("words"))


@query("verdict_report", f"""WITH {_FAIL} SELECT resource, col AS problem_field, class, array_to_string(words, '|') AS words, value AS problem_value
FROM parts JOIN documents ON doc_id = resource LEFT JOIN labels USING (doc_id) WHERE COALESCE(quality, 1) <> 0""")
def verdict_report(t):
    """What the JSON reports of the screened documents list, read back."""
    poor = t.labels.where(F.col("quality") == 0).select("doc_id")
    files = t.documents.join(poor, "doc_id", "left_anti").select(
        F.col("doc_id").alias("resource"), "text", "lang", "source", F.lit(True).alias("present"))
    judged = S.verdict(S.RuleClassifier(("text", "lang", "source"), tuple(RULES)).classify(files))
    report = F.from_json("report", "array<struct<Parts:array<struct<Classification:string,Offset:int,Word:string>>,ProblemField:string,ProblemValue:string>>")
    rows = judged.select("resource", F.explode(report).alias("r"))
    return rows.select("resource", F.col("r.ProblemField").alias("problem_field"), F.element_at("r.Parts", 1)["Classification"].alias("class"),
                       F.array_join(F.transform("r.Parts", lambda p: p["Word"]), "|").alias("words"), F.col("r.ProblemValue").alias("problem_value"))


@query("reject_all_classifier", "SELECT doc_id AS resource, 'Person' AS class FROM documents")
def reject_all_classifier(t):
    return S.reject_all(t.documents.select(F.col("doc_id").alias("resource"))).select(
        "resource", F.try_element_at(F.try_element_at("failures", F.lit(1))["parts"], F.lit(1))["Classification"].alias("class"))


@query("pii_column_report", f"""WITH {_FAIL} SELECT c.col AS "column", cells, COALESCE(failing, 0) AS failing, round(COALESCE(failing, 0) / cells, 6) AS proportion
FROM (SELECT col, COUNT(*) AS cells FROM cells GROUP BY 1) c LEFT JOIN (SELECT col, COUNT(*) AS failing FROM fails GROUP BY 1) f ON c.col = f.col""")
def pii_column_report(t):
    return S.column_report(S.screen_cells(_cells(t), RULES))


@query("pii_value_report", f"""WITH {_FAIL} SELECT DISTINCT col AS "column", md5(value) AS digest FROM fails""")
def pii_value_report(t):
    return S.value_report(S.screen(_cells(t), RULES)).select("column", F.md5("value").alias("digest"))


@query("skip_columns", f"""SELECT page_id AS resource, CASE WHEN regexp_matches(html, '{EMAIL}') THEN 'html' END AS "column" FROM pages WHERE regexp_matches(html, '{EMAIL}')""")
def skip_columns(t):
    """Raw pages screened for addresses, leaving out the URL column."""
    cells = S.to_cells(t.pages, "page_id", skip=["URL"])
    rules = [S.ScreenRule("Report", pattern=EMAIL, classification="Person", case_sensitive=True)]
    return S.screen(cells, rules).select("resource", "column")


@query("ignore_postcodes", r"""SELECT c_custkey AS resource, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS with_postcodes, 0 AS without_postcodes FROM customer""")
def ignore_postcodes(t):
    """Failures per customer with and without the postcode detector."""
    text = F.when(F.col("c_mktsegment") == "BUILDING", "seen at EH1 2AB").otherwise(F.col("c_name"))
    cells = S.to_cells(t.customer.select(F.col("c_custkey").cast("string").alias("resource"), text.alias("note")), "resource")
    # Both screenings see the same rows; the difference is the postcodes.
    with_them = S.screen_rows(cells, S.default_rules(False), ["value"]).withColumnRenamed("failures", "first")
    return S.screen_rows(with_them, S.default_rules(True), ["value"]).select(
        F.col("resource").cast("long").alias("resource"), F.size("first").alias("with_postcodes"), F.size("failures").alias("without_postcodes"))
