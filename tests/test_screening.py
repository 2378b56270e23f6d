import json

import pytest
from radloom.operators import screening as S


@pytest.mark.parametrize("text,hit", [
    ("0101010101", True), ("0101010101 fish", True), ("test)0101010101.", True), ("1110101010.1", True),
    ("test)4401010101.", False), ("test)1120010101.", False), ("11101010101", False)])
def test_chi(spark, text, hit):
    df = spark.createDataFrame([(1, "ok", text)], "n long, a string, b string")
    assert S.find_chi(df).first()["problem"] == ("Found chi in field b" if hit else None)


def cells(spark, *triples):
    return spark.createDataFrame([(str(i), c, v) for i, (c, v) in enumerate(triples)], "resource string, column string, value string")


def failing(df):
    return {r["resource"]: [(p["Classification"], p["Offset"], p["Word"]) for p in r["parts"]] for r in df.collect()}


def test_first_rule_decides(spark):
    rules = S.load_rules("""
BasicRules:
- {Action: Ignore, IfColumn: Modality}
- {Action: Ignore, IfColumn: ProtocolName, IfPattern: '^AXIALT2$'}
- {Action: Ignore, IfColumn: ProtocolName, IfPattern: '^safe'}
- {Action: Report, IfColumn: ProtocolName, CaseSensitive: true, IfPattern: '^[A-Z]{4,}MR[0-9]{1,2}$', As: Person}
- {Action: Report, IfPattern: 'smith', As: Person}
- {Action: Ignore, IfPattern: 'smith'}
""")
    got = failing(S.screen(cells(spark, ("Modality", "SMITH"), ("ProtocolName", "axialt2"), ("ProtocolName", "SMITHJOHNMR1"), ("ProtocolName", "smithjohnmr1"),
                                 ("Other", "Mr Smith and smith"), ("Other", "nothing"), ("ProtocolName", "SAFE smith")), rules))
    assert got == {"2": [("Person", 0, "SMITHJOHNMR1")], "3": [("Person", 0, "smith")], "4": [("Person", 3, "Smith"), ("Person", 13, "smith")]}


def test_values_of_a_cell_are_screened_one_by_one(spark):
    rules = [S.ScreenRule("Ignore", pattern="^ok"), S.ScreenRule("Report", pattern="[0-9]+", classification="Person")]
    got = failing(S.screen(cells(spark, ("a", "ok 1\\bad 22\\x\\3"), ("a", "ok 1\\x"), ("a", "7 ok"), ("a", "ok 7")), rules))
    assert got == {"0": [("Person", 9, "22"), ("Person", 14, "3")], "2": [("Person", 0, "7")]}


def test_rule_without_pattern_takes_the_whole_value(spark):
    got = failing(S.screen(cells(spark, ("PatientName", "any\u0001thing"), ("b", "x")), [S.ScreenRule("Report", column="PatientName", classification="Person")]))
    assert got == {"0": [("Person", 0, "any thing")]}


def test_defaults_and_postcodes(spark):
    data = cells(spark, ("a", "id 0101010101"), ("a", "at DD1 4HN"))
    assert failing(S.screen(data, S.default_rules())) == {"0": [("PrivateIdentifier", 3, "0101010101")], "1": [("Postcode", 3, "DD1 4HN")]}
    assert failing(S.screen(data, S.default_rules(ignore_postcodes=True))).keys() == {"0"}


def test_allow_rules(spark):
    part = "array<struct<Classification:string,Offset:int,Word:string>>"
    df = spark.createDataFrame([("1", "a", "Topogram of Smith", [("Person", 0, "Topogram"), ("Person", 12, "Smith")]), ("2", "a", "Topogram", [("Person", 0, "topogram")]),
                                ("3", "a", "Circle of Willis", [("Person", 10, "Willis")]), ("4", "a", "Willis", [("Person", 0, "Willis")]), ("5", "b", "z", [])],
                               f"resource string, column string, value string, parts {part}")
    rules = S.load_allow_rules("""
WhiteListRules:
- {Action: Ignore, IfPartPattern: '^Topogram$', As: Person}
- {Action: Ignore, IfPattern: Circle of Willis, IfPartPattern: '^Willis$'}
""")
    assert failing(S.filter_failures(df, rules)) == {"1": [("Person", 12, "Smith")], "4": [("Person", 0, "Willis")], "5": []}
    assert failing(S.drop_listed(df, spark.createDataFrame([("Willis",), ("Topogram",)], "v string"))).keys() == {"1", "3", "5"}


def test_verdict(spark):
    files = spark.createDataFrame([("a", True, "0101010101", "x\\0101010101"), ("b", True, "fine", None), ("c", False, "0101010101", "")],
                                  "resource string, present boolean, t string, u string")
    got = {r["resource"]: r for r in S.verdict(S.screen_rows(files, S.default_rules(), ["t", "u"])).collect()}
    assert {k: (r["status"], r["n_failures"]) for k, r in got.items()} == {
        "a": ("IsIdentifiable", 2), "b": ("NotIdentifiable", 0), "c": ("ErrorWontRetry", 0)}
    assert got["b"]["report"] == "[]" and "Could not find file" in got["c"]["report"]
    listed = json.loads(got["a"]["report"])
    assert [(f["ProblemField"], f["Parts"][0]["Offset"], f["Parts"][0]["Classification"]) for f in listed] == [
        ("t", 0, "PrivateIdentifier"), ("u", 2, "PrivateIdentifier")]
    assert S.verdict(S.screen_rows(files, S.default_rules(), ["t", "u"], skip=["T"])).where("n_failures = 1").count() == 1
    assert S.verdict(S.reject_all(files)).where("status = 'IsIdentifiable'").count() == 2


def test_reports_and_skipped_columns(spark, rows):
    df = spark.createDataFrame([("1", "0101010101", "x"), ("2", "0101010101", None), ("3", "fine", "0202020202")], "id string, a string, b string")
    data = S.to_cells(df, "id")
    fails = S.screen(data, S.default_rules())
    assert rows(S.column_report(S.screen_cells(data, S.default_rules()))) == [("a", 3, 2, 0.666667), ("b", 2, 1, 0.5)]
    assert rows(S.value_report(fails)) == [("a", "0101010101"), ("b", "0202020202")]
    assert rows(S.to_cells(df, "id", skip=["A"]).select("column").distinct()) == [("b",)]


def test_classifiers(spark):
    files = spark.createDataFrame([("a", True, "Topogram 0101010101", "Smith")], "resource string, present boolean, t string, u string")
    rules = (*S.default_rules(), S.ScreenRule("Report", pattern="topogram|smith", classification="Person"))
    kept = S.RuleClassifier(("t", "u"), rules, (S.AllowRule("^Smith$", classification="Person"),)).classify(files).first()["failures"]
    assert [(f["column"], [p["Word"] for p in f["parts"]]) for f in kept] == [("t", ["0101010101"])]
    assert S.verdict(S.RejectAllClassifier().classify(files)).first()["status"] == "IsIdentifiable"


def test_ignore_rules_with_groups_of_their_own(spark):
    rules = S.load_rules("""
BasicRules:
- {Action: Ignore, IfPattern: '^a(x)'}
- {Action: Ignore, IfPattern: '^(b)\\1$'}
- {Action: Ignore, IfPattern: '^(?:c)$'}
- {Action: Report, IfPattern: '.+', As: Person}
""")
    assert set(failing(S.screen(cells(spark, ("A", "bb"), ("A", "bx"), ("A", "c"), ("A", "ax")), rules))) == {"1"}


def test_a_word_leaves_its_text_once(spark, tmp_path):
    import workload

    spark.createDataFrame([(1, "one two one two one"), (2, None), (3, "two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = workload.QUERIES["screen_words"](spark, str(tmp_path))
    assert "array_distinct" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.word for r in found.collect()) == ["one", "two"]
