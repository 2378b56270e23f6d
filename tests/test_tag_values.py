"""Values of tag sets: text is text, lists are lists, names are names, however a set spells them."""

import json

import pytest
from pyspark.sql import functions as F

from radloom.functions import tags as TG
from radloom.operators import deid as D, identity as I, project as P
from radloom.template import load_template

CASES = [
    ({"vr": "LO", "val": "[x"}, ("LO", "[x")), ({"vr": "LO", "Value": ["[x"]}, ("LO", "[x")), ({"vr": "LO", "val": "[{see note} ok]"}, ("LO", "[{see note} ok]")),
    ({"vr": "LO", "val": '["a"]'}, ("LO", '["a"]')), ({"vr": "LO", "val": '["a"] tail'}, ("LO", '["a"] tail')), ({"vr": "LO", "val": "[1]"}, ("LO", "[1]")),
    ({"vr": "LO", "val": ["a", "[b"]}, ("LO", "a\\[b")), ({"vr": "DS", "Value": [1, 2.5]}, ("DS", "1\\2.5")), ({"vr": "DS", "val": 3}, ("DS", "3")),
    ({"vr": "PN", "Value": [{"Alphabetic": "Doe^J"}]}, ("PN", "Doe^J")), ({"vr": "PN", "val": {"Alphabetic": "A b", "Phonetic": "c"}}, ("PN", "A b==c")),
    ({"vr": "PN", "Value": [{"Alphabetic": "a"}, {"Ideographic": "i"}]}, ("PN", "a\\=i")), ({"vr": "PN", "val": "{x"}, ("PN", "{x")),
    ({"vr": "PN", "Value": ["n", "[m"]}, ("PN", "n\\[m")), ({"vr": "LO", "val": 'say "[x]"'}, ("LO", 'say "[x]"')), ({"vr": "LO", "val": ""}, ("LO", "")),
    ({"vr": "LO"}, ("LO", None)), ({"vr": "LO", "Value": []}, ("LO", "")), ({"val": "[1] see"}, (None, "[1] see")),
    ({"Value": [{"Alphabetic": "u"}]}, (None, '[{"Alphabetic":"u"}]')), ({"vr": "LO", "val": [{"a": 1}]}, (None, '[{"a":1}]')),
]


@pytest.mark.parametrize("spelling", ["plain", "spaced", "escaped"])
def test_values(spark, spelling):
    texts = []
    for element, _ in CASES:
        text = json.dumps({"00081030": element}, separators=(",", ":") if spelling == "plain" else None)
        texts.append(text.replace('"[', '"\\u005b') if spelling == "escaped" else text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    read = df.select("i", TG.parse_tags(F.col("j"))["00081030"].alias("all"), TG.parse_some(F.col("j"), ["00081030", "0010001A"])["00081030"].alias("some")).collect()
    for r in read:
        assert (r["all"].vr, r["all"].val) == (r["some"].vr, r["some"].val) == CASES[r.i][1], texts[r.i]


def test_lower_case_tags(spark):
    sets = [{"000b1001": {"vr": "LO", "val": "low"}, "000B1001": {"vr": "LO", "val": "up"}, "0010001a": {"val": "x"}}, {"000b1001": {"vr": "LO", "Value": ["[low"]}}, {}]
    df = spark.createDataFrame([(json.dumps(s),) for s in sets], "j string")
    read = [{k: e.val for k, e in r.tags.items()} for r in df.select(TG.parse_tags(F.col("j")).alias("tags")).collect()]
    assert read == [{"000B1001": "up", "0010001A": "x"}, {"000B1001": "[low"}, {}]
    some = [r.s and r.s.val for r in df.select(TG.parse_some(F.col("j"), ["000B1001"])["000B1001"].alias("s")).collect()]
    assert some == ["up", "[low", None]


def test_no_object_is_null(spark):
    df = spark.createDataFrame([("nonsense",), (None,)], "j string")
    assert [r[0] for r in df.select(TG.parse_tags(F.col("j"))).collect()] == [None, None]


KEEP = "<script>" + "".join(f'<e en="T" t="{t}">@keep()</e>' for t in ("00100010", "00081030", "00081040", "00089215")) + '<r en="T" t="privategroups"/></script>'


def test_deid_keeps_names_and_texts_and_loses_private_groups(spark):
    elements = {"00100010": {"vr": "PN", "Value": [{"Alphabetic": "Doe^J"}]}, "00081030": {"vr": "LO", "val": "[{see note} ok]"}, "00081040": {"Value": [{"Alphabetic": "hidden"}]},
                "000b1001": {"vr": "LO", "val": "secret"}, "000B1001": {"vr": "LO", "val": "secret"}}
    df = spark.createDataFrame([(json.dumps({**elements, "00089215": {"vr": "SQ", "Value": [elements]}}),)], "j string").select(TG.parse_tags(F.col("j")).alias("tags"))
    out = {t: e.val for t, e in D.deidentify(df, D.load_script(KEEP), "salt").first()["tags"].items()}
    assert json.loads(out.pop("00089215")) == [{"00100010": {"vr": "PN", "val": "Doe^J"}, "00081030": {"vr": "LO", "val": "[{see note} ok]"}}]
    assert out == {"00100010": "Doe^J", "00081030": "[{see note} ok]"}
    # A map that was not read by parse_tags is as safe.
    raw = df.select(F.from_json(F.lit('{"000b1001":{"vr":"LO","val":"s"},"00100010":{"vr":"PN","val":"n"}}'), "map<string,struct<vr:string,val:string>>").alias("tags"))
    assert D.deidentify(raw, D.load_script(KEEP), "salt").first()["tags"].keys() == {"00100010"}


def test_patient_ids_and_columns_with_brackets(spark):
    df = spark.createDataFrame([('{"00100020":{"vr":"LO","val":"[7"},"00081030":{"vr":"LO","val":"[x] y"}}',), ('{"00100020":{"vr":"LO","Value":["[7","[7"]}}',)], "DicomDataset string")
    read = df.withColumn("tags", TG.parse_tags(F.col("DicomDataset")))
    assert [(r.pid, r.pid_problem) for r in I.with_patient_id(read).collect()] == [("[7", None)] * 2
    template = load_template("Tables: [{TableName: t, Columns: [{ColumnName: PatientID}, {ColumnName: StudyDescription}]}]")
    flat = P.flatten(df.withColumn("DicomFilePath", F.lit("f")), list(template.values()))
    assert [(r.PatientID, r.StudyDescription) for r in flat.collect()] == [("[7", "[x] y"), ("[7\\[7", None)]
