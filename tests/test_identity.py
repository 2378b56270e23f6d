import json

import pytest
from pyspark.sql import functions as F

from radloom.functions import tags as TG
from radloom.functions.ordering import next_marked, with_position
from radloom.operators import deid as D, identity as I, updates as U
from radloom.operators.validate import UpdateSpec
from radloom.plans.propagation import propagate


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([("0101010101", "0A0A0A0A0A"), ("0202020202", None), ("0303030303", "  ")], "swap string, replacement string")


def tagset(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "j string").select(TG.parse_tags(F.col("j")).alias("tags"))


@pytest.mark.parametrize("entry,reason", [
    (None, "Dataset did not contain PatientID"), ({"vr": "LO"}, "PatientID was blank"), ({"vr": "LO", "val": ""}, "PatientID was blank"),
    ({"vr": "LO", "val": " "}, "PatientID was blank"), ({"vr": "LO", "val": "0101010101"}, None), ({"vr": "LO", "Value": ["0101010101"]}, None),
    ({"vr": "LO", "val": "0101010101\\"}, None), ({"vr": "LO", "Value": ["0101010101", None]}, None),
    ({"vr": "LO", "val": "0101010101\\0101010101"}, None), ({"vr": "LO", "val": "0101010101\\0202020202"}, "multiple values for PatientID"),
    ({"vr": "LO", "val": "0202020202"}, "No match found for '0202020202'"), ({"vr": "LO", "val": "9"}, "No match found for '9'")])
def test_patient_swap(spark, mapping, entry, reason):
    tags = {"00080060": {"vr": "CS", "val": "CT"}, **({"00100020": entry} if entry is not None else {})}
    row = I.swap_patient_id(tagset(spark, json.dumps(tags)), mapping).first()
    assert row["fail_reason"] == reason
    assert row["tags"]["00080060"]["val"] == "CT"
    if reason is None:
        assert row["tags"]["00100020"]["val"] == "0A0A0A0A0A"


def test_fallback(spark, mapping, rows):
    ids = spark.createDataFrame([("0101010101",), ("0202020202",), ("0303030303",), ("0404040404",)], "id string")
    new = I.allocate_surrogates(ids.union(ids), "id", spark.createDataFrame([], "swap string, guid string"), salt="s")
    assert new.count() == 4 and new.select("guid").distinct().count() == 4
    swapped = {r["id"]: r["replacement"] for r in I.swap_with_fallback(ids, "id", mapping, new).collect()}
    guid = {r["swap"]: r["guid"] for r in new.collect()}
    assert swapped == {"0101010101": "0A0A0A0A0A", **{k: guid[k] for k in ("0202020202", "0303030303", "0404040404")}}
    # Known identifiers keep their surrogate; only unknown ones get one.
    assert I.allocate_surrogates(ids, "id", new).isEmpty()
    assert I.allocate_surrogates(ids, "id", new.limit(0), max_length=9).isEmpty()
    assert ids.select(I.too_long(F.col("id"), 9)).first()[0] == "Supplied value was too long (10) - max allowed is (9)"


def test_a_mapping_must_be_unique(spark, mapping):
    assert I.require_unique(mapping) is mapping
    with pytest.raises(ValueError, match="0101010101"):
        I.require_unique(mapping.union(mapping))


def script(*elements, extra=""):
    listed = "".join(f'<e en="T" t="{t}" n="x">{a}</e>' for t, a in elements)
    return D.load_script(f'<script><p t="SITEID">99</p><p t="PROFILENAME">Basic</p><p t="UIDROOT">9999</p>{listed}{extra}</script>')


UNLISTED = '<r en="T" t="unspecifiedelements">x</r>'


def deid(spark, tags, s, **kw):
    text = json.dumps({t: {"vr": "LO", "val": v} for t, v in tags.items()})
    out = D.deidentify(tagset(spark, text), s, "salt", **kw).first()["tags"]
    return {t: e["val"] for t, e in out.items()}


def test_deid_actions(spark):
    now = F.lit("2024-02-03 04:05:06").cast("timestamp")
    s = script(("00080020", "@remove()"), ("00080060", "@require()"), ("00080070", "@empty()"), ("00080080", "@param(@SITEID)"),
               ("00080090", "@append(){P: @param(@PROFILENAME): @date():@time()}"), ("00081030", "@if(this,isblank){@remove()}{Removed}"),
               ("00081040", "@if(this,isblank){@remove()}{Removed}"), ("00120062", "@always()YES"), ("0008103e", "@keep()"), ("00100010", "Anon"),
               extra=UNLISTED + '<k en="T" t="0018">x</k>')
    got = deid(spark, {"00080020": "20240101", "00080070": "M", "00080080": "H", "00080090": "old", "00081030": " ", "00081040": "x",
                       "0008103E": "kept", "00100010": "Name", "00180050": "3", "00200010": "gone"}, s, now=now)
    assert got == {"00080060": "", "00080070": "", "00080080": "99", "00080090": "old\\P: Basic: 20240203:040506", "00081040": "Removed",
                   "00120062": "YES", "0008103E": "kept", "00100010": "Anon", "00180050": "3"}


def test_deid_groups(spark):
    tags = {"00091001": "p", "50001234": "c", "60003000": "o", "00200010": "k"}
    assert deid(spark, tags, script()) == tags
    assert deid(spark, tags, script(extra='<r en="T" t="privategroups"/><r en="F" t="curves"/>')).keys() == {"50001234", "60003000", "00200010"}
    assert deid(spark, tags, script(extra='<r en="T" t="curves"/><r en="T" t="overlays"/>')).keys() == {"00091001", "00200010"}
    assert deid(spark, tags, script(extra=UNLISTED)) == {}


def test_deid_hashes(spark):
    s = script(("00080018", "@hashuid(@UIDROOT,this)"), ("00080020", "@hashdate(this,PatientID)"), ("00080021", "@hashdate(this,PatientID)"),
               ("00100020", "@hash(this,10)"), ("00100010", "@hash(PatientID,10)"), ("00080050", "@hashptid(@SITEID,PatientID)"))
    got = deid(spark, {"00080018": "1.2.3", "00080020": "20240110", "00080021": "20240112", "00100020": "p1", "00100010": "n", "00080050": "a"}, s)
    assert got["00080018"].startswith("9999.") and len(got["00080018"]) <= 64
    assert got["00100010"] == got["00100020"] and len(got["00100020"]) == 10
    assert got["00080050"].startswith("99-")
    import datetime as dt
    day = lambda t: dt.datetime.strptime(t, "%Y%m%d")
    assert (day(got["00080021"]) - day(got["00080020"])).days == 2
    assert deid(spark, {"00080020": "no date", "00100020": "p1"}, s)["00080020"] is None


def test_deid_is_the_same_in_every_dialect(spark):
    s = script(("00100020", "@hash(this,10)"), ("0020000D", "@hashuid(@UIDROOT,this)"), ("00080020", "@hashdate(this,PatientID)"), ("00100010", "@hash(PatientID,10)"))
    texts = [{"00100020": {"vr": "LO", "val": "123"}, "0020000D": {"vr": "UI", "val": "1.2"}, "00080020": {"vr": "DA", "val": "20240110"}, "00100010": {"vr": "PN", "val": "n"}},
             {"00100020": {"vr": "LO", "Value": ["123"]}, "0020000D": {"vr": "UI", "Value": ["1.2"]}, "00080020": {"vr": "DA", "Value": ["20240110"]}, "00100010": {"vr": "PN", "Value": ["n"]}}]
    first, second = ({t: e["val"] for t, e in r["tags"].items()} for r in D.deidentify(tagset(spark, *map(json.dumps, texts)), s, "salt").collect())
    assert first == second and first["00080020"] is not None and first["00100010"] == first["00100020"]
    several = D.deidentify(tagset(spark, json.dumps({"00100020": {"vr": "LO", "Value": ["123", "4"]}})), s, "salt").first()["tags"]
    assert several["00100020"]["val"].split("\\")[0] == first["00100020"] and several["00100020"]["val"].count("\\") == 1


def test_deid_reaches_into_sequences(spark):
    s = script(("00100020", "@hash(this,10)"), ("00100010", "@remove()"), ("00089215", "@keep()"), extra='<k en="T" t="0040">x</k>' + UNLISTED)
    item = {"00100020": {"vr": "LO", "val": "123"}, "00100010": {"vr": "PN", "val": "Name"}, "00101000": {"vr": "LO", "val": "other"}}
    deep = item
    for _ in range(5):
        deep = {"00100020": {"vr": "LO", "val": "123"}, "00400555": {"vr": "SQ", "val": [deep]}}
    text = {"00100020": {"vr": "LO", "val": "123"}, "00089215": {"vr": "SQ", "Value": [item, deep]}, "00400555": {"val": [item]}, "00081140": {"vr": "SQ", "val": [item]}}
    out = {t: e["val"] for t, e in D.deidentify(tagset(spark, json.dumps(text)), s, "salt").first()["tags"].items()}
    assert out.keys() == {"00100020", "00089215", "00400555"}
    first, second = json.loads(out["00089215"])
    assert first == {"00100020": {"vr": "LO", "val": out["00100020"]}}
    assert all(word not in json.dumps(out) for word in ("Name", "other", '"123"')) and second["00100020"]["val"] == out["00100020"]


def test_deid_rejects_unknown_keywords(spark):
    with pytest.raises(ValueError, match="PatientId"):
        deid(spark, {"00100010": "n"}, script(("00100010", "@hash(PatientId,10)")))


def maps(spark, current, archive, guids=None):
    return (spark.createDataFrame(current, "swap string, replacement string, valid_from string").withColumn("valid_from", F.to_timestamp("valid_from")),
            spark.createDataFrame(archive, "swap string, replacement string, valid_from string").withColumn("valid_from", F.to_timestamp("valid_from")),
            None if guids is None else spark.createDataFrame(guids, "swap string, guid string"))


@pytest.mark.parametrize("archive,guids,expected", [
    ([], None, []),
    ([("0101010101", "0A0A0A0A0A", "2001-01-01")], None, [(1, "0A0A0A0A0A", "0Z0Z0Z0Z0Z")]),
    ([("0101010101", "old", "2001-01-01"), ("0101010101", "newer", "2002-01-01")], None, [(1, "newer", "0Z0Z0Z0Z0Z")]),
    ([("0101010101", "old", "2001-01-01"), ("0101010101", None, "2002-01-01")], None, [(1, None, "0Z0Z0Z0Z0Z")]),
    ([], [("0101010101", "guid-1")], [(2, "guid-1", "0Z0Z0Z0Z0Z")]),
    ([("0101010101", "0Z0Z0Z0Z0Z", "2001-01-01")], [("0101010101", "guid-1")], [(1, "0Z0Z0Z0Z0Z", "0Z0Z0Z0Z0Z"), (2, "guid-1", "0Z0Z0Z0Z0Z")])])
def test_detect_updates(spark, rows, archive, guids, expected):
    current, old, handed = maps(spark, [("0101010101", "0Z0Z0Z0Z0Z", "2020-01-01"), ("7", "x", "1999-01-01")], archive + [("7", "y", "1998-01-01")], guids)
    found = U.detect_updates(current, old, handed, F.lit("2010-01-01").cast("timestamp"))
    assert rows(found, "step", "have", "want") == expected


def test_archive_is_needed(spark):
    with pytest.raises(ValueError):
        U.detect_updates(spark.range(1), None, None, F.lit(0))


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("123", 1, "a"), ("456", 2, "b"), ("111", 3, "c"), ("111", 4, "d")], "PatientID string, Age int, Address string")


@pytest.mark.parametrize("fields,values,ops,hit", [
    (["PatientID"], ["111"], None, 2), (["PatientID", "Age"], ["111", 3], None, 1), (["PatientID", "Age"], ["111", 6], [None, "<="], 2),
    (["PatientID"], ["5345"], None, 0), (["PatientID"], [None], None, 0), (["PatientID"], ["1%"], ["like"], 3), (["Age"], [None], ["is not"], 4)])
def test_update(spark, table, fields, values, ops, hit):
    spec = UpdateSpec(fields, values, ["PatientID"], ["new"], ops)
    tables = {"t": table, "other": table.select("Address")}
    assert U.affected_rows(tables, spec).first()["affected"] == hit
    assert U.apply_updates(tables, spec)["t"].where("PatientID = 'new'").count() == hit


def test_update_errors(spark, table):
    tables = {"t": table}
    for spec in (UpdateSpec([], [], ["a"], ["b"]), UpdateSpec(["PatientID"], ["1", "2"], ["Age"], [1]), UpdateSpec(["PatientID"], ["1"], [], []),
                 UpdateSpec(["PatientID"], ["1"], ["Age"], [1], ["; drop"]), UpdateSpec(["PatientID"], ["1"], ["Age"], [1], ["=", "="]),
                 UpdateSpec(["Nope"], ["1"], ["Age"], [1]), UpdateSpec(["PatientID"], ["1"], ["Age"], [1], tables=["gone"])):
        with pytest.raises(ValueError):
            U.apply_updates(tables, spec.validate())
    assert U.tables_for({"t": table, "v": table}, UpdateSpec(["PatientID"], ["1"], ["Age"], [1]), views=("v",)) == ["t"]
    assert U.tables_for({"t": table, "u": table}, UpdateSpec(["PatientID"], ["1"], ["Age"], [1]), configured=("u",)) == ["u"]


def brute(pairs, value):
    for _, have, want in sorted(pairs):
        if value is not None and have is not None and value == have:
            value = want
    return value


def test_chain_against_brute_force(spark):
    import random

    rng = random.Random(5)
    values = [f"v{i}" for i in range(12)] + ["hot"] * 6
    pairs = [(seq, rng.choice(values + [None]), rng.choice(values + [None])) for seq in range(300)]
    df = spark.createDataFrame(pairs, "seq long, have string, want string")
    resolved = {r["have"]: r["final"] for r in U.resolve_chain(df, buckets=16).collect()}
    for value in set(values):
        assert resolved.get(value, value) == brute(pairs, value)
    rows = spark.createDataFrame([(v,) for v in values] + [("other",), (None,)], "id string")
    got = [r["id"] for r in U.apply_chain(rows, "id", U.resolve_chain(df)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [brute(pairs, v) for v in values] + ["other", None]))


def test_cascade_and_swap(spark):
    pairs = spark.createDataFrame([(1, "111", "222"), (2, "222", "333"), (3, "a", "b"), (4, "b", "a")], "seq long, have string, want string")
    assert {r["have"]: r["final"] for r in U.resolve_chain(pairs).collect()} == {"111": "333", "222": "333", "a": "a", "b": "a"}


def test_propagate(spark):
    current, archive, guids = maps(spark, [("1", "new", "2020-01-01")], [("1", "old", "2001-01-01")], [("1", "guid")])
    live = spark.createDataFrame([("old",), ("guid",), ("else",)], "PatientID string")
    out = propagate(current, archive, guids, F.lit("2010-01-01").cast("timestamp"), {"live": live, "none": spark.range(1)}, "PatientID")
    assert list(out) == ["live"]
    assert sorted(r[0] for r in out["live"].collect()) == ["else", "new", "new"]


def test_positions_and_look_ahead(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    placed = with_position(df, "v").orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(1000)) and [r["v"] for r in placed] == sorted(r["v"] for r in placed)
    marked = spark.range(200).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"), "id", (F.col("id") % 5 == 0).alias("m"))
    got = {r["id"]: r["next"] for r in next_marked(marked, "k", "id", F.col("m"), 7).collect()}
    for i in range(200):
        assert got[i] == next((j for j in range(i + 1, 200) if j % 5 == 0 and (j % 3 == 0) == (i % 3 == 0)), None)


def test_swappers(spark, mapping, tmp_path, rows):
    path = str(tmp_path / "guids")
    spark.createDataFrame([], "swap string, guid string").write.parquet(path)
    stored = lambda: spark.read.parquet(path)
    guids = I.SurrogateSwapper(stored, lambda new: new.write.mode("append").parquet(path), max_length=10, salt="s")
    ids = spark.createDataFrame([("0101010101",), ("0404040404",), ("too long a value",)], "id string")
    first = rows(guids.swap(ids, "id"), "id", "replacement", "fail_reason")
    assert first == rows(guids.swap(ids, "id"), "id", "replacement", "fail_reason")
    assert stored().count() == 2 and first[2] == ("too long a value", None, "Supplied value was too long (16) - max allowed is (10)")
    both = I.FallbackSwapper(mapping, guids)
    new = spark.createDataFrame([("0101010101",), ("0505050505",)], "id string")
    assert rows(both.swap(new, "id"), "id", "replacement")[0] == ("0101010101", "0A0A0A0A0A")
    assert stored().where("swap = '0505050505'").count() == 1 and stored().count() == 3
    assert rows(I.LookupSwapper(mapping).swap(new, "id"), "replacement") == [("0A0A0A0A0A",), (None,)]


def test_deid_tests_keys_and_digests_once(spark):
    """Each row's keys are tested for lower case once, not for every element a script adds; a UID's digest is computed once for both of its halves."""
    s = script(("00080060", "@require()"), ("00080070", "@require()"), ("00120062", "@always()YES"), ("0020000D", "@hashuid(@UIDROOT,this)"), extra=UNLISTED)
    df = tagset(spark, '{"0020000d":{"vr":"UI","val":"1.2"},"00080060":{"vr":"CS","val":"CT"}}', '{"0020000D":{"vr":"UI","val":"1.2"}}')
    out = D.deidentify(df, s, "salt")
    rows = [{t: e["val"] for t, e in r["tags"].items()} for r in out.collect()]
    assert [set(r) for r in rows] == [{"0020000D", "00080060", "00080070", "00120062"}] * 2 and rows[0]["0020000D"] == rows[1]["0020000D"]
    assert [r["00080060"] for r in rows] == ["CT", ""]
    plain = df.select(F.create_map(F.lit("0020000D"), F.struct(F.lit("UI").alias("vr"), F.lit("1.2").alias("val"))).alias("tags"))
    plan = D.deidentify(plain.localCheckpoint(), s, "salt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _upper_tags") == 1 and plan.count("array_contains(map_keys(_upper_tags") == 3
    uid = spark.range(1).select(D.hash_uid(F.col("id").cast("string"), "9999", "salt").alias("u"))
    assert uid._jdf.queryExecution().analyzed().toString().count("sha2(") == 1


def test_tag_texts_are_searched_for_lower_case_only_when_a_key_has_some(spark):
    df = spark.createDataFrame([('{"0008103e":{"vr":"LO","val":"a"}}',)], "j string").select(TG.parse_tags(F.col("j")).alias("tags"))
    assert list(df.first()["tags"]) == ["0008103E"]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.index("array_join(map_keys(") < plan.index("[0-9A-F]{0,7}[a-f]") and plan.count("[0-9A-F]{0,7}[a-f]") == 1
