import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from radloom.sources import directories as D, files as FS, sinks
from radloom.sources.documents import QueryError, find


def listing(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_default_mode_stops_at_the_first_match(spark, rows):
    files = listing(spark, "r/a/1.dcm", "r/a/b/2.dcm", "r/c/d/3.dcm", "r/c/x.txt", "r/e/y.txt", "r/ab/4.dcm")
    assert rows(D.find_dirs(files)) == [("r/a",), ("r/ab",), ("r/c/d",)]
    assert rows(D.find_dirs(files, "*.txt")) == [("r/c",), ("r/e",)]
    assert rows(D.find_dirs(listing(spark, "top.dcm", "a/1.dcm", "a/b/2.dcm"))) == [("",)]
    assert rows(D.find_dirs(listing(spark, "/r/1.dcm", "/r/a/2.dcm", "/s/3.dcm"))) == [("/r",), ("/s",)]


def test_pacs_mode(spark, rows):
    dirs = spark.createDataFrame([(d,) for d in ("r/2018/01/01", "r/2018/01/01/A1", "r/2018/01/01/A1/sub", "r/2018/01/02/E2", "r/other/x", "r/1999/01/01/Z")], "dir string")
    assert rows(D.find_dirs_pacs(dirs, "r")) == [("r/2018/01/01/A1",), ("r/2018/01/02/E2",)]
    assert rows(D.find_dirs_pacs(dirs, "r/2018/01/01/A1/")) == [("r/2018/01/01/A1",)]
    assert rows(D.find_dirs_pacs(dirs, "r/2018/01/01/A1")) == [("r/2018/01/01/A1/sub",)]


def test_list_mode(spark, rows):
    files = listing(spark, "r/2018/01/01/A1/x.dcm", "r/2018/01/01/A2/x.txt")
    lines = spark.createDataFrame([("r/2018/01/01/A1/,,",), ("r/2018/01/01/A1",), ("r/2018/01/01/A2/",), ("r/2018/01/01/A3/",), ("junk",), ("r/2018/01/01/A1/",)], "value string")
    assert rows(D.list_dirs(lines, files)) == [("r/2018/01/01/A1",), ("r/2018/01/01/A1",)]
    assert D.rejected_lines(lines, files).count() == 4


def test_zip_mode(spark, rows):
    assert rows(D.find_dirs_zips(listing(spark, "a/1.zip", "a/b/2.dcm", "a/c/3.txt", "d/4.tar", "e/5.ZIP"))) == [("a",), ("a/b",), ("d",)]


def archives(folder):
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("x/1.dcm", b"11")
        z.writestr("2.DCM", b"222")
        z.writestr("readme.txt", b"hello")
        z.writestr("empty.dcm", b"")
    with tarfile.open(folder / "b.tar", "w") as t:
        info = tarfile.TarInfo("in/3.dcm")
        info.size = 4
        t.addfile(info, io.BytesIO(b"3333"))
    (folder / "c.dcm").write_bytes(b"\0" * 128 + b"DICM" + b"rest")
    (folder / "d.dcm").write_bytes(b"no image")


def test_kinds_and_entries(spark, tmp_path, rows):
    archives(tmp_path)
    kinds = FS.classify_files(FS.read_files(spark, str(tmp_path)))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    assert rows(kinds.select(name, "kind")) == [("a.zip", "archive"), ("b.tar", "archive"), ("c.dcm", "dicom"), ("d.dcm", "archive")]
    packed = kinds.where("kind = 'archive'")
    tail = F.regexp_extract("path", "([^/]+![^!]+)$", 1)
    loader = FS.explode_archive(packed)
    assert rows(loader.where("error IS NULL").select(tail, "size", F.length("content"))) == [
        ("a.zip!2.DCM", 3, 3), ("a.zip!readme.txt", 5, 5), ("a.zip!x/1.dcm", 2, 2), ("b.tar!in/3.dcm", 4, 4)]
    assert [r["archive"].endswith("d.dcm") for r in loader.where("error IS NOT NULL").collect()] == [True]
    reader = FS.explode_archive(packed, for_tag_reader=True, with_content=False).where("error IS NULL")
    assert rows(reader.select(tail, "size", "content")) == [("a.zip!2.DCM", -1, None), ("a.zip!empty.dcm", -1, None), ("a.zip!x/1.dcm", -1, None), ("b.tar!in/3.dcm", -1, None)]
    assert rows(D.list_files(spark, str(tmp_path), "*.dcm").select(name, "size")) == [("c.dcm", 136), ("d.dcm", 8)]
    one = str(tmp_path / "c.dcm")
    assert FS.find_files(D.list_files(spark, str(tmp_path)), one).count() == 1


def test_query_documents(spark, rows):
    df = spark.createDataFrame([(1, "2007-01", "CT"), (2, "2008-01", "MR"), (3, "2007-02", None), (4, "2007-02", "CT")], "_id int, SeriesDate string, Modality string")
    assert rows(find(df, '{"find": {"SeriesDate": {"$regex": "^2007"}}}'), "_id") == [(1,), (3,), (4,)]
    assert [r["_id"] for r in find(df, '{"find": {"SeriesDate": "2007-02"}, "sort": {"_id": -1}, "skip": 1, "limit": 456}').collect()] == [3]
    assert find(df, " ").count() == 4 and find(df, '{"find": {}, "limit": 0}').count() == 4
    assert rows(find(df, '{"find": {"Modality": {"$ne": "CT"}}}'), "_id") == [(2,), (3,)]
    assert rows(find(df, '{"find": {"Modality": null}}'), "_id") == [(3,)]
    for bad in ("no json", "{}", '{"find": 1}', '{"find": {}, "skip": -1}', '{"find": {}, "limit": "x"}', '{"find": {"a": {"$near": 1}}}', '{"find": {}, "sort": []}'):
        with pytest.raises(QueryError):
            find(df, bad)


def test_document_store(spark, tmp_path, rows, monkeypatch):
    df = spark.createDataFrame([("1", "CT"), ("2", "XX"), ("3", None), ("4", "MR"), ("5" * 100, "MR")], "SOPInstanceUID string, Modality string")
    monkeypatch.setattr(sinks, "guard_size", lambda d: __import__("radloom.operators.validate", fromlist=["x"]).guard_size(d, 80))
    held = sinks.write_images(df, str(tmp_path / "store"))
    assert rows(held, "Modality") == [("MR",)]
    assert rows(spark.read.parquet(str(tmp_path / "store")), "SOPInstanceUID", "modality_group") == [("1", "CT"), ("2", "OTHER"), ("3", "OTHER"), ("4", "MR")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.read_version(spark, path) is None
    sinks.write_version(spark.range(3), path)
    sinks.write_version(sinks.read_version(spark, path).union(spark.range(1)), path)
    (tmp_path / "t" / "v00000009-unfinished").mkdir()
    assert sinks.read_version(spark, path).count() == 4
    # A number that another writer holds is passed over.
    fs, claim = sinks._hadoop_path(spark, f"{path}/claims/00000003")
    assert fs.createNewFile(claim) and "/v00000004-" in sinks.write_version(spark.range(5), path)


def test_merge_touches_only_buckets_with_staged_keys(spark, tmp_path, rows):
    from radloom.operators.load import merge_live

    path = str(tmp_path / "live")
    live = spark.createDataFrame([(str(i), "old") for i in range(40)], "k string, v string").selectExpr(
        "*", "timestamp'2020-01-01' valid_from", "1 load_run_id")
    first = sinks.write_buckets(live, path, "k", 16)
    stage = spark.createDataFrame([("3", "new"), ("x", "new"), (None, "new")], "k string, v string")
    merge = lambda old, new: merge_live(old, new, "k", 2, F.lit("2024-01-01").cast("timestamp")).live
    touched = sinks.merge_buckets(stage, path, live.schema, "k", 16, merge)
    assert 1 <= len(touched) <= 2
    second = [p for p in (tmp_path / "live").glob("v*") if str(p) != first][0]
    assert {int(p.name.partition("=")[2]) for p in second.glob("live_bucket=*")} == touched
    expected = [(str(i), "new" if i == 3 else "old") for i in range(40)] + [("x", "new")]
    assert rows(sinks.read_buckets(spark, path, live.schema), "k", "v") == sorted(expected, key=str)


def test_routes(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", True), ("b", False)], "f string, identifiable boolean")
    sinks.write_routed(sinks.route(df, F.col("identifiable")), str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out")), "f", "route") == [("a", "ident"), ("b", "anon")]


def test_tagsets_series_and_tables(spark, tmp_path, rows):
    from radloom.sources.tables import read_table, read_tagsets

    text = '{"00100020":{"vr":"LO","val":"p"}}'
    spark.createDataFrame([("a", 5, "1", text)], "DicomFilePath string, DicomFileSize long, StudyInstanceUID string, DicomDataset string").write.json(str(tmp_path / "in"))
    row = read_tagsets(spark, str(tmp_path / "in")).first()
    assert (row["DicomDataset"], row["DicomFileSize"], row["SeriesInstanceUID"]) == (text, 5, None)
    for _ in range(2):
        sinks.write_series(spark.createDataFrame([("d", "1.1", 3)], "DirectoryPath string, SeriesInstanceUID string, ImagesInSeries long"), str(tmp_path / "series"))
    assert read_table(spark, str(tmp_path / "series")).count() == 2
    spark.range(2).createOrReplaceTempView("two")
    assert read_table(spark, "two").count() == 2


def test_pacs_folders_by_one_search(spark):
    listed = {"2010/01/02/a": "2010/01/02/a", "x/2010/01/02/a/b/c": "x/2010/01/02/a", "2010/01/02": None, "2010/01/02/": None, "x/y": None, "": None,
              "2010/01/02//b": "2010/01/02/", "2010\\01\\02\\q/z/w": "2010\\01\\02\\q/z", "2010/01/02x/a": None, "1999/2010/01/02/2011/03/04/k": "1999/2010/01/02/2011",
              "2010/01/02\n/a/b": "2010/01/02\n/a", "n\n/2010/01/02/a": "n\n/2010/01/02/a", "/2010/01/02/a/": "2010/01/02/a", "w2010/01/02/a": "w2010/01/02/a"}
    found = D.find_dirs_pacs(spark.createDataFrame([(d,) for d in listed], "dir string"), "")
    assert {r.dir for r in found.collect()} == {v for v in listed.values() if v is not None}
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
