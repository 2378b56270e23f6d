"""Vector search, archives and the pipeline against brute force."""

import hashlib
import math

import numpy as np
import pytest

from radloom.llm import ann, bitslice, queries, warc
from radloom.llm.common import shared_folder

rng = np.random.default_rng(11)
VECTORS = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(120)]
VECTORS += [(i + 200, VECTORS[i % 5][1], 1) for i in range(30)]             # ties
VECTORS += [(300, None, 1), (400, [0.0] * 8, 1), (500, [1.0, None] * 4, 1), (600, [math.nan] * 8, 1), (700, [math.inf] * 8, 1),
            (800, [2.0, -1.0], 1), (None, [1.0] * 8, 1), (900, [], 1)]
SCHEMA = "vec_id long, embedding array<float>, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, SCHEMA)


def valid(zero):
    rows = [(i, np.pad(np.array(v, dtype=np.float32).astype(float), (0, 8 - len(v)))) for i, v, _ in VECTORS
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [r for r in rows if zero or r[1].any()]


def test_ann_recall_and_scores(vectors, spark):
    got = queries.multi_index_ann(vectors).collect()
    rows = valid(False)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i, _ in rows if i % 20 == 0}
    hits = 0
    vec = dict(rows)
    for q, found in by_query.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(r.score == pytest.approx(float(vec[q] @ vec[r.vec_id]), abs=1e-12) for r in found)
        best = sorted((-float(vec[q] @ v), i) for i, v in rows if i != q)[:20]
        hits += len({i for _, i in best} & {r.vec_id for r in found})
    assert hits / (20 * len(by_query)) >= 0.9
    few = vectors.where("vec_id < 4 or vec_id = 20")
    assert queries.multi_index_ann(few).count() == 2 * 4
    assert queries.multi_index_ann(spark.createDataFrame([], SCHEMA)).count() == 0
    assert queries.multi_index_ann(vectors.where("vec_id = 20")).count() == 0


def test_ann_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits = asked = 0
    found = {}
    for r in queries.QUERIES["op5_multi_index_ann"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, got in found.items():
        scores = x @ x[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(got & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        asked += 20
    assert hits / asked >= 0.9


def test_index_finds_all_codes_within_the_radius():
    codes = rng.integers(0, 256, (500, 4), dtype=np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 3, 7, 12, 32):
        for code in codes[:5] ^ np.uint8(3):
            expected = np.flatnonzero(np.bitwise_count(codes ^ code).sum(axis=1) <= radius)
            assert index.within(code, radius).tolist() == expected.tolist()


def test_bit_slices_are_exact(vectors, spark):
    got = {}
    for r in queries.bit_sliced_top_k(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(i, np.floor(256 * v).astype(int)) for i, v in valid(True)]
    for q, w in rows:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, v in rows if i != q)[:5]
            assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got
    assert queries.bit_sliced_top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bit_slice_selection_and_sums():
    values = rng.integers(-300, 300, (130, 7))
    values[50:70] = values[0]
    slices = bitslice.BitSlices(values)
    for weights in (rng.integers(-200, 200, 7), np.zeros(7, dtype=int), np.array([0, 0, -5, 0, 0, 0, 0])):
        scores = values @ weights
        for k in (1, 5, 30, 200):
            got = slices.top(slices.score(weights), slices.everyone, k)
            expected = sorted(range(130), key=lambda i: (-scores[i], i))[:k]
            assert sorted(got.tolist()) == sorted(expected)


PAGES = [(i, f"http://x/{i}", body, "extra") for i, body in enumerate([
    "a" * 1200, "a" * 1200, "b" * 999, "b" * 999, None, "", "é" * 700, "é" * 700, "é" * 700,
    "head\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nWARC/1.0\r\n" * 40, "x\r\n\r\n", "c" * 300_000])]
PAGES += [PAGES[8], (None, None, "a" * 1200, "extra"), (None, None, None, "extra")]


def test_captures(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in queries.warc_captures(pages).collect()), key=str)
    expected = []
    for key, _, html, _ in PAGES:
        body = (html or "").encode()
        same = max((k for k, _, h, _ in PAGES if k is not None and (h or "").encode() == body), default=None)
        revisit = len(body) >= 1000 and same != key
        expected.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", same if revisit else None))
    assert got == sorted(expected, key=str)
    assert queries.warc_captures(pages.limit(0)).count() == 0


def test_archives_hold_whole_transactions(spark):
    pages = spark.createDataFrame(PAGES[:12], "page_id long, url string, html string, digest string")
    folder = shared_folder(spark, "warc-test")
    warc.write_archives(warc.deduplicated(pages), folder, archive_bytes=60_000)
    rows = {r.page: r for r in warc.assemble(spark, folder).withColumn("page", warc.page_id()).collect()}
    assert sorted(rows) == list(range(12))
    for key, url, html, _ in PAGES[:12]:
        row = rows[key]
        assert row.uri == url and bytes(row.request.block).startswith(b"GET " + url.encode())
        if row.response.type == "response":
            assert bytes(row.response.payload).decode() == (html or "")
        else:
            assert row.response.payload is None and row.response.refers_to


def test_a_cut_archive_ends_at_its_last_whole_record():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    assert len(list(warc.parse(record * 3))) == 3 and len(list(warc.parse((record * 3)[:-10]))) == 2
    assert list(warc.parse(b"")) == []


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "mixing", "bpe"]
    docs = spark.createDataFrame([
        (1, "The cat sat on the mat and then it went home again to sleep", "en", "a", 0, "z"),
        (2, "The cat sat on the mat and then it went home again to sleep", "en", "b", 0, "z"),
        (3, "1234 !!", "en", "a", 0, "z"), (4, None, None, None, None, None), (5, "Quite another text about a dog in the garden", "en", "b", 0, "z"),
    ], "doc_id long, text string, lang string, source string, n_chars long, row string")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
        rows = docs.collect()
        kept.append(sorted({r.doc_id for r in rows}))
        if name != "bpe":
            assert docs.columns == columns
        docs = spark.createDataFrame(rows, docs.schema)
    assert kept[:3] == [[1, 2, 5], [1, 2, 5], [1, 5]] and set(kept[4]) == set(kept[3]) <= {1, 5}
    assert all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in docs.collect())


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_given_tables_match_sql(spark, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    from check import compare, connect

    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert compare(got, connect(folder).execute(queries.ORACLE[name]).df()) is None
