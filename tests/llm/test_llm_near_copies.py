"""Near copies of the pipeline against brute force over all pairs."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from radloom.llm import near_copies, simhash


def plain_groups(rows, least=0.8):
    """Smallest id of every group that pairs of similarity ``least`` connect."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[p:p + 5]) for p in range(max(1, len(words) - 4))} if words else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (min(len(a), len(b)) >= 0.79 * max(len(a), len(b)) and len(a & b) / len(a | b) >= least):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return sorted({top(i) for i in ids})


def variants(seed, copies, changed):
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    for _ in range(copies):
        words = list(base)
        for at in r.sample(range(200), r.randrange(changed + 1)):
            words[at] = f"x{r.randrange(10 ** 6)}"
        yield " ".join(words)


ROWS = list(enumerate(t for seed in range(30) for t in variants(seed, 6, 8)))
ROWS += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  two"), (1005, "one two three")]


def kept(df, **options):
    return sorted(r.doc_id for r in near_copies.one_of_each(df, **options).collect())


@pytest.mark.parametrize("chunk", [3, 256])
def test_near_copies_match_brute_force(spark, chunk):
    assert kept(spark.createDataFrame(ROWS, "doc_id long, text string"), chunk=chunk) == plain_groups(ROWS)


def test_the_stage_takes_all_pairs_of_0_8(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = plain_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect())
    assert got == expected


def test_the_stage_goes_by_simhash_links_and_verifies_them(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BANDS", near_copies.Bands(0, 5))  # no MinHash keys: candidates come from fingerprints only
    words = [f"w{i}" for i in range(200)]
    first, near = " ".join(words), " ".join(words[:-1] + ["other"])
    rows = [(1, first), (2, near), (3, None), (4, " "), (None, near)]
    assert bin((simhash.fingerprint(first, 5) ^ simhash.fingerprint(near, 5)) & (2 ** 64 - 1)).count("1") <= 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 3]


def test_groups_are_candidates_and_nothing_more(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BANDS", near_copies.Bands(0, 5))
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    one_group = df.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("text_hash"), F.lit(7).cast("long").alias("root"))
    assert kept(df, groups=one_group, chunk=16) == plain_groups(ROWS)


def test_stages_hand_whole_texts_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    corpus_pipeline.identify_language(spark, spark.createDataFrame([], "doc_id long, text string, lang string"), "")
    assert int(spark.conf.get(name)) <= 1_000
    spark.conf.unset(name)
