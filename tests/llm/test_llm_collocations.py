"""Collocations: transducers against plain counts, the query against SQL and brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from radloom.llm import collocations as co, queries

WORDS = sorted([b"a", b"b", b"c", b"d", b"\x01", "é".encode()])


def phrases(rng, n, longest=3):
    return [tuple(rng.choice(WORDS) for _ in range(rng.randint(1, longest))) for _ in range(n)]


def transducer(found, longest=3):
    count = Counter(found)
    rows = np.array([[WORDS.index(w) + 1 for w in p] + [0] * (longest - len(p)) for p in sorted(count)], dtype=np.int64).reshape(-1, longest)
    return co.CountTransducer.from_sorted(WORDS, rows, np.array([count[p] for p in sorted(count)], dtype=np.int64))


@pytest.mark.parametrize("seed", range(60))
def test_union_sums_and_prunes(seed):
    rng = random.Random(seed)
    sides = [phrases(rng, rng.randint(1, 60)) for _ in range(3)]
    want = Counter(p[:k] for p in sum(sides, []) for k in range(1, len(p) + 1))
    least, edges = rng.choice([1, 3, 8]), [list(p) for p in phrases(rng, 2)]
    got = {tuple(p): c for _, p, c in co.union([co.CountTransducer.from_bytes(transducer(s).to_bytes()) for s in sides], least, edges)}
    assert got.pop(()) == sum(map(len, sides))
    assert all(want[p] == c for p, c in got.items())
    assert {p for p, c in want.items() if c >= least} <= set(got)
    rare = {p for p in got if got[p] < least}
    assert rare == {tuple(e[:k]) for e in edges for k in range(1, len(e)) if tuple(e[:k]) in want and want[tuple(e[:k])] < least}


def test_equal_states_are_kept_once():
    rows = [(first, b"a", b"b") for first in WORDS] + [(first, b"a", b"c") for first in WORDS]
    built = transducer(rows)
    assert [len(x) for x in built.arcs] == [6, 1, 2]


@pytest.mark.parametrize("seed", range(20))
def test_composition_is_the_intersection(seed):
    rng = random.Random(seed)
    text = lambda found: [b" ".join(p).decode() for p in sorted(set(found))]
    known, asked = text(phrases(rng, 30)), text(phrases(rng, 30))
    counts = {p: i + 1 for i, p in enumerate(known)}
    got = co.compose(co.CountTransducer.of_phrases(asked, np.ones(len(asked)), 3), co.CountTransducer.of_phrases(known, list(counts.values()), 3))
    assert {b" ".join(p).decode(): c for p, c in got} == {p: counts[p] for p in asked if p in counts}


def test_starts_do_not_depend_on_slices(monkeypatch):
    text = ("One two, THREE four\tfive six. . é ;seven\n\neight " * 30 + "x" * 90).encode()
    vocabulary = co.Vocabulary()
    whole = np.concatenate(list(co.starts(text, vocabulary, 3)))
    for size in (1, 7, 40):
        monkeypatch.setattr(co, "SLICE_BYTES", size)
        assert (np.concatenate(list(co.starts(text, vocabulary, 3))) == whole).all()
    assert vocabulary.keys() >= {b"three", "é".encode(), b"seven"} and b"," not in vocabulary


SCHEMA = "doc_id long, lang string, text string, phrase string, a string, range string"
TEXT = "New York City is big. New York is old; the New York Times, the City\tof New York City! "
ROWS = [(1, "en", TEXT * 4), (1, "en", TEXT * 4), (None, None, "ab ab ab ab " * 9), (4, "en", None), (5, None, ""), (6, "fr", " .,; \n"),
        (7, "und", "ab ab " * 6), (8, "de", "Ä b\x01 c " * 40 + "\n" + "z" * 5000), (9, "en", "a.b.c\rd " * 20), (10, "x", "p q r " * 10 + "p q " * 9)]
ROWS = [(*r, "p", "a", "r") for r in ROWS]


def brute(rows, least, longest, covered, first):
    count, total = Counter(), Counter()
    for _, lang, text, *_ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            count.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {}
    many = {p: c for p, c in count.items() if len(p[1]) > 1 and c >= least}
    for (lang, p), a in many.items():
        score, _, left, right = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(c >= covered * a and o == lang and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) for (o, q), c in many.items())
        if not inside:
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, n, p.decode(), -a, left, right, total[lang], -s) for lang, rows in found.items()
                  for n, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1))


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_query_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, queries.phrase_collocations(df).select(*COLUMNS).collect())) == brute(ROWS, 10, 3, 0.5, 2000)
    assert queries.phrase_collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert queries.phrase_collocations(df.where("doc_id in (4, 5, 6)")).count() == 0


def test_many_ranges_shards_and_longer_phrases(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = co.collocations(df, least=3, longest=4, covered=0.8, first=7, shard_words=40, range_words=25)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute(ROWS, 3, 4, 0.8, 7)


def test_products_beyond_64_bits():
    a, left, right = 9_000_000_000, 9_000_000_001, 9_000_000_002
    text = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    from pyspark.sql import SparkSession

    row = SparkSession.active().sql(f"select {a}L a, {left}L l, {right}L r").selectExpr(f"{text} as score").first()
    assert row.score == 10**6 * a * a // (left * right)


def test_given_table_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op12_phrase_collocations"](spark, folder).select(*COLUMNS).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select {', '.join(COLUMNS)} from ({queries.OP12_SQL})").fetchall())
