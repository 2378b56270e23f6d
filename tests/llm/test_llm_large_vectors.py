"""Vectors with components beyond what sums in 64 bits allow."""

import math

from radloom.llm import queries

ROWS = [(0, [1.5, -2.0, 0.25]), (1, [262_144.5, 1.0, -1.0]), (2, [0.5, 3.0, 1.0]), (3, [-3.0e6, 2.0, 1.0]), (4, [3.0, 1.0, 1.0]),
        (50, [262_145.0, 5.0, 0.5]), (100, [2.0e6, -1.0, 0.0]), (101, [1.0, 1.0, 1.0]), (102, [4.0e6, 4.0e6, 0.0])]


def test_large_vectors_take_part(spark):
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in queries.bit_sliced_top_k(
        spark.createDataFrame(ROWS, "vec_id long, embedding array<double>")).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in ROWS}
    expected = {}
    for q in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(v, whole[q])), i) for i, v in whole.items() if i != q)[:5]
        expected |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert got == expected
