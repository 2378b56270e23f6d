"""Exact top-k by a bit-sliced index: bitmap addition, then selection from the highest slice down.

Components are whole numbers, shifted per attribute to start at 0; slice b of an
attribute is a bitmap of the rows whose value has bit b.  A query's score is the
sum of its weights' bits times attribute slices.  A negative weight takes the
complement of the slices, which shifts all scores alike.  All bitmaps of one
weight (place value) are added three at a time: a full adder turns three into
one of the same place and one of the next, until one bitmap is left per place.

Rows are then chosen from the highest place down: rows that have the bit are
surely above those that do not, so either they are all taken, or the choice
narrows to them.  What is left at the end ties exactly, and goes by the smaller id.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from radloom.llm.blocks import best_in_blocks, matrix
from radloom.llm.common import stored


def largest(width: int) -> float:
    """Scaled components below this are summed in 64 bits over ``width`` of them."""
    return float(2 ** ((62 - max(1, width - 1).bit_length()) // 2))


class BitSlices:
    """The slices of one block of vectors; a row's place in the bitmaps is its place in the block."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        low = values.min(axis=0)
        shifted = (values - low).astype(np.uint64)
        self.bits = max(1, int(shifted.max()).bit_length())
        padded = np.zeros((-(-self.rows // 64) * 64, values.shape[1]), dtype=np.uint64)
        padded[:self.rows] = shifted
        self.slices = np.stack([
            np.packbits(np.ascontiguousarray((padded >> np.uint64(b) & np.uint64(1)).astype(bool).T), axis=1, bitorder="little").view(np.uint64)
            for b in range(self.bits)], axis=1)  # attribute, bit, words
        self.complements = ~self.slices
        self.everyone = np.packbits(np.arange(len(padded)) < self.rows, bitorder="little").view(np.uint64)

    def score(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's score, lowest first, but for a constant that all rows share."""
        places: dict[int, list[np.ndarray]] = {}
        size = np.abs(weights)
        for w in range(int(size.max()).bit_length()):
            chosen = size >> w & 1 == 1
            some = np.concatenate([self.slices[chosen & (weights > 0)], self.complements[chosen & (weights < 0)]])
            for b in range(self.bits) if len(some) else ():
                places.setdefault(w + b, []).append(some[:, b])
        out: list[np.ndarray] = []
        place = 0
        while place <= max(places, default=-1):
            parts = places.pop(place, [])
            stack = np.concatenate(parts) if parts else np.zeros((1, len(self.everyone)), dtype=np.uint64)
            while len(stack) > 1:
                if len(stack) == 2:
                    a, b = stack
                    stack, carry = (a ^ b)[None], (a & b)[None]
                else:
                    whole = len(stack) // 3 * 3
                    a, b, c = stack[:whole].reshape(-1, 3, stack.shape[1]).transpose(1, 0, 2)
                    half = a ^ b
                    stack, carry = np.concatenate([half ^ c, stack[whole:]]), a & b | half & c
                places.setdefault(place + 1, []).append(carry)
            out.append(stack[0])
            place += 1
        return out

    def top(self, score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
        """Rows with the ``k`` highest scores among a bitmap's rows; ties go to the first rows."""
        taken, open_ = np.zeros_like(among), among
        for bits in reversed(score):
            ones = open_ & bits
            n = int(np.bitwise_count(taken | ones).sum())
            if n > k:
                open_ = ones
            else:
                taken, open_ = taken | ones, open_ & ~bits
                if n == k:
                    break
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        sure = rows(taken)
        return np.concatenate([sure, rows(open_)[:k - len(sure)]])


def quantised(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id and vec, scale * x of each component before it is floored, of the vectors that take part.

    Null vectors and those with null or non-finite components take no part, nor do
    rows without an id; an empty vector is all zeros.
    """
    given = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("given")).where(F.col("id").isNotNull() & F.col("given").isNotNull())
    finite = F.forall("given", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return given.where(finite).select("id", F.transform("given", lambda x: x * scale).alias("vec"))


def whole(vector) -> list[int]:
    return [math.floor(x) for x in vector]


def best_wide(ids: np.ndarray, rows: list[list[int]], query: int, weights: list[int], k: int) -> tuple[list[int], list[int]]:
    """Ids and scores of the ``k`` best of ``rows`` in Python integers; ties go to the smaller id."""
    scored = sorted((-sum(a * b for a, b in zip(row, weights)), i) for i, row in zip(ids.tolist(), rows) if i != query)[:k]
    return [i for _, i in scored], [-s for s, _ in scored]


def highest(df: DataFrame, every: int, k: int, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
            index_rows: int = 8_192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score (integer inner product) of the ``k`` highest rows for each row whose id divides by ``every``.

    Exact.  A query's own id is no candidate of it; a repeated id is several
    candidates.  Shorter vectors count as padded with zeros; an empty table gives an empty result.
    Rows with a component too large for sums in 64 bits are scored in Python integers;
    a score that is no 64-bit number is an error, as in the SQL.
    """
    rows = stored(quantised(df, key, vector, scale))
    width = max(1, rows.agg(F.max(F.size("vec"))).first()[0] or 1)
    bound = largest(width)

    def find(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        wide = lambda vectors: np.array([len(v) > 0 and bool(np.abs(v).max() >= bound) for v in vectors], dtype=bool)
        over, asked_over = wide(index["vec"]), wide(asked["vec"])
        all_ids = index["id"].to_numpy()
        ids, out = all_ids[~over], []
        large = [whole(v) for v in index["vec"][over]]
        small = [whole(v) for v in index["vec"][~over]] if asked_over.any() else []
        values = matrix([np.floor(v).astype(np.int64) for v in index["vec"][~over]], width, np.int64)
        search = BitSlices(values) if len(ids) else None
        bits = np.zeros(len(search.everyone) * 64 if search else 0, dtype=bool)
        for query, vector, asks_wide in zip(asked["id"], asked["vec"], asked_over):
            exact = whole(vector)
            found, scores = best_wide(all_ids[over], large, query, exact, k)
            if asks_wide:
                more = best_wide(ids, small, query, exact, k)
                found, scores = found + more[0], scores + more[1]
            elif search:
                weights = matrix([exact], width, np.int64)[0]
                bits[:len(ids)] = ids != query
                best = search.top(search.score(weights), np.packbits(bits, bitorder="little").view(np.uint64), k)
                found, scores = found + ids[best].tolist(), scores + (values[best] @ weights).tolist()
            out.append(pd.DataFrame({"query_id": query, "vec_id": np.array(found, dtype=np.int64), "score": np.array(scores, dtype=np.int64)}))
        return pd.concat(out)

    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    return best_in_blocks(rows, asked, find, "long", k, index_rows, query_rows)
