"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Largest inner product becomes smallest angle: vectors are centred and one
component is added that gives all the same length.  Codes are the signs after a
rotation learned on a bounded sample (iterated against its own signs); several
rotations give more bits than dimensions.  A code is split into substrings, each
indexed by its value.  By the pigeonhole principle a code within the radius
agrees with the query's in some substring up to that substring's share of the
radius, so probing all such values retrieves every one; the survivors of the full Hamming test are
ranked by the exact inner product.  The radius is learned too: it covers
``cover`` of the true neighbours of sample queries in the sample.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from radloom.llm.blocks import best_in_blocks, matrix
from radloom.llm.common import stored


@dataclass(frozen=True)
class AnnOptions:
    """``sample`` bounds the vectors that codes are fitted on; every vector is indexed."""

    k: int = 20
    sample: int = 5_000
    sample_queries: int = 250
    rotations: int = 2
    substring_bits: int = 8
    cover: float = 0.97
    rounds: int = 20
    index_rows: int = 8_192
    query_rows: int = 512
    seed: int = 7


@dataclass(frozen=True)
class Codes:
    """Learned centre, length and rotations; ``radius`` in bits."""

    mean: np.ndarray
    length: float
    rotation: np.ndarray
    radius: int

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        return np.packbits(lifted @ self.rotation > 0, axis=1)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Bytes of the codes of indexed vectors."""
        y = x - self.mean
        rest = np.sqrt(np.maximum(self.length ** 2 - (y ** 2).sum(axis=1), 0))
        return self._signs(np.column_stack([y, rest]))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._signs(np.column_stack([x, np.zeros(len(x))]))


def fit(sample: np.ndarray, options: AnnOptions) -> Codes:
    """Learn codes on a sample (at least one row)."""
    rng = np.random.default_rng(options.seed)
    mean = sample.mean(axis=0)
    y = sample - mean
    length = float(np.sqrt((y ** 2).sum(axis=1).max()))
    lifted = np.column_stack([y, np.sqrt(np.maximum(length ** 2 - (y ** 2).sum(axis=1), 0))])
    rotations = []
    for _ in range(options.rotations):
        r = np.linalg.qr(rng.standard_normal((lifted.shape[1],) * 2))[0]
        for _ in range(options.rounds):
            u, _, v = np.linalg.svd(lifted.T @ np.where(lifted @ r > 0, 1.0, -1.0))
            r = u @ v
        rotations.append(r)
    codes = Codes(mean, length, np.hstack(rotations), 0)
    asked = sample[:options.sample_queries]
    scores = asked @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(options.k, len(sample) - 1)
    if k < 1:
        return Codes(mean, length, codes.rotation, codes.rotation.shape[1])
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(codes.of_queries(asked)[:, None] ^ codes.of_rows(sample)[near]).sum(axis=2)
    return Codes(mean, length, codes.rotation, int(np.ceil(np.quantile(apart, options.cover))))


class MultiIndex:
    """One block's codes, indexed by every substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.ends = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(codes.T, self.order)]
        apart = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        self.probes = {r: [np.flatnonzero(a <= r) for a in apart] for r in range(9)}

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows at most ``radius`` bits from a code."""
        parts = len(self.order)
        share, more = divmod(radius, parts)
        hit = np.zeros(len(self.codes), dtype=bool)
        for i, (order, ends) in enumerate(zip(self.order, self.ends)):
            # Were the first ``more + 1`` substrings over ``share`` and the others over ``share - 1``, the code would be out of reach.
            reach = min(share if i <= more else share - 1, 8)
            for value in self.probes[reach][code[i]] if reach >= 0 else ():
                hit[order[ends[value]:ends[value + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec of the vectors that take part: not null, not zero, all components finite."""
    vec = F.col(vector).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col(key).alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def nearest(df: DataFrame, every: int, key: str = "vec_id", vector: str = "embedding", options: AnnOptions | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest rows found for each row whose id divides by ``every``.

    A query's own id is no candidate of it.  Shorter vectors count as padded with
    zeros.  A block in which fewer than ``k`` rows lie within the radius is searched whole,
    so fewer than ``k`` rows are returned only if there are no more.  Rows without an id, null, zero and
    non-finite vectors take no part; a repeated id is several candidates.
    """
    options = options or AnnOptions()
    spark = df.sparkSession
    rows = stored(usable(df, key, vector))
    sample = rows.orderBy(F.xxhash64("id", F.lit(options.seed)), "id").limit(options.sample).toPandas()
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    if not len(sample):
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    codes = spark.sparkContext.broadcast(fit(matrix(sample["vec"], width, np.float64), options))

    def find(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        x, ids = matrix(index["vec"], width, np.float64), index["id"].to_numpy()
        search = MultiIndex(codes.value.of_rows(x))
        out = []
        q = matrix(asked["vec"], width, np.float64)
        for query, vec, code in zip(asked["id"], q, codes.value.of_queries(q)):
            near = search.within(code, codes.value.radius)
            near = near[ids[near] != query]
            if len(near) < options.k:
                near = np.flatnonzero(ids != query)
            scores = (x[near] * vec).sum(axis=1)
            best = np.lexsort((ids[near], -scores))[:options.k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near[best]], "score": scores[best]}))
        return pd.concat(out)

    asked = rows.where(F.col("id") % every == 0)
    return best_in_blocks(rows, asked.dropDuplicates(["id"]), find, "double", options.k, options.index_rows, options.query_rows)
