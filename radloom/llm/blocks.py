"""A stated query set against all rows, block by block.

Rows fall into index blocks of about ``index_rows`` and queries into blocks of
about ``query_rows``, both by a hash of the id; the numbers of blocks follow the counts.
A task gets one index block and one query block, so its memory is bounded, and
returns the best ``k`` rows of that block for each query.  The best of all
blocks are then chosen per query, from ``k`` rows per block.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def matrix(vectors: pd.Series, width: int, dtype) -> np.ndarray:
    """Rows of one width; missing trailing components are 0."""
    out = np.zeros((len(vectors), width), dtype=dtype)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best_in_blocks(rows: DataFrame, queries: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
                   score_type: str, k: int, index_rows: int, query_rows: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` best; ties go to the smaller vec_id.

    Both tables have ``id`` and ``vec``; ``find`` gets one block of each and
    returns query_id, vec_id and score of at least the ``k`` best of the block.
    """
    blocks = lambda n, size: max(1, -(-n // size))
    n_index, n_query = blocks(rows.count(), index_rows), blocks(queries.count(), query_rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(n_index)).alias("i"), spread(n_query).alias("q"))
    right = queries.select("id", "vec", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_query)).alias("q"), spread(n_index).alias("i"))

    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return find(index.sort_values("id", kind="stable", ignore_index=True), asked)

    found = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
