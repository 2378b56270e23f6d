"""Sharding by vector bin packing: bytes, words and rows are balanced jointly.

Documents of equal text form a group and are placed together.  What is packed is
a bounded number of items: a group above ``heavy_share`` of a shard's capacity is
cut into pieces of at most about that share by its documents' ids, each an item of its own;
all lighter groups fall into ``light_items`` hash bundles.  At most
``3 * shards / heavy_share`` groups can be heavy, so the items fit in the driver
at any input size.  Items are placed largest first into the shard with the
highest dot product of item and residual capacity, among those that still hold it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from radloom.llm.common import stored, text_bytes, text_or_empty, word_count

DIMENSIONS = ("size", "tokens", "rows")
#: Rows of one shard that are numbered together.
CELL_ROWS = 5_000


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """A shard for every item; ``vectors`` are shares of one shard's capacity, a row per item."""
    residual = np.ones((shards, vectors.shape[1]))
    chosen = np.zeros(len(vectors), dtype=np.int32)
    for i in np.argsort(-vectors.max(axis=1), kind="stable") if len(vectors) else ():
        score = residual @ vectors[i]
        fits = (residual >= vectors[i] - 1e-12).all(axis=1)
        chosen[i] = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(score)
        residual[chosen[i]] -= vectors[i]
    return chosen


def pack_shards(df: DataFrame, shards: int = 24, light_items: int = 4096, heavy_share: float = 0.25,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, tokens, text_crc32, shard and slot (gapless from 0 in each shard) of every row.

    ``size`` is the text's UTF-8 bytes plus 8, ``tokens`` its words.  A null text
    counts as an empty one, in its group too.  Repeated rows are rows of their
    own; an empty table gives an empty one.  Columns other than the two named
    are not read.
    """
    spark = df.sparkSession
    body = text_or_empty(text)
    rows = stored(df.select(
        F.col(key).alias("key"), (text_bytes(F.col(text)) + 8).alias("size"), word_count(F.col(text)).alias("tokens"),
        F.lit(1).cast("long").alias("rows"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("group")))
    total = rows.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    capacity = {d: max(total[d], 1) / shards for d in DIMENSIONS}
    share = F.greatest(*[F.col(d) / F.lit(capacity[d]) for d in DIMENSIONS])
    heavy = (rows.groupBy("group").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).where(share > heavy_share)
             .select("group", F.ceil(share / heavy_share).cast("long").alias("pieces")))
    placed_as = stored(rows.join(F.broadcast(heavy), "group", "left").select(
        "key", "size", "tokens", "rows", "text_crc32",
        F.when(F.col("pieces").isNull(), F.pmod("group", F.lit(light_items))).otherwise(F.col("group")).alias("item"),
        F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.col("pieces"))).cast("long").alias("piece")))
    items = placed_as.groupBy("item", "piece").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).orderBy("item", "piece").collect()
    vectors = np.array([[r[d] / capacity[d] for d in DIMENSIONS] for r in items]).reshape(-1, len(DIMENSIONS))
    placed = spark.createDataFrame(
        [(r["item"], r["piece"], int(s)) for r, s in zip(items, place(vectors, shards))], "item long, piece long, shard int")
    cells = max(1, -(-total["rows"] // (shards * CELL_ROWS)))
    # Bounded by light_items plus the pieces of heavy groups.
    sharded = placed_as.join(F.broadcast(placed), ["item", "piece"]).withColumn(
        "cell", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sharded.groupBy("shard", "cell").count()
               .select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size")
    return (sharded.withColumn("n", F.row_number().over(inside) - 1).join(offsets, ["shard", "cell"])
            .select("key", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.col("n")).alias("slot")))
