"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, connected components.

Equal fingerprints are one node.  64 bits are cut into ``blocks`` blocks; two
fingerprints at most ``distance`` bits apart agree on at least
``blocks - distance`` of them, so joining on every choice of that many blocks
finds every pair.  A bucket of up to ``bucket`` fingerprints is compared in one
task.  A larger one is cut into parts, and every pair of parts is compared in a
task of its own.  A task returns a spanning forest of the links it verified, so
a bucket of n fingerprints gives at most n - 1 rows and never all its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import stored


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of word shingles, as a signed 64-bit number; 0 without words."""
    if not text:
        return 0
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())), dtype="<u8", count=len(starts))
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[part:part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """Every column of ``df`` but the text, and ``fingerprint`` as a long; name no other column so."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return df.select(*[c for c in df.columns if c != text], of(F.col(text)).alias("fingerprint"))


def spanning_links(values: np.ndarray, distance: int) -> list[tuple[np.uint64, np.uint64]]:
    """A spanning forest of the graph that links ``values`` (unsigned, distinct) at most ``distance`` bits apart."""
    links = []
    rest = values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                met = rest[near]
                links.extend((at, x) for x in met)
                queue.extend(met)
                rest = rest[~near]
    return links


def block_keys(blocks: int, distance: int) -> list[tuple[int, int]]:
    """Number and bit mask of every choice of ``blocks - distance`` blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(n, signed(sum(masks[i] for i in c))) for n, c in enumerate(combinations(range(blocks), blocks - distance))]


def links(nodes: DataFrame, distance: int = 4, blocks: int = 6, bucket: int = 1024) -> DataFrame:
    """Distinct links a < b that span every component of the distinct ``nodes(fingerprint)``."""
    if not 0 <= distance < blocks:
        raise ValueError("there must be more blocks than differing bits")
    keys = F.array(*[F.struct(F.lit(n).alias("n"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for n, m in block_keys(blocks, distance)])
    keyed = nodes.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.n", "k.bits")
    shared = keyed.groupBy("n", "bits").count().where("count > 1")
    side = join_side(shared.select(F.col("n").alias("sn"), F.col("bits").alias("sbits"), F.ceil(F.col("count") / bucket).cast("int").alias("parts")), "sn", "sbits")
    member = (keyed.join(side, (F.col("n") == F.col("sn")) & (F.col("bits") == F.col("sbits")))
              .withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")))
    # A member of part p meets every part once: as the pairs (p, q >= p) and (q < p, p).
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("part")).alias("lo"), F.greatest(q, F.col("part")).alias("hi")))
    lists = (member.select("n", "bits", "fingerprint", F.explode(pairs).alias("pair"))
             .groupBy("n", "bits", "pair").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verify(members: pd.Series) -> pd.Series:
        def one(found: np.ndarray) -> list[dict]:
            values = np.asarray(found, dtype=np.int64).view(np.uint64)
            if len(values) == 2:
                pairs = [values] if np.bitwise_count(values[0] ^ values[1]) <= distance else []
            else:
                pairs = spanning_links(values, distance)
            signed = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return [{"a": min(p), "b": max(p)} for p in signed.tolist()]
        return pd.Series([one(m) for m in members])

    return lists.select(F.explode(verify("members")).alias("l")).select("l.a", "l.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node that a link of ``edges(a, b)`` touches.

    Contraction: in each round a node joins its neighbour of least hash (or
    stays), links are rewritten to what their ends joined and loops go.  The hash
    changes with the round, so that no numbering of nodes makes long chains
    shrink by one.  Only minima per node are gathered, and every round is written
    to the shared folder.
    """
    edges = stored(edges)
    members, number = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("to"))
        joins = stored(both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select(F.col("a").alias("node"), "m.to"))
        left = join_side(joins.select(F.col("node").alias("x"), F.col("to").alias("ta")), "x")
        right = join_side(joins.select(F.col("node").alias("y"), F.col("to").alias("tb")), "y")
        edges = stored(edges.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
                       .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct())
        step = join_side(joins.select(F.col("node").alias("x"), F.col("to").alias("t")), "x")
        members = joins.select("node", F.col("to").alias("root")) if members is None else stored(
            members.join(step, F.col("root") == F.col("x"), "left").select("node", F.coalesce("t", "root").alias("root")))
        number += 1
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return members


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, blocks: int = 6, shingle: int = 4) -> DataFrame:
    """key, text_hash, fingerprint (long), component and root of every row.

    ``component`` is the smallest key reachable over links, ``root`` one
    fingerprint that stands for the component.

    Rows of equal fingerprint are linked, texts without words (null, empty, blank)
    among them; they all have fingerprint 0.  Keys may repeat: each row stays a
    row.  Rows with a null key take part and are never the smallest, so a component of null keys only
    has a null id.  An empty table gives an empty one; other columns are not read.
    """
    rows = stored(with_fingerprint(df.select(
        F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")), "text", shingle))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select("fingerprint"), distance, blocks))
    joined = stored(nodes.join(join_side(roots, "node"), F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("fp"), "least", F.coalesce("root", "fingerprint").alias("root")))
    smallest = join_side(joined.groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "of"), "of")
    named = stored(joined.join(smallest, F.col("root") == F.col("of")).select("fp", "component", "root"))
    return rows.join(join_side(named, "fp"), F.col("fingerprint") == F.col("fp")).select(
        "key", "text_hash", "fingerprint", "component", "root")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of every component does: the one with the smallest key.

    Of several rows that have the component's smallest key (or, where all keys
    are null, of all its rows) one text stays, and of equal rows one.
    """
    return keep_one(df, near_duplicates(df, key, text, **options), key, text)


def keep_one(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """:func:`one_of_each` for the components of ``found(key, text_hash, root)``."""
    kept = (found.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "text_hash")).alias("m"))
            .select(F.col("m.key").alias("k"), F.col("m.text_hash").alias("h")))
    copies = found.groupBy("key", "text_hash").count()
    side = stored(kept.join(copies, F.col("k").eqNullSafe(F.col("key")) & (F.col("h") == F.col("text_hash")))
                  .select("k", "h", (F.col("count") > 1).alias("repeated")))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"))
    met = rows.join(join_side(side, "k", "h"), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    single = met.where("not repeated").select("row")
    first = met.where("repeated").dropDuplicates(["key", "text_hash"]).select("row")
    return single.union(first).select("row.*")
