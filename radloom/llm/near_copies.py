"""Near copies by the Jaccard similarity of word shingles: candidates by SimHash groups and MinHash keys, exact verification.

Texts of equal words are one node.  A node's shingles give ``bands`` keys of
``rows`` minima each; nodes that share a key are candidates, and what candidates
connect is a cluster; the groups of :mod:`radloom.llm.simhash` are candidates as well.  Every pair is then judged inside its cluster by the exact
similarity of the whole texts, so no link is wrong; a pair at similarity s shares no
key with probability (1 - s**rows)**bands, 3e-6 at 0.8, and less above it.

A cluster over ``chunk`` texts or ``chunk_bytes`` is cut into parts.  Each part meets the
cluster's first text; only the texts that this leaves apart meet all parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import stored
from radloom.llm.simhash import components, keep_one

_random = np.random.default_rng(42)
_draw = lambda *shape: _random.integers(0, 2 ** 64, shape, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only


def shingles(words: list[bytes], shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of ``shingle`` words; a shorter text is one shingle, one without words has none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:1 - shingle].tolist(), ends[shingle - 1:].tolist()) if len(words) > shingle else [(0, len(joined))]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype=np.uint64))


class Bands:
    """Keys of a set of shingles."""

    def __init__(self, bands: int, rows: int):
        self.shape = (bands, rows)
        self.flips, self.factors = _draw(bands * rows, 1), _draw(bands * rows, 1) | np.uint64(1)
        self.weights, self.offsets = _draw(bands, rows) | np.uint64(1), _draw(bands)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flips), 2 ** 64 - 1, dtype=np.uint64)
        for part in range(0, len(hashes), 512):
            least = np.minimum(least, ((hashes[None, part:part + 512] ^ self.flips) * self.factors).min(axis=1))
        return ((least.reshape(self.shape) * self.weights).sum(axis=1, dtype=np.uint64) + self.offsets).view(np.int64)


BANDS = Bands(32, 5)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < least * large * 0.999:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both) >= least


def spanning(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """A spanning forest of the graph that links similar sets."""
    found, rest = [], list(range(len(sets)))
    while len(rest) > 1:
        queue = [rest.pop(0)]
        while queue and rest:
            at = queue.pop()
            near = [i for i in rest if similar(sets[at], sets[i], least)]
            found.extend((at, i) for i in near)
            queue.extend(near)
            met = set(near)
            rest = [i for i in rest if i not in met]
    return found


def _linked(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame([(min(p), max(p)) for p in pairs], columns=["a", "b"], dtype="int64")


def _links(texts: DataFrame, shingle: int, least: float, chunk: int, chunk_bytes: int) -> DataFrame:
    """Links a < b that span every component of similar ``texts(root, node, text)``, one row per node."""
    parts = lambda: F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum(F.octet_length("text")) / chunk_bytes), F.lit(1)).cast("int")
    sizes = stored(texts.groupBy("root").agg(parts().alias("parts"), F.min("node").alias("lead")).withColumnRenamed("root", "of"))
    sized = texts.join(join_side(sizes, "of"), F.col("root") == F.col("of"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)

    def within(group: pd.DataFrame) -> pd.DataFrame:
        nodes, sets = group["node"].tolist(), [shingles(words_of(t), shingle) for t in group["text"]]
        return _linked([(nodes[i], nodes[j]) for i, j in spanning(sets, least)])

    # The first text is in every part.
    placed = sized.select("root", "node", "text", F.explode(F.when(F.col("node") == F.col("lead"), every("parts")).otherwise(F.array(part))).alias("part"))
    found = stored(placed.groupBy("root", "part").applyInPandas(within, "a long, b long"))
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return found

    known = components(found).select(F.col("node").alias("x"), F.col("root").alias("group"))
    parted = stored(texts.join(join_side(large, "of"), F.col("root") == F.col("of")).join(join_side(known, "x"), F.col("node") == F.col("x"), "left")
                    .select("root", "node", "text", "lead", "parts", F.coalesce("group", "node").alias("group")))
    leads = parted.where("node = lead").select(F.col("root").alias("of"), F.col("group").alias("main"))
    apart = stored(parted.join(join_side(leads, "of"), F.col("root") == F.col("of")).where("group <> main").drop("of", "main"))
    if apart.isEmpty():
        return found
    chunks = stored(apart.groupBy("root").agg(parts().alias("chunks")).withColumnRenamed("root", "of"))
    cut = lambda df: df.join(join_side(chunks, "of"), F.col("root") == F.col("of"))
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    left = cut(apart).select("root", own.alias("chunk"), F.explode(every("parts")).alias("part"), "node", "group", "text", F.lit(True).alias("asks"))
    right = cut(parted).select("root", F.explode(every("chunks")).alias("chunk"), part.alias("part"), "node", "group", "text", F.lit(False).alias("asks"))

    def across(group: pd.DataFrame) -> pd.DataFrame:
        nodes, groups, asks = (group[c].tolist() for c in ("node", "group", "asks"))
        sets, up, pairs = [shingles(words_of(t), shingle) for t in group["text"]], {g: g for g in groups}, []

        def top(g: int) -> int:
            while up[g] != g:
                up[g] = g = up[up[g]]
            return g

        for i in (i for i, asking in enumerate(asks) if asking):
            for j in (j for j, asking in enumerate(asks) if not asking):
                if top(groups[i]) != top(groups[j]) and similar(sets[i], sets[j], least):
                    up[top(groups[i])] = top(groups[j])
                    pairs.append((nodes[i], nodes[j]))
        return _linked(pairs)

    return found.union(stored(left.union(right).groupBy("root", "chunk", "part").applyInPandas(across, "a long, b long")))


def _of_groups(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates a, b from ``groups(key, text_hash, root)``: every node of a group with the group's first."""
    named = groups.select(F.col("key").alias("k"), F.col("text_hash").alias("h"), F.col("root").alias("group")).distinct()
    placed = stored(nodes.join(join_side(named, "k", "h"), F.col("m.key").eqNullSafe(F.col("k")) & (F.col("m.text_hash") == F.col("h"))).select("node", "group"))
    shared = placed.groupBy("group").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("group").alias("of"), "lead")
    return placed.join(join_side(shared, "of"), F.col("group") == F.col("of")).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8,
                chunk: int = 256, chunk_bytes: int = 2 ** 23, groups: DataFrame | None = None) -> DataFrame:
    """key, text_hash and root of every row; rows of one root are connected by pairs of similarity ``least`` or more.

    Whole texts count.  Rows of equal words are linked, those without words (null, empty, blank) among them.
    ``groups(key, text_hash, root)``, as :func:`radloom.llm.simhash.near_duplicates` gives them, are candidates beside the
    MinHash keys; a row of ``df`` that is missing there has its keys only.
    """
    bands = BANDS

    @F.pandas_udf("node long, bands array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        nodes, keys = [], []
        for words in map(words_of, texts):
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), 7) if words else 0)
            keys.append(bands.of(shingles(words, shingle)) if words else np.zeros(0, dtype=np.int64))
        return pd.DataFrame({"node": np.array(nodes, dtype=np.uint64).view(np.int64), "bands": keys})

    source = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = stored(source.select("key", "text_hash", sketch("text").alias("s")).select("key", "text_hash", "s.*"))
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "text_hash")).alias("m"), F.first("bands").alias("bands")))
    keyed = nodes.select("node", F.explode("bands").alias("bits"))
    shared = keyed.groupBy("bits").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select(F.col("bits").alias("of"), "lead")
    near = keyed.join(join_side(shared, "of"), F.col("bits") == F.col("of")).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    near = near if groups is None else near.union(_of_groups(nodes, groups))
    clusters = components(near.distinct()).select(F.col("node").alias("x"), "root")
    members = stored(nodes.join(join_side(clusters, "x"), F.col("node") == F.col("x")).select(
        "root", "node", F.col("m.key").alias("k"), F.col("m.text_hash").alias("h")))
    texts = stored(source.join(join_side(members, "k", "h"), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
                   .select("root", "node", "text").dropDuplicates(["node"]))
    roots = components(_links(texts, shingle, least, chunk, chunk_bytes)).select(F.col("node").alias("x"), "root")
    return rows.join(join_side(roots, "x"), F.col("node") == F.col("x"), "left").select("key", "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay when one document of every group of near copies does: the one with the smallest key."""
    return keep_one(df, near_copies(df, key, text, **options), key, text)
