"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes.  Where tokens of both end at one byte the text falls into groups; a group of
one token each is the common case and comes in stretches.  Along a stretch the token indices of both sides differ by a constant
shift, so :func:`align` compares slices of the two end arrays at the current shift, doubling the slice while they agree and
halving it after that, and jumps the whole stretch.  An irregular group is resolved token by token, which gives a new shift.

Both tokenizers cut before a space between two visible characters, whatever stands around it, so a task encodes and aligns every distinct
stretch of text between such spaces once, new ones end to end as one long pair of arrays, and puts a text's groups and links together
from that table; with a model whose pieces could hold such a place, the stretches are whole texts.

How many documents link a pair of ids is a question to the whole corpus.  A task numbers its documents in chunks of
bounded size and writes a chunk's distinct (pair, document, times) triples sorted and compressed, one blob per
hash bucket of pairs.  Counts are a grouped sum over the blobs' own counts; the blobs then meet the counts of their bucket, buckets
with many bytes dealt out to several tasks, and hand back sums per document.  No text or token moves through a shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, BinaryType, IntegerType, StructField, StructType

from radloom.llm import bpe
from radloom.llm.common import stored

#: Links that a chunk holds at least before it is written.
CHUNK_LINKS = 1_000_000
#: Hash buckets of id pairs, and blob bytes of a bucket that one task takes.
BUCKETS = 32
TASK_BYTES = 16_000_000
#: Stretches, and characters of them, in a task's table before it is cut down to those met again; texts that are split and encoded together.
TABLE_STRETCHES = 150_000
TABLE_CHARS = 3_000_000
MET_AGAIN = 3
SLICE = 128

#: The character that stands for a space in a piece.
BLANK = "\u2581"
CUT = re.compile(r"(?<=\S)(?= \S)")


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups of two rising lists of ends that stop at the same byte, and the links inside irregular ones.

    Three numbers a stretch, one after the other: the index of the last A token of its first group, its number of groups, and the
    shift from there to the B token that ends with it.  A stretch is a run of one-to-one groups, or one irregular group, whose
    number is -1.  The links of irregular groups are two lists of indices; each next pair drops the token that ends first.
    """
    found, links_a, links_b = [], [], []
    i, shift, n = 0, 0, len(ends_a)
    while i < n:
        j = i + shift
        a, b = ends_a[i], ends_b[j]
        if a == b:
            at, step, growing = i + 1, 1, True
            while step:
                probe = ends_a[at:at + step]
                if len(probe) == step and probe == ends_b[at + shift:at + shift + step]:
                    at += step
                    step = step * 2 if growing else step // 2
                else:
                    growing = False
                    step //= 2
            found += (i, at - i, shift)
            i = at
        else:
            links_a.append(i)
            links_b.append(j)
            while a != b:
                if a < b:
                    i += 1
                    a = ends_a[i]
                else:
                    j += 1
                    b = ends_b[j]
                links_a.append(i)
                links_b.append(j)
            shift = j - i
            found += (i, -1, shift)
            i += 1
    return found, links_a, links_b


class _Side:
    """The vocabulary of a side: bytes of its ids, and the ids written out in front of either separator."""

    def __init__(self, bytes_of: list[bytes], inner: str, last: str):
        self.bytes_of = bytes_of
        self.sizes = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.names = [f"{i}{mark}" for i in range(len(bytes_of)) for mark in (inner, last)]


class ByteTokens(_Side):
    """Side A: a byte-level vocabulary of the tokenizers library; the strings of special tokens are ordinary text."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(bpe.Decoder(tokenizer).pieces.tolist(), ",", "|")
        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(tokenizer)
        #: With a piece for every byte and nothing changed before splitting, ids always give their text back.
        self.lossless = not spec.get("normalizer") and set(bpe.byte_of_char()) <= spec["model"]["vocab"].keys()

    def ids_of(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]


class PieceTokens(_Side):
    """Side B: a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)], ",", ";")
        self.cuts = not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)

    def ids_of(self, stretches: list[str]) -> list[list[int]]:
        return self.model.encode([s[1:] for s in stretches], num_threads=1)


class _Table:
    """Numbers by the number of a stretch."""

    def __init__(self):
        self.ids, self.starts = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def keep(self, at: np.ndarray) -> None:
        self.ids, self.starts = self.gather(at), np.concatenate([[0], np.cumsum(self.starts[at + 1] - self.starts[at])])

    def gather(self, at: np.ndarray) -> np.ndarray:
        first, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        return self.ids[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)]


@dataclass
class Aligned:
    """``links`` are pair codes: the id of A times the size of B, plus the id of B."""

    n_a: int
    n_b: int
    n_groups: int
    links: np.ndarray
    groups: str


NOTHING = Aligned(0, 0, 0, np.zeros(0, dtype=np.int64), "")


class Aligner:
    """Both tokenizers of one task and the table of the stretches it has met."""

    def __init__(self, tokenizer: str, model: bytes):
        self.a, self.b = ByteTokens(tokenizer), PieceTokens(model)
        self.width, self.names = len(self.b.bytes_of), self.a.names + self.b.names
        self.places: dict[str, int] = {}
        self.said: list[str] = []
        #: Per stretch: whether both sides give it back, its tokens of A and of B, its groups, and how often it was met.
        self.same, self.counts, self.met = np.zeros(0, dtype=bool), np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.links, self.chars = _Table(), 0

    def _cut_down(self) -> None:
        """Keep the stretches that were met again, at most half of the table."""
        again = np.flatnonzero(self.met >= MET_AGAIN)
        again = np.sort(again[np.argsort(-self.met[again], kind="stable")][:TABLE_STRETCHES // 2])
        names = list(self.places)
        self.places = {names[k]: i for i, k in enumerate(again.tolist())}
        self.said = [self.said[k] for k in again.tolist()]
        self.links.keep(again)
        self.same, self.counts, self.met = self.same[again], self.counts[again], np.zeros(len(again), dtype=np.int64)
        self.chars = sum(map(len, self.places))

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode and align the stretches that the table lacks."""
        if len(self.places) > TABLE_STRETCHES or self.chars > TABLE_CHARS:
            self._cut_down()
            if self.chars > TABLE_CHARS:
                self.met[:] = 0
                self._cut_down()
        new = [s for s in dict.fromkeys(itertools.chain.from_iterable(texts)) if s not in self.places]
        if not new:
            return
        found_a, found_b = self.a.ids_of(new), self.b.ids_of(new)
        bytes_a, bytes_b = self.a.bytes_of.__getitem__, self.b.bytes_of.__getitem__
        same = np.array([b"".join(map(bytes_b, ids)) == s.encode() for s, ids in zip(new, found_b)], dtype=bool)
        if not self.a.lossless:
            same &= np.array([b"".join(map(bytes_a, ids)) == s.encode() for s, ids in zip(new, found_a)], dtype=bool)
        self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
        self.chars += sum(map(len, new))
        counts, said, links, link_counts = self._align_new([x for x, ok in zip(found_a, same) if ok], [x for x, ok in zip(found_b, same) if ok])
        whole, texts_of = np.zeros((len(new), 3), dtype=np.int64), np.full(len(new), "", dtype=object)
        whole[same], texts_of[same] = counts, said
        per_stretch = np.zeros(len(new), dtype=np.int64)
        per_stretch[same] = link_counts
        self.links.add(links, per_stretch)
        self.said += texts_of.tolist()
        self.same, self.counts = np.concatenate([self.same, same]), np.concatenate([self.counts, whole])
        self.met = np.concatenate([self.met, np.zeros(len(new), dtype=np.int64)])

    def _align_new(self, found_a: list[list[int]], found_b: list[list[int]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts (tokens of A, of B, groups), groups written out, link codes and their number, of stretches laid end to end."""
        if not found_a:
            return np.zeros((0, 3), dtype=np.int64), [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        n_a, n_b = (np.array([len(x) for x in found], dtype=np.int64) for found in (found_a, found_b))
        a, b = (np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=n) for found, n in ((found_a, n_a.sum()), (found_b, n_b.sum())))
        found, inner_a, inner_b = align(np.cumsum(self.a.sizes[a]).tolist(), np.cumsum(self.b.sizes[b]).tolist())
        first, count, shift = np.array(found, dtype=np.int64).reshape(-1, 3).T
        runs = np.abs(count)
        # The last token of every group on either side, and the groups of one token each.
        last_a = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        last_b = last_a + np.repeat(shift, runs)
        single = np.repeat(count > 0, runs)
        at_a = np.concatenate([last_a[single], np.array(inner_a, dtype=np.int64)])
        at_b = np.concatenate([last_b[single], np.array(inner_b, dtype=np.int64)])
        # Every stretch ends a group, so links and groups fall to stretches by their token of A.
        stretch = np.repeat(np.arange(len(n_a)), n_a)
        order = np.argsort(at_a, kind="stable")
        links = a[at_a[order]] * self.width + b[at_b[order]]
        link_counts, groups = np.bincount(stretch[at_a], minlength=len(n_a)), np.bincount(stretch[last_a], minlength=len(n_a))
        # A group's tokens of A are written before those of B, all before the next group.
        width_a, width_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        ends_a, ends_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        ends_a[last_a], ends_b[last_b] = 1, 1
        names = np.empty(len(a) + len(b), dtype=np.int64)
        names[np.arange(len(a)) + np.repeat(last_b + 1 - width_b, width_a)] = 2 * a + ends_a
        names[np.arange(len(b)) + np.repeat(last_a + 1, width_b)] = 2 * b + ends_b + len(self.a.names)
        written = list(map(self.names.__getitem__, names.tolist()))
        cuts = [0, *np.cumsum(n_a + n_b).tolist()]
        said = ["".join(written[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
        return np.stack([n_a, n_b, groups], axis=1), said, links, link_counts

    def align_all(self, texts: list[str | None]) -> list[Aligned]:
        """One result per text; a text that is null, empty or not given back byte for byte by both has none."""
        cut = CUT.split if self.b.cuts else lambda text: [text]
        split = [cut(" " + t) if t else [] for t in texts]
        self._learn(split)
        known = self.places.__getitem__
        places = [np.fromiter(map(known, stretches), dtype=np.int64, count=len(stretches)) for stretches in split]
        self.met += np.bincount(np.concatenate(places), minlength=len(self.met))
        return [self._one(at) for at in places]

    def _one(self, at: np.ndarray) -> Aligned:
        if not len(at) or not self.same[at].all():
            return NOTHING
        n_a, n_b, n_groups = self.counts[at].sum(axis=0).tolist()
        return Aligned(n_a, n_b, n_groups, self.links.gather(at), "".join(map(self.said.__getitem__, at.tolist()))[:-1])


def _mixed(codes: np.ndarray) -> np.ndarray:
    """The hash bucket of a pair."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BUCKETS)


def pack(codes: np.ndarray, places: np.ndarray, times: np.ndarray) -> bytes:
    """Triples sorted by pair and document."""
    heads = np.concatenate([codes[:1], np.diff(codes)]).astype("<u8")
    body = b"".join([np.array([len(codes)], dtype="<u8").tobytes(), heads.view("u1").reshape(-1, 8).T.tobytes(),
                     places.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), times.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()])
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="u1")
    n = int(body[:8].view("<u8")[0])
    cut = lambda at, width: np.ascontiguousarray(body[at:at + width * n].reshape(width, n).T).view(f"<u{width}").ravel()
    return np.cumsum(cut(8, 8).astype(np.int64)), cut(8 + 8 * n, 4), cut(8 + 12 * n, 4)


class _Chunk:
    """Documents of a task whose links are written together."""

    def __init__(self, number: int):
        self.number, self.documents, self.links, self.codes, self.sizes = number, 0, 0, [], []

    def add(self, codes: np.ndarray) -> int:
        self.codes.append(codes)
        self.sizes.append(len(codes))
        self.links += len(codes)
        self.documents += 1
        return self.documents - 1

    def blobs(self) -> Iterator[tuple[int, bytes]]:
        if not self.links:
            return
        place = np.repeat(np.arange(self.documents, dtype=np.uint64), self.sizes)
        width = np.uint64(max(1, self.documents))
        triples, times = np.unique(np.concatenate(self.codes).astype(np.uint64) * width + place, return_counts=True)
        codes, places = triples // width, triples % width
        bucket = _mixed(codes)
        for k in range(BUCKETS):
            here = bucket == k
            if here.any():
                yield k, pack(codes[here].astype(np.int64), places[here], times[here])


DOCUMENT, LINKS = 0, 1


def _aligned_rows(docs: DataFrame, key: str, text: str, tokenizer: str, model: bytes, keep_groups: bool, chunk_links: int) -> DataFrame:
    """Rows of two kinds: a document's own figures with its chunk and place, and a chunk's blobs."""
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = StructType([StructField("kind", IntegerType()), StructField("key", docs.schema[key].dataType), StructField("chunk", LongType()),
                         StructField("place", LongType()), *[StructField(n, LongType()) for n in numbers], StructField("groups_sha256", StringType()),
                         StructField("groups", StringType()), StructField("bucket", IntegerType()), StructField("blob", BinaryType())])
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = Aligner(*shared.value), TaskContext.get().partitionId()
        chunk = _Chunk(part << 32)
        kind_of_key = None

        def batch_of(n: int, **columns) -> pa.RecordBatch:
            types = {"kind": pa.int32(), "key": kind_of_key, "groups_sha256": pa.string(), "groups": pa.string(), "bucket": pa.int32(), "blob": pa.binary()}
            arrays = [columns[f] if isinstance(columns.get(f), pa.Array) else pa.array(columns.get(f, [None] * n), types.get(f, pa.int64())) for f in schema.names]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        def written(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
            for bucket, blob in chunk.blobs():
                yield batch_of(1, kind=[LINKS], chunk=[chunk.number], bucket=[bucket], blob=[blob])

        for batch in batches:
            kind_of_key = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE):
                part_of = batch.slice(at, SLICE)
                rows = {f: [] for f in ("chunk", "place", *numbers, "groups_sha256", "groups")}
                full = []
                for x in aligner.align_all(part_of.column(1).to_pylist()):
                    rows["chunk"].append(chunk.number)
                    rows["place"].append(chunk.add(x.links))
                    for name, value in zip(numbers, (x.n_a, x.n_b, x.n_groups, len(x.links))):
                        rows[name].append(value)
                    rows["groups_sha256"].append(hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "")
                    rows["groups"].append(x.groups if keep_groups else None)
                    if chunk.links >= chunk_links:
                        full.append(chunk)
                        chunk = _Chunk(chunk.number + 1)
                yield batch_of(part_of.num_rows, kind=[DOCUMENT] * part_of.num_rows, key=part_of.column(0), **rows)
                for done in full:
                    yield from written(done)
        yield from written(chunk)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def _blob_counts(links: DataFrame) -> DataFrame:
    """``bucket``, ``code`` and ``documents`` over all blobs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, count = np.unique(unpack(blob.as_py())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), bucket, dtype=np.int32)), pa.array(codes), pa.array(count.astype(np.int64))],
                                                 names=["bucket", "code", "documents"])

    found = links.select("bucket", "blob").mapInArrow(run, "bucket int, code long, documents long")
    return found.groupBy("bucket", "code").agg(F.sum("documents").alias("documents"))


def _document_sums(links: DataFrame, counts: DataFrame, task_bytes: int) -> DataFrame:
    """``chunk``, ``place``, ``n_best`` and ``count_sum``: blobs meet their bucket's counts; a bucket of many bytes is dealt to several tasks."""
    # At most BUCKETS rows.
    sizes = {r.bucket: r.bytes for r in links.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("bytes")).collect()}
    deals = F.get(F.array(*[F.lit(max(1, -(-sizes.get(k, 0) // task_bytes))) for k in range(BUCKETS)]), F.col("bucket"))
    left = links.select("bucket", F.pmod(F.xxhash64("chunk"), deals).alias("deal"), "chunk", "blob")
    right = counts.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), (deals - 1).cast("long"))).alias("deal"), "code", "documents", "best")

    def run(blobs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("code")
        codes, documents, best = (known[c].to_numpy() for c in ("code", "documents", "best"))
        out = []
        for chunk, blob in zip(blobs["chunk"], blobs["blob"]):
            found, places, times = unpack(blob)
            at = np.searchsorted(codes, found)
            weight = times * documents[at]
            order = np.argsort(places, kind="stable")
            first = np.flatnonzero(np.diff(places[order], prepend=-1))
            out.append(pd.DataFrame({"chunk": chunk, "place": places[order][first].astype(np.int64),
                                     "n_best": np.add.reduceat(np.where(best[at], times, 0)[order].astype(np.int64), first),
                                     "count_sum": np.add.reduceat(weight[order].astype(np.int64), first)}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("chunk", "place", "n_best", "count_sum")})

    found = left.groupBy("bucket", "deal").cogroup(right.groupBy("bucket", "deal")).applyInPandas(run, "chunk long, place long, n_best long, count_sum long")
    return found.groupBy("chunk", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, tokenizer: str, model: bytes, key: str = "doc_id", text: str = "text", keep_groups: bool = False,
                 chunk_links: int = CHUNK_LINKS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per document: ``key``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` and ``groups``.

    ``tokenizer`` is the JSON of side A (:func:`bpe.load`), which encodes a space and the text; ``model`` the bytes of side B.  A link is a
    pair of token occurrences whose byte ranges overlap; its count is the number of documents with its pair of ids linked; ``n_best`` are the links whose count is the
    highest of their A id, ties included.  ``groups`` (only with ``keep_groups``, else null) is ``a1,a2|b1;a3|b2``, ids in order.

    Texts that are null, empty or changed by a tokenizer have zeros and an empty digest.  Every row is a document of its own, repeated
    rows and rows of one or no key too; other columns are left out.
    """
    width = len(PieceTokens(model).bytes_of)
    rows = stored(_aligned_rows(docs, key, text, tokenizer, model, keep_groups, chunk_links), "aligned")
    links = rows.where(F.col("kind") == LINKS)
    counts = stored(_blob_counts(links), "pair-counts").withColumn("a", F.expr(f"code div {width}"))
    highest = counts.groupBy("a").agg(F.max("documents").alias("most"))
    judged = counts.join(highest, "a").select("code", "documents", (F.col("documents") == F.col("most")).alias("best"), "bucket")
    sums = _document_sums(links.select("bucket", "chunk", "blob"), judged, task_bytes)
    side = sums.select(F.col("chunk").alias("c"), F.col("place").alias("p"), "n_best", "count_sum")
    own = rows.where(F.col("kind") == DOCUMENT)
    return own.join(side, (F.col("chunk") == F.col("c")) & (F.col("place") == F.col("p")), "left").select(
        "key", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256", "groups")
