"""Phrase collocations from weighted acyclic automata over words.

A task turns its documents into shards of bounded size.  A shard's word sequences, sorted, become count transducers:
acyclic automata whose path is a phrase and whose last arc carries its count.  States are frozen in sorted order from the
ends of the paths on, and one whose arcs are known already is used again, so equal continuations are stored once.
Every shard is cut at the same places of the sorted order; a cut may fall behind any prefix, so a frequent
word or word pair is spread like any other.  The transducers of one prefix range meet in one group, which walks them together level by
level, adds the weights of equal arcs, and does not enter states below a phrase that is already too rare (no extension is more frequent).
Prefixes that a cut runs through are partial on both sides and are added up afterwards.

The parts of the candidates are looked up by composition: per prefix range, an acceptor of the distinct parts
against the transducer of the frequent phrases.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from radloom.functions.joins import join_side
from radloom.llm.common import stored

UNKNOWN = "und"
#: Words in a shard, words behind a prefix range, the most ranges, documents sampled for the cuts, and starts taken of each.
SHARD_WORDS = 2_000_000
RANGE_WORDS = 1_500_000
MOST_RANGES = 16_384
SAMPLE_DOCUMENTS = 4_000
SAMPLE_STARTS = 250
#: Bytes of a text that are split at once.
SLICE_BYTES = 4_000_000
#: Rows of one language that a task ranks, in the first of two rounds.
RANK_DEALS = 64

# A-Z become a-z, a tab a space, and whatever ends a piece a full stop, which so is no part of a word.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
_GAP = re.compile(rb"[ .]")

Arc = np.dtype([("label", "<u4"), ("target", "<u4"), ("weight", "<u8")])


class Vocabulary(dict):
    """Numbers of words in the order they are met; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def starts(text: bytes, vocabulary: Vocabulary, longest: int) -> Iterator[np.ndarray]:
    """For every word of a text, it and the words behind it in its piece, ``longest`` in all; 0 where the piece ends."""
    data, at, carried = text.translate(_BYTES), 0, np.zeros(0, dtype=np.int64)
    while at < len(data):
        gap = _GAP.search(data, at + SLICE_BYTES)
        end = gap.start() + 1 if gap else len(data)
        words = data[at:end].replace(b".", b" . ").split()
        at = end
        ids = np.concatenate([carried, np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=len(words))])
        if at >= len(data):
            ids = np.concatenate([ids, np.zeros(longest - 1, dtype=np.int64)])
        n = len(ids) - longest + 1
        if n <= 0:
            carried = ids
            continue
        carried = ids[n:]
        out = np.zeros((n, longest), dtype=np.int32)
        out[:, 0] = ids[:n]
        for j in range(1, longest):
            out[:, j] = np.where(out[:, j - 1] == 0, 0, ids[j:n + j])
        yield out[out[:, 0] != 0]


def sorted_counts(rows: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers up to ``top`` in order, and how often each occurs."""
    bits = max(1, int(top).bit_length())
    if bits * rows.shape[1] <= 63:
        key = rows[:, 0].astype(np.int64)
        for j in range(1, rows.shape[1]):
            key = key << bits | rows[:, j]
        key, count = np.unique(key, return_counts=True)
        return np.stack([key >> bits * (rows.shape[1] - 1 - j) & (1 << bits) - 1 for j in range(rows.shape[1])], axis=1), count
    return np.unique(rows, axis=0, return_counts=True)


class CountTransducer:
    """``words`` in byte order and one table of arcs per level: ``first[level][s]`` is where the arcs of state ``s`` begin.

    Labels are places in ``words``; an arc's weight is the count of the phrase that ends with it; state 0 of a level
    has no arcs; the first level has its one state's arcs from 0 on.  ``weight`` is the count of the empty phrase.
    """

    def __init__(self, words: list[bytes], weight: int, first: list[np.ndarray], arcs: list[np.ndarray]):
        self.words, self.weight, self.first, self.arcs = words, weight, first, arcs

    @classmethod
    def from_sorted(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray, exact: bool = False) -> CountTransducer:
        """Of distinct rows in order; numbers are places in ``words`` plus 1, 0 behind the end.

        A prefix weighs what its rows weigh together, or with ``exact`` what its own row weighs, 0 if there is none.
        """
        used = np.unique(rows)
        used = used[used != 0]
        place = np.zeros(int(used.max(initial=0)) + 1, dtype=np.int64)
        place[used] = np.arange(len(used))
        longest, n = rows.shape[1], len(rows)
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        heads, weights = [np.zeros(1, dtype=np.int64)], []
        for j in range(longest):
            new[1:] |= rows[1:, j] != rows[:-1, j]
            heads.append(np.flatnonzero(new))
            if exact:
                weights.append(np.where((rows[heads[-1], j + 1:] == 0).all(axis=1), counts[heads[-1]], 0))
            else:
                weights.append(np.add.reduceat(counts, heads[-1]) if n else counts)
        first, arcs, target = [None] * longest, [None] * longest, None
        for j in range(longest - 1, -1, -1):
            at = heads[j + 1]
            real = rows[at, j] != 0
            level = np.zeros(int(real.sum()), dtype=Arc)
            level["label"], level["weight"] = place[rows[at[real], j]], weights[j][real]
            if target is not None:
                level["target"] = target[real]
            parents = np.searchsorted(heads[j], at[real], side="right") - 1
            bounds = np.searchsorted(parents, np.arange(len(heads[j]) + 1))
            if j == 0:
                first[0], arcs[0] = np.array([0, len(level)]), level
                break
            # A finished state is looked up by its arcs; only unknown ones are kept.
            known, kept, target = {}, [], np.zeros(len(heads[j]), dtype=np.uint32)
            frozen, width, limits = level.tobytes(), Arc.itemsize, bounds.tolist()
            for parent in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = limits[parent], limits[parent + 1]
                signature = frozen[lo * width:hi * width]
                state = known.get(signature)
                if state is None:
                    state = known[signature] = len(known) + 1
                    kept.append(parent)
                target[parent] = state
            sizes = np.diff(bounds)[kept]
            first[j] = np.concatenate([[0, 0], np.cumsum(sizes)]).astype(np.int64)
            begin = np.repeat(bounds[kept] - first[j][1:-1], sizes)
            arcs[j] = level[begin + np.arange(len(begin))]
        return cls([words[i - 1] for i in used.tolist()], int(counts.sum()), first, arcs)

    @classmethod
    def of_phrases(cls, phrases: list[str], counts: np.ndarray, longest: int) -> CountTransducer:
        """Of distinct space-joined phrases with their own counts."""
        split = [p.encode().split(b" ") for p in phrases]
        words = sorted({w for p in split for w in p})
        place = {w: i for i, w in enumerate(words, 1)}
        rows = np.array([[place[w] for w in p] + [0] * (longest - len(p)) for p in split], dtype=np.int64).reshape(-1, longest)
        order = np.lexsort(rows.T[::-1])
        return cls.from_sorted(words, rows[order], np.asarray(counts, dtype=np.int64)[order], exact=True)

    def below(self, level: int, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of ``states`` at a level, one state after the other, and which of the states each comes from."""
        begin, size = self.first[level][states], self.first[level][states + 1] - self.first[level][states]
        owner = np.repeat(np.arange(len(states)), size)
        return self.arcs[level][np.arange(len(owner)) + np.repeat(begin - np.cumsum(size) + size, size)], owner

    def to_bytes(self) -> bytes:
        words = b" ".join(self.words)
        parts = [np.array([len(words), self.weight, len(self.arcs)], dtype="<u8").tobytes(), words]
        for first, arcs in zip(self.first, self.arcs):
            parts.append(np.array([len(first), len(arcs)], dtype="<u8").tobytes())
            parts.append(np.diff(first, prepend=0).astype("<u4").tobytes())
            parts += [np.ascontiguousarray(arcs[name]).view("u1").reshape(len(arcs), Arc[name].itemsize).T.tobytes() for name in Arc.names]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountTransducer:
        data, at = zstandard.ZstdDecompressor().decompress(blob), 24
        size, weight, levels = np.frombuffer(data, "<u8", 3).tolist()
        words = data[at:at + size].split(b" ") if size else []
        at += size
        first, arcs = [], []
        for _ in range(levels):
            n, m = np.frombuffer(data, "<u8", 2, at).tolist()
            first.append(np.cumsum(np.frombuffer(data, "<u4", n, at + 16).astype(np.int64)))
            at += 16 + 4 * n
            level = np.zeros(m, dtype=Arc)
            for name in Arc.names:
                width = Arc[name].itemsize
                level[name] = np.ascontiguousarray(np.frombuffer(data, "u1", width * m, at).reshape(width, m).T).view(Arc[name]).ravel()
                at += width * m
            arcs.append(level)
        return cls(words, weight, first, arcs)


def union(parts: list[CountTransducer], least: int, edges: list[list[bytes]]) -> Iterator[tuple[int, list[bytes], int]]:
    """Phrases of the summed transducers: their number of words, themselves, their counts.

    Given are those of at least ``least`` and, whatever their count, the prefixes of ``edges``, which a cut runs through.
    """
    words = sorted(set().union(*[p.words for p in parts]))
    place = {w: i for i, w in enumerate(words)}
    moved = [np.array([place[w] for w in p.words], dtype=np.int64) for p in parts]
    yield 0, [], sum(p.weight for p in parts)
    chains = [[place.get(w, -1) for w in edge] for edge in edges]
    nodes, open_nodes = [[]], [0] * len(chains)
    fronts = [(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)) for _ in parts]  # states of the next level, their nodes
    for level in range(max((len(p.arcs) for p in parts), default=0)):
        keys, weights, targets, owners = [], [], [], []
        for n, (part, (states, at)) in enumerate(zip(parts, fronts)):
            arcs, owner = part.below(level, states)
            keys.append(at[owner] * len(words) + moved[n][arcs["label"]] if len(arcs) else np.zeros(0, dtype=np.int64))
            weights.append(arcs["weight"].astype(np.int64))
            targets.append(arcs["target"].astype(np.int64))
            owners.append(np.full(len(arcs), n))
        key = np.concatenate(keys)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.diff(key[order], prepend=-1))
        total, merged = np.add.reduceat(np.concatenate(weights)[order], head), key[order][head]
        keep = total >= least
        for c, chain in enumerate(chains):
            if open_nodes[c] >= 0:
                open_nodes[c] = -1 if level + 1 >= len(chain) or chain[level] < 0 else _place(merged, open_nodes[c] * len(words) + chain[level])
                if open_nodes[c] >= 0:
                    keep[open_nodes[c]] = True
        renumbered = np.cumsum(keep) - 1
        nodes = [nodes[m // len(words)] + [words[m % len(words)]] for m in merged[keep].tolist()]
        open_nodes = [int(renumbered[c]) if c >= 0 else -1 for c in open_nodes]
        for phrase, count in zip(nodes, total[keep].tolist()):
            yield level + 1, phrase, count
        of = np.empty(len(key), dtype=np.int64)
        of[order] = np.repeat(np.where(keep, renumbered, -1), np.diff(np.append(head, len(key))))
        target, owner = np.concatenate(targets), np.concatenate(owners)
        alive = (of >= 0) & (target > 0)
        fronts = [(target[here], of[here]) for here in (alive & (owner == n) for n in range(len(parts)))]


def _place(merged: np.ndarray, key: int) -> int:
    """Place of a key in rising keys, or -1."""
    at = int(np.searchsorted(merged, key))
    return at if at < len(merged) and merged[at] == key else -1


def compose(acceptor: CountTransducer, counts: CountTransducer) -> Iterator[tuple[list[bytes], int]]:
    """Every phrase of a weight in ``acceptor`` that ``counts`` has, with its count; both are walked at once, by equal labels."""
    place = {w: i for i, w in enumerate(counts.words)}
    moved = np.array([place.get(w, -1) for w in acceptor.words], dtype=np.int64)
    states, other, phrases = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), [[]]
    for level in range(len(acceptor.arcs)):
        arcs, owner = acceptor.below(level, states)
        theirs, their_owner = counts.below(level, other)
        if not len(arcs) or not len(theirs):
            return
        width = len(counts.words)
        key, label = their_owner * width + theirs["label"], moved[arcs["label"]]
        at = np.minimum(np.searchsorted(key, owner * width + label), len(key) - 1)
        met = (label >= 0) & (key[at] == owner * width + label)
        arcs, owner, at = arcs[met], owner[met], at[met]
        phrases = [phrases[o] + [acceptor.words[a]] for o, a in zip(owner.tolist(), arcs["label"].tolist())]
        yield from ((p, c) for p, c, accepted in zip(phrases, theirs["weight"][at].tolist(), arcs["weight"].tolist()) if accepted and c)
        states, other = arcs["target"].astype(np.int64), theirs["target"][at].astype(np.int64)


class _Shard:
    """Starts of one task until they are written."""

    def __init__(self):
        self.vocabulary, self.rows, self.size = Vocabulary(), {}, 0

    def add(self, lang: str, text: bytes, longest: int) -> None:
        for found in starts(text, self.vocabulary, longest):
            self.rows.setdefault(lang, []).append(found)
            self.size += len(found)

    def transducers(self, cuts: list[tuple]) -> Iterator[tuple[int, str, bytes]]:
        """Range, language and transducer of every range that the shard reaches."""
        words = sorted(self.vocabulary.keys() - {b"."})
        rank = np.zeros(len(self.vocabulary), dtype=np.int32)
        rank[[self.vocabulary[w] for w in words]] = np.arange(1, len(words) + 1)
        for lang, chunks in sorted(self.rows.items()):
            rows, counts = sorted_counts(rank[np.concatenate(chunks)], len(words))
            name = lang.encode()
            low, high = bisect_right(cuts, (name,)), bisect_left(cuts, (name + b"\0",))
            at = [0, *[self._before(rows, cut[1:], words) for cut in cuts[low:high]], len(rows)]
            for k, (lo, hi) in enumerate(zip(at, at[1:])):
                if lo < hi:
                    yield low + k, lang, CountTransducer.from_sorted(words, rows[lo:hi], counts[lo:hi]).to_bytes()

    @staticmethod
    def _before(rows: np.ndarray, cut: tuple, words: list[bytes]) -> int:
        """How many rows come before a cut."""
        lo, hi = 0, len(rows)
        for j, word in enumerate(cut):
            k = bisect_left(words, word)
            present = k < len(words) and words[k] == word
            column = rows[lo:hi, j]
            lo, hi = lo + int(np.searchsorted(column, k + 1)), lo + int(np.searchsorted(column, k + 1, side="right")) if present else lo
            if not present:
                break
        return lo


def _text_and_lang(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text")).where(
        F.octet_length("text") > 0)


def choose_cuts(rows: DataFrame, longest: int, range_words: int = RANGE_WORDS) -> list[tuple]:
    """Places (language, word, word, ...) that cut the sorted phrases into ranges of about equal weight, from a bounded sample of documents.

    They decide where phrases are counted, not what is counted.
    """
    documents = rows.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                vocabulary = Vocabulary()
                found = list(starts(text.as_py(), vocabulary, longest))
                found = np.concatenate(found) if found else np.zeros((0, longest), dtype=np.int32)
                if not len(found):
                    continue
                names = list(vocabulary)
                picked = found[np.linspace(0, len(found) - 1, min(SAMPLE_STARTS, -(-len(found) // 32))).astype(int)]
                phrases = [[names[i] for i in row if i] for row in picked.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases)), pa.array(phrases, pa.list_(pa.binary())),
                                                  pa.array([len(found) / len(phrases)] * len(phrases))], names=["lang", "phrase", "weight"])

    sample = rows.where(F.rand(11) < share).mapInArrow(run, "lang string, phrase array<binary>, weight double").collect()
    points = sorted(((r.lang.encode(), *map(bytes, r.phrase)), r.weight / share) for r in sample)
    upto = np.cumsum([w for _, w in points]) if points else np.zeros(1)
    ranges = int(min(MOST_RANGES, max(1, -(-upto[-1] // range_words))))
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({points[i][0] for i in at.tolist()})


def frequent_phrases(df: DataFrame, cuts: list[tuple], least: int, longest: int, text: str = "text", lang: str = "lang",
                     shard_words: int = SHARD_WORDS) -> DataFrame:
    """``lang``, ``words``, ``phrase`` (space-joined) and ``count`` of every phrase met ``least`` times, and of the empty phrase (all words)."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def written(shard: _Shard) -> Iterator[pa.RecordBatch]:
            for k, name, blob in shard.transducers(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name]), pa.array([blob], pa.binary())], names=["range", "lang", "blob"])

        shard = _Shard()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(name, body.as_py(), longest)
                if shard.size >= shard_words:
                    yield from written(shard)
                    shard = _Shard()
        yield from written(shard)

    def merged(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        number, name = int(key[0]), key[1]
        bounds = [shared.value[k] for k in (number - 1, number) if 0 <= k < len(shared.value)]
        edges = [list(cut[1:]) for cut in bounds if cut[0] == name.encode()]
        found = list(union([CountTransducer.from_bytes(b) for b in blobs["blob"]], least, edges))
        return pd.DataFrame({"lang": name, "words": [n for n, _, _ in found],
                             "phrase": [b" ".join(p).decode("utf-8", "replace") for _, p, _ in found], "count": [c for _, _, c in found]})

    parts = _text_and_lang(df, text, lang).mapInArrow(shards, "range int, lang string, blob binary")
    summed = parts.groupBy("range", "lang").applyInPandas(merged, "lang string, words int, phrase string, count long")
    return summed.groupBy("lang", "words", "phrase").agg(F.sum("count").alias("count")).where((F.col("count") >= least) | (F.col("words") == 0))


def _range_of(cuts: list[tuple]) -> Column:
    @F.pandas_udf("int")
    def run(lang: pd.Series, phrase: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, (a.encode(), *b.encode().split(b" "))) for a, b in zip(lang, phrase)], dtype="int32")

    return run(F.col("lang"), F.col("phrase"))


def look_up(parts: DataFrame, frequent: DataFrame, cuts: list[tuple], longest: int) -> DataFrame:
    """``lang``, ``phrase`` and ``count`` of the distinct ``parts`` (lang, phrase), composed per prefix range with the frequent phrases."""
    def run(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, here in asked.groupby("lang"):
            there = known[known["lang"] == name]
            acceptor = CountTransducer.of_phrases(here["phrase"].tolist(), np.ones(len(here)), longest)
            counts = CountTransducer.of_phrases(there["phrase"].tolist(), there["count"].to_numpy(), longest)
            out += [(name, b" ".join(p).decode(), c) for p, c in compose(acceptor, counts)]
        return pd.DataFrame(out, columns=["lang", "phrase", "count"])

    ranged = lambda df, *more: df.select("lang", "phrase", *more, _range_of(cuts).alias("range"))
    return ranged(parts).groupBy("range").cogroup(ranged(frequent.where(F.col("words").between(1, longest - 1)), "count").groupBy("range")).applyInPandas(
        run, "lang string, phrase string, count long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, covered: float = 0.5, first: int = 2000,
                 shard_words: int = SHARD_WORDS, range_words: int = RANGE_WORDS) -> DataFrame:
    """The ``first`` collocations of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased, texts end pieces at ``.,;:!?`` and line ends, words at spaces and tabs.  Candidates are phrases of 2 to ``longest`` words met at
    least ``least`` times.  The cut into two parts, met ``l`` and ``r`` times, of the lowest score ``floor(1000000 a a / (l r))`` counts, the earliest of
    equal ones.  A candidate inside a longer one met at least ``covered`` times as often is left out.  Order: score and ``a`` descending, phrase in byte order.

    Whole texts are counted, every row once, repeated ones too; null and empty texts have no words; a null language is ``und``.  Other columns are left out;
    without rows the result is empty.  Products are decimals of 38 digits, exact up to counts of 10^15.
    """
    rows = _text_and_lang(df, text, lang)
    cuts = choose_cuts(rows, longest, range_words)
    frequent = stored(frequent_phrases(rows, cuts, least, longest, shard_words=shard_words), "phrases")
    candidates = frequent.where("words > 1").select("lang", "phrase", "words", F.split("phrase", " ").alias("parts"), F.col("count").alias("a"))
    joined = lambda start, length: F.array_join(F.slice("parts", start, length), " ")
    cut = candidates.select("lang", "phrase", "parts", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    asked = cut.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct()
    found = stored(look_up(asked, frequent, cuts, longest), "part-counts")
    part = lambda side, name: join_side(found.select(F.col("lang").alias(f"{side}_lang"), F.col("phrase").alias(f"{side}_part"), F.col("count").alias(name)),
                                        f"{side}_lang", f"{side}_part")
    counted = (cut.join(part("left", "l"), (F.col("lang") == F.col("left_lang")) & (F.col("left") == F.col("left_part")))
               .join(part("right", "r"), (F.col("lang") == F.col("right_lang")) & (F.col("right") == F.col("right_part"))))
    score = F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = counted.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # Contiguous inner phrases of at least two words, each with the count of the most frequent candidate around it.
    inner = candidates.where("words > 2").select("lang", "parts", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")).select(
        "lang", "parts", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    around = inner.groupBy(F.col("lang").alias("in_lang"), joined(F.col("at"), F.col("size")).alias("in_phrase")).agg(F.max("a").alias("longer"))
    kept = (scored.join(around, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("in_phrase")), "left")
            .where(F.col("longer").isNull() | (F.col("longer") < F.lit(covered) * F.col("a"))))
    rows_of = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(RANK_DEALS))
    few = rows_of.withColumn("place", F.row_number().over(Window.partitionBy("lang", deal).orderBy(*order))).where(F.col("place") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = frequent.where("words = 0").select(F.col("lang").alias("of"), F.col("count").alias("n"))
    return ranked.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
