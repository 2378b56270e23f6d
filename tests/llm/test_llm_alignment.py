"""Cross-tokenizer alignment against brute force over byte ranges."""

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from radloom.llm import alignment, bpe, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello world, hello again.", "Hello world, hello again.", None, "", " ", "a▁b", "x<|endoftext|>y </s> <0x41>", "日本語のテキスト 混ぜる", "é ﬁ 𝕏 \x00",
         "tab\tand  spaces \r\n end ", "antidisestablishmentarianism " * 40, "w" * 3000, "1234567890 3.14159", "Hello world"]
SCHEMA = "doc_id long, text string, kind string, chunk string, place string, n_a string"
ROWS = [(i, t, "k", "c", "p", "n") for i, t in enumerate(TEXTS)] + [(None, "Hello world", "", "", "", ""), (0, TEXTS[0], "", "", "", "")]


def ranges(pieces):
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return list(zip([0, *ends], ends))


class Plain:
    @classmethod
    @functools.cache
    def shared(cls):
        return cls()

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
        self.a.encode_special_tokens = True
        self.byte = bpe.byte_of_char()

    def tokens(self, text):
        if not text:
            return [], []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        full = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == full == b"".join(x for _, x in b) else ([], [])

    def document(self, text):
        a, b = self.tokens(text)
        ra, rb = ranges([x for _, x in a]), ranges([x for _, x in b])
        links = [(a[i][0], b[j][0]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if max(s, u) < min(e, v)]
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(t[0]) for t, (s, e) in zip(side, rs) if lo <= s and e <= hi) for side, rs in ((a, ra), (b, rb))))
        return len(a), len(b), len(cuts), links, ";".join(groups)


def expected(rows):
    plain = Plain()
    found = [(key, *plain.document(text)) for key, text, *_ in rows]
    count = Counter(p for _, _, _, _, links, _ in found for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return sorted(((key, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if na else "") for key, na, nb, ng, links, g in found), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_query_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(queries.tokenizer_alignment(df)) == expected(ROWS)
    assert queries.tokenizer_alignment(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_chunks_and_deals_change_nothing(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("n_chars < 1500")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 50
    with open(PIECES, "rb") as file:
        model = file.read()
    out = alignment.align_corpus(docs, bpe.load(BYTES), model, keep_groups=True, chunk_links=300, task_bytes=500).cache()
    assert got(out.withColumnRenamed("key", "doc_id")) == expected(rows)
    for r in out.where("n_a > 0").limit(20).collect():
        assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256
    out.unpersist()


@given(st.lists(st.tuples(st.integers(1, 4), st.booleans(), st.booleans()), max_size=60), st.integers(0, 40))
@settings(max_examples=500, deadline=None)
def test_stretches_are_the_groups(cuts, stretch):
    at, a, b = 0, [], []
    for width, in_a, in_b in cuts:
        at += width
        a += [at] if in_a else []
        b += [at] if in_b else []
    for _ in range(stretch):
        at += 1
        a.append(at)
        b.append(at)
    at += 1
    a.append(at)
    b.append(at)
    common = sorted(set(a) & set(b))
    want = [(sum(x <= lo for x in a), sum(x <= hi for x in a), sum(x <= lo for x in b), sum(x <= hi for x in b)) for lo, hi in zip([0, *common], common)]
    found, links_a, links_b = alignment.align(a, b)
    i = j = 0
    flat, overlap = [], []
    spans = [list(zip([0, *ends], ends)) for ends in (a, b)]
    for first, count, shift in zip(found[::3], found[1::3], found[2::3]):
        for last in range(first, first + abs(count)):
            flat.append((i, last + 1, j, last + shift + 1))
            assert (count > 0) == (flat[-1][1] - i == 1 == flat[-1][3] - j)
            if count < 0:
                overlap += [(x, y) for x in range(i, last + 1) for y in range(j, last + shift + 1) if max(spans[0][x][0], spans[1][y][0]) < min(spans[0][x][1], spans[1][y][1])]
            i, j = flat[-1][1], flat[-1][3]
    assert list(zip(links_a, links_b)) == overlap
    assert flat == want


@pytest.fixture(scope="module")
def aligner():
    with open(PIECES, "rb") as file:
        return alignment.Aligner(bpe.load(BYTES), file.read())


@given(st.lists(st.sampled_from([" ", "  ", "\t", "\n", "\r", ";\r\n", "a", "Word", "'s", "é", "e\u0301", "日本", "\u00a0", "\u3000", "\x1c", "▁", "<0x0A>", "<|endoftext|>", "12", "{", "zz"]),
                max_size=25).map("".join), st.text(max_size=20))
@settings(max_examples=400, deadline=None)
def test_stretches_encode_like_whole_texts(aligner, text, other):
    plain = Plain.shared()
    for t in (text, other, text + " " + other):
        got = aligner.align_all([t])[0]
        n_a, n_b, n_groups, links, groups = plain.document(t)
        assert (got.n_a, got.n_b, got.n_groups, got.groups) == (n_a, n_b, n_groups, groups)
        assert Counter(got.links.tolist()) == Counter(a * aligner.width + b for a, b in links)


def test_a_small_table_changes_nothing(aligner, monkeypatch):
    texts = [f"{'word ' * (i % 5)}number {i} and {i % 3} again, {'é' * (i % 4)} [{i}]" for i in range(300)]
    want = [(x.n_a, x.n_b, x.n_groups, x.groups) for x in aligner.align_all(texts)]
    for stretches, chars in ((20, 10**6), (10**6, 50)):
        monkeypatch.setattr(alignment, "TABLE_STRETCHES", stretches)
        monkeypatch.setattr(alignment, "TABLE_CHARS", chars)
        got = [(x.n_a, x.n_b, x.n_groups, x.groups) for i in range(0, 300, 7) for x in aligner.align_all(texts[i:i + 7])]
        assert got == want and len(aligner.places) < 200


def test_side_a_gives_texts_back(aligner):
    texts = ["é ﬁ \x00 𝕏 <|endoftext|> ", "\ud7ff日本", "a\tb\r\n\x7f"]
    want = [(x.n_a, x.groups) for x in aligner.align_all(texts)]
    assert aligner.a.lossless
    fresh = alignment.Aligner(bpe.load(BYTES), aligner.b.model.serialized_model_proto())
    fresh.a.lossless = False
    assert [(x.n_a, x.groups) for x in fresh.align_all(texts)] == want


def test_blobs_come_back():
    rng = np.random.default_rng(3)
    codes = np.sort(rng.integers(0, 2 ** 40, 500))
    places, times = rng.integers(0, 1000, 500), rng.integers(1, 90, 500)
    for n in (500, 1, 0):
        assert all((x == y[:n]).all() and len(x) == n for x, y in zip(alignment.unpack(alignment.pack(codes[:n], places[:n], times[:n])), (codes, places, times)))
