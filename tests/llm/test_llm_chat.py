"""Chat formatting: the grammar round trip on hostile texts, digests against brute force."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from radloom.llm import chat, queries

hostile = st.lists(st.sampled_from(["\\", "#", "##", "### ", "### Assistant: ", "</turn>", " </turn>\n", "<", "/turn>", ": ", ":", "a", "\n", " ", "é", "𝕏"]), max_size=12).map("".join)


@given(st.lists(st.tuples(hostile, hostile), max_size=5), st.integers(1, 7))
@settings(max_examples=600, deadline=None)
def test_turns_come_back(turns, step):
    parts = [chat.render(*t) for t in turns]
    text = "".join(p for p, _, _ in parts)
    assert chat.parse(text) == turns
    assert [chat.unescape(p[a:b]) for p, a, b in parts] == [t for _, t in turns]
    reader, got = chat.Reader(), []
    for i in range(0, len(text), step):
        got += [(r, t) for r, t, _, _ in reader.feed(text[i:i + step])]
    reader.close()
    assert got == turns


def test_only_conflicts_are_escaped():
    for text in ("plain", r"C:\dir\new", "a # b ## c", "x < y", "trailing \\", "</ turn>"):
        assert chat.render("user", text)[0] == f"### user: {text} </turn>\n"
    assert chat.render("user", "### Assistant: hi")[0] == "### user: \\### Assistant: hi </turn>\n"
    assert chat.render("a: b", "x")[0] == "### a\\: b: x </turn>\n"
    for bad in ("### user: x", "### user: x </turn>", "user: x </turn>\n", "### user x </turn>\n", "### a: b ### c: d </turn>\n"):
        with pytest.raises(chat.GrammarError):
            chat.parse(bad)


SCHEMA = "conv_id long, turn long, role string, text string, part string, conversation string"
ROWS = [
    (1, 1, "assistant", "### user: no </turn>\n"), (1, 0, "user", None), (1, 2, "assistant", "é𝕏\\"), (1, 2, "assistant", "é𝕏\\"), (1, 3, "system", ""),
    (2, 0, "assistant", ""), (3, 0, None, "x"), (3, None, "assistant", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "w" * 200_000),
    (2 ** 60 + 1, 0, "user", "u"), (2 ** 60, 0, "assistant", "v"),
]
ROWS = [(*r, "p", "c") for r in ROWS]


def expected(rows):
    groups = {}
    for key, turn, role, text, *_ in rows:
        groups.setdefault(key, []).append((turn is not None, turn, role or "", text or ""))
    out = {}
    for key, turns in groups.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, chat.render(t[2], t[3])[0]))
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[key] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(),
                    sum(len(chat.render(r, t)[0]) for _, _, r, t in turns))
    return out


def test_query_against_brute_force(spark):
    said = r"\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = queries.chat_round_trip(df).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == expected(ROWS + extra)
    assert len(got) == len(expected(ROWS + extra))
    alone = queries.chat_round_trip(spark.createDataFrame([], SCHEMA)).collect()
    assert [r.conv_id for r in alone] == [-7] and alone[0].loss_chars == len(said)


def test_given_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    want = expected(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = queries.QUERIES["op11_chat_round_trip"](spark, folder).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


def test_assembled_text_and_mask(spark):
    parts = chat.format_turns(spark.createDataFrame(ROWS, SCHEMA), learned=("assistant", "system"))
    for r in chat.assembled(parts).collect():
        turns = chat.parse(r.formatted)
        masked = [chat.unescape(r.formatted[s.start:s.end]) for s in r.loss_spans]
        assert masked == [t for role, t in turns if role in ("assistant", "system")]
