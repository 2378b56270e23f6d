"""Many rules by their required texts: the same failures as rule by rule."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from radloom.operators import screening as S
from radloom.operators.prefilter import required_texts

FOUND = {
    "^hello$": {"hello"}, "(abc|defg)x": {"abc", "defg"}, "ab?cde": {"cde"}, "[0-9]{3}": None, "foo.*barbaz": {"barbaz"}, "(?:foo|ba)": None, "(?:foo|bar)+": {"foo", "bar"},
    "abc+def": {"abc"}, r"ab\.cd": {"ab.cd"}, r"\bMRI\b scan": {"mri scan"}, "(?i)abc": None, "(?=abc)d": None, "[a]bc[.]d": {"abc.d"}, "a|b": None, "abc{0,2}": None,
    "foo(?!bar)baz": {"foobaz"}, r"\d+ years": {" years"}, r"\Qabc\E": None, "abc{2}def": {"abc"}, "": None, "ab[^]]cdef": {"cdef"}, "foo(bar)?": {"foo"}, "(abc": None,
    "a(b)*cde|xyz1": {"cde", "xyz1"}, "é-word": {"-word"}, "[a-c&&[b]]word": None, r"\p{Lu}word": None, "(?<n>abc)": None, r"(\w)abc\1": {"abc"}, "x*": None,
}


@pytest.mark.parametrize("pattern", FOUND)
def test_required_texts(pattern):
    assert required_texts(pattern) == (None if FOUND[pattern] is None else frozenset(FOUND[pattern]))


def test_no_match_without_a_required_text():
    rng = random.Random(4)
    atoms = ["a", "b", "abc", "cab", "[ab]", "(?:abc|bca)", "(ab)?", "b+", "c*", ".", r"\b", "(?:a|bcb){2}", "a{1,2}", "(?!x)"]
    for _ in range(4000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 5)))
        texts = required_texts(pattern)
        value = "".join(rng.choice("abcx") for _ in range(rng.randint(0, 9)))
        if texts is not None and re.search(pattern, value):
            assert any(t in value for t in texts), (pattern, value, texts)


def invented(n, seed=1):
    """Rules in the mixture that screening rule files have: phrases, alternatives, a few shapes, some bound to columns."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    rules = []
    for _ in range(n):
        shape = rng.random()
        pattern = (f"^{word()} {word()}$" if shape < 0.4 else rf"\b(?:{word()}|{word()})\b" if shape < 0.6 else f"{word()}[0-9]+" if shape < 0.8 else
                   f"({word()})? ?{word()[:3]}" if shape < 0.94 else rng.choice(["^[0-9]{8}$", r"^(\d+\.){3,}\d+$", "^[A-F]{4}$", None]))
        report = rng.random() < 0.4 and pattern is not None
        rules.append(S.ScreenRule("Report" if report else "Ignore", rng.choice([None, None, None, "a", "b"]) if pattern else "b", pattern,
                                  rng.choice(["Person", "Location"]) if report else None, rng.random() < 0.3))
    return rules + [S.ScreenRule("Report", pattern="[A-Z][a-z]+", classification="Person", case_sensitive=True), *S.default_rules()]


def values(rules, n, seed=2):
    rng = random.Random(seed)
    parts = [p for r in rules for p in re.findall("[a-j]{3,}", r.pattern or "")]
    piece = lambda: rng.choice([rng.choice(parts), rng.choice(parts).upper(), str(rng.randint(1, 10**8)), "Smith", "\\", " ", "ABCD", "1.2.3.4", "é", "\n", ""])
    return ["".join(piece() + rng.choice(["", " "]) for _ in range(rng.randint(0, 6))) for _ in range(n)] + [None, "", "ab"]


def screened(spark, rules):
    rows = [(str(i), c, v) for i, v in enumerate(values(rules, 300)) for c in ("a", "c")]
    cells = S.screen_cells(spark.createDataFrame(rows, "resource string, column string, value string"), rules)
    wide = spark.createDataFrame([(v, w) for v, w in zip(values(rules, 200), values(rules, 200, 5))], "a string, b string")
    flat = lambda parts: None if parts is None else [tuple(p) for p in parts]
    return ([(r.resource, r.column, flat(r.parts)) for r in cells.collect()],
            [[(f.column, f.value, flat(f.parts)) for f in r.failures] for r in S.screen_rows(wide, rules, ["a", "b"], skip=["none"]).collect()])


def test_same_failures_as_rule_by_rule(spark, monkeypatch):
    rules = invented(40)
    by_texts = screened(spark, rules)
    monkeypatch.setattr(S, "MANY_RULES", 10_000)
    assert by_texts == screened(spark, rules)
    assert sum(p is not None for _, _, p in by_texts[0]) > 30 and sum(p is None for _, _, p in by_texts[0]) > 30


def test_528_rules_over_30_columns_plan_fast(spark):
    rules = invented(525)
    columns = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([("x",) * 30], ", ".join(f"{c} string" for c in columns))
    S.screen_rows(df, rules[:30], columns).schema
    start = time.process_time(), time.time()
    S.screen_rows(df, rules, columns)._jdf.queryExecution().executedPlan()
    assert time.time() - start[1] < 20  # about 2 s on an idle machine


def test_long_texts(spark):
    rules = invented(30)
    text = " ".join(v for v in values(rules, 4000) if v)
    got = S.screen_cells(spark.createDataFrame([("1", "c", text)], "resource string, column string, value string"), rules).first()
    assert got.parts and all(text[p.Offset:p.Offset + len(p.Word)] == p.Word for p in got.parts)


def test_texts_that_start_or_overlap_others(spark, monkeypatch):
    """The longest text at a place names the rules of those it starts with, and none that overlaps it is passed over."""
    report = lambda pattern, name: S.ScreenRule("Report", pattern=pattern, classification=name)
    rules = [report("terms of$", "1"), report("[0-9]termsx", "2"), report("rms of use", "3"), report("terms? ", "4"), report("a[.]b@c", "5"), report("[x-z]@[x-z]", "6"), report("ab[.]", "7"),
             *[S.ScreenRule("Ignore", pattern=f"^filler {n} never$") for n in range(30)]]
    texts = ["TERMS OF", "the terms of use", "terms", "term ", "1termsx", "xterms of x", "A.B@C", "q y@y", "y@", "ab.", "AB.", "", None, "filler 3 never", "filler 3 never ab."]
    cells = spark.createDataFrame([(str(i), "c", t) for i, t in enumerate(texts)], "resource string, column string, value string")
    found = lambda: {r.resource: [tuple(p) for p in r.parts] for r in S.screen(cells, rules).collect()}
    by_texts = found()
    monkeypatch.setattr(S, "MANY_RULES", 10_000)
    assert by_texts == found() and [by_texts[i][0][0] for i in "0134"] == ["1", "3", "4", "2"]


def test_required_texts_below_three_characters():
    assert required_texts("[a-z]+@[a-z]+") is None and required_texts("[a-z]+@[a-z]+", 1) == {"@"} and required_texts("[a-z]+[0-9]?", 1) is None


def test_a_long_text_is_read_once_not_cut_into_characters(spark):
    plan = S.screen_cells(spark.createDataFrame([("1", "c", "x")], "resource string, column string, value string"), invented(40))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "split(lower(" not in plan
