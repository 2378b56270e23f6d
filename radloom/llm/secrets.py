"""Secret scans: fixed credential patterns, and high-entropy strings by a sliding window.

Everything is built-in functions.  A pattern's matches come from
``regexp_extract_all``; the text between them from ``split`` by the same
pattern, and running lengths of the two give the places in code points.

Entropy: candidate strings are maximal runs of ``[A-Za-z0-9+/_=-]``.  Each run
is put into a character class (hex digits, letters and digits, the full set).
A window moves over the run one character at a time; the counts of its
characters and ``S = sum(c * log2 c)`` are updated for the one that enters and
the one that leaves, and the window's Shannon entropy is ``log2 w - S / w``.  A
run whose best window reaches the threshold of its class is reported, unless
the allow list matches it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.llm.common import bind, packed

# The patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA)([A-Z0-9]{16,})"
HEX = r"()([0-9a-f]{24,})"
KINDS = ("assign", "access", "hex", "entropy")

_RUN = "A-Za-z0-9+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


@dataclass(frozen=True)
class EntropyRule:
    """Window length and, by class, the entropy in bits that a window must reach.

    A run of letters only is a word in most languages, hence not a candidate:
    a candidate needs a digit and a letter.  Runs that ``allow`` matches as a
    whole are never reported.
    """

    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.7
    full_bits: float = 3.9
    allow: tuple[str, ...] = (
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
        r"[0-9_=+/-]+",                                           # numbers, dates, rules
        r"([A-Za-z]+[/_=-])+[A-Za-z]+[0-9]{0,4}",                # paths and identifiers made of words
        r"([a-z]+[0-9]{1,2}|[A-Z][a-z]+[0-9]{1,2})",              # a word with a number
    )



def _running(lengths: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array, block by block, so that no long array is copied at each step."""
    def sums(values: Column, start: Column) -> Column:
        grown = F.aggregate(values, F.array(start), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        return F.slice(grown, F.lit(2), F.size(values))

    def by_block(all_lengths: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / block).cast("int")),
                             lambda b: F.slice(all_lengths, b * block + 1, F.lit(block)))
        return bind(blocks, lambda parts: bind(
            sums(F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)), F.lit(0)),
            lambda ends: F.flatten(F.zip_with(parts, ends, lambda x, end: sums(
                x, end - F.aggregate(x, F.lit(0), lambda a, b: a + b))))))

    return bind(lengths, by_block)


def _matches(text: Column, pattern: str) -> Column:
    """The matches of a pattern, leftmost first: start, end, the text and its second group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = bind(found, lambda m: bind(
        _running(F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, gap: F.length(x) + F.length(gap))),
        lambda ends: F.arrays_zip(m.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"), ends.alias("end"))))
    empty = F.expr("cast(array() as array<struct<hit:string,value:string,end:int>>)")
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def _spans(matches: Column, kind: str, keep) -> Column:
    return F.transform(F.filter(matches, keep), lambda m: F.struct(
        (m["end"] - F.length(m["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end")))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_entropy(run: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits, of ``window`` consecutive characters of ``run`` (at least that long)."""
    def step(codes: Column):
        def update(state: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > window, F.get(codes, i - window - 1)).otherwise(F.lit(0))
            leaving = F.when(old > 0, F.get(state["counts"], old - 1)).otherwise(F.lit(0))
            entering = F.get(state["counts"], new - 1) - F.when(new == old, F.lit(1)).otherwise(F.lit(0))
            total = state["total"] - _weight(leaving) + _weight(leaving - 1) - _weight(entering) + _weight(entering + 1)
            counts = F.transform(state["counts"], lambda c, k: c + (k == new - 1).cast("int") - (k == old - 1).cast("int"))
            return F.struct(counts.alias("counts"), total.alias("total"), F.when(
                i >= window, F.greatest(state["best"], F.log2(F.lit(float(window))) - total / window)).otherwise(state["best"]).alias("best"))
        return update

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return bind(codes, lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x)), start, step(x))["best"])


def _is_secret(rule: EntropyRule):
    def test(match: Column) -> Column:
        run = match["hit"]
        bar = (F.when(run.rlike("^[0-9a-fA-F]+$"), F.lit(rule.hex_bits))
               .when(run.rlike("^[A-Za-z0-9]+$"), F.lit(rule.alnum_bits)).otherwise(F.lit(rule.full_bits)))
        allowed = F.lit(False)
        for pattern in rule.allow:
            allowed = allowed | run.rlike(f"^(?:{pattern})$")
        # A rounding error in the running sum must not decide.
        return F.when(allowed, F.lit(False)).otherwise(best_entropy(run, rule.window) >= bar - 1e-9)
    return test


def find_secrets(df: DataFrame, text: str = "text", rule: EntropyRule | None = None) -> DataFrame:
    """``row`` (the input row) and ``spans``: structs of start, order (place in ``KINDS``) and end, sorted.

    Places are code points, ends exclusive.  Whole texts are scanned; a null text
    is an empty one and has no spans.  Rows are independent: repeated rows give
    repeated results, an empty table an empty one, and other columns are only
    carried along inside ``row``.  Assignments are searched without a length and
    dropped when the value has fewer than 6 characters, since a dropped match
    still covers its characters; for the other two patterns a run is either long
    enough as a whole or not at all.
    """
    rule = rule or EntropyRule()
    body = F.coalesce(F.col("row")[text], F.lit(""))
    run = f"()(?<![{_RUN}])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])([{_RUN}]{{{rule.window},}})"
    spans = F.concat(
        _spans(_matches(body, ASSIGN), "assign", lambda m: F.length(m["value"]) >= 6),
        _spans(_matches(body, ACCESS), "access", lambda m: F.lit(True)),
        _spans(_matches(body, HEX), "hex", lambda m: F.lit(True)),
        _spans(_matches(body, run), "entropy", _is_secret(rule)))
    return packed(df).select("row", F.array_sort(spans).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")
