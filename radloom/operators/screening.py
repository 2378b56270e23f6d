"""Personal data in text cells: rule screening, allow lists, verdicts, reports.

Cells are rows ``(resource, column, value)``.  Rules compile to expressions, so
screening is one pass over the cells without a join or a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Protocol

import yaml
from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import unique_side
from radloom.operators.prefilter import Decider, by_number

# --- fixed values: built-in detectors -----------------------------------------
CHI = r"\b[0-3][0-9][0-1][0-9][0-9]{6}\b"
POSTCODE = r"\b[A-Z]{1,2}[0-9][0-9A-Z]? ?[0-9][A-Z]{2}\b"

PART = "array<struct<Classification:string,Offset:int,Word:string>>"
_OPEN, _CLOSE = "\u0001", "\u0002"


@dataclass(frozen=True)
class ScreenRule:
    action: str
    column: str | None = None
    pattern: str | None = None
    classification: str | None = None
    case_sensitive: bool = False

    @property
    def regex(self) -> str | None:
        return None if self.pattern is None else self.pattern if self.case_sensitive else f"(?i){self.pattern}"


@dataclass(frozen=True)
class AllowRule:
    part_pattern: str | None = None
    pattern: str | None = None
    column: str | None = None
    classification: str | None = None
    case_sensitive: bool = False


def load_rules(text: str) -> list[ScreenRule]:
    """``BasicRules``: ordered, each ``Action`` with its conditions."""
    listed = (yaml.safe_load(text) or {}).get("BasicRules") or []
    return [ScreenRule(r["Action"], r.get("IfColumn"), r.get("IfPattern"), r.get("As"), bool(r.get("CaseSensitive")))
            for r in listed]


def load_allow_rules(text: str) -> list[AllowRule]:
    listed = (yaml.safe_load(text) or {}).get("WhiteListRules") or []
    return [AllowRule(r.get("IfPartPattern"), r.get("IfPattern"), r.get("IfColumn"), r.get("As"),
                      bool(r.get("CaseSensitive"))) for r in listed]


def default_rules(ignore_postcodes: bool = False) -> list[ScreenRule]:
    rules = [ScreenRule("Report", pattern=CHI, classification="PrivateIdentifier", case_sensitive=True)]
    if not ignore_postcodes:
        rules.append(ScreenRule("Report", pattern=POSTCODE, classification="Postcode"))
    return rules


def to_cells(df: DataFrame, resource: str, columns: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Text columns of a table as cells; null cells are left out."""
    skipped = {s.lower() for s in skip or []}
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name != resource]
    used = [c for c in (columns or text) if c.lower() not in skipped]
    return (df.unpivot([resource], used, "column", "value").withColumnRenamed(resource, "resource")
            .where(F.col("value").isNotNull()))


def find_chi(df: DataFrame) -> DataFrame:
    """Add ``problem`` naming the first text column that holds a CHI number."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    found = [F.when(F.col(c).rlike(CHI), F.lit(f"Found chi in field {c}")) for c in text]
    return df.withColumn("problem", F.coalesce(*found) if found else F.lit(None).cast("string"))


def _joinable(pattern: str) -> bool:
    """Whether a pattern means the same as one alternative of several.

    Capturing groups shift the numbers that back-references name, names may
    repeat, and inline flags or an open quotation would reach into the next alternative.
    """
    return not re.search(r"\\[1-9kQE]|\(\?(?![:=!>]|<[=!])|\((?!\?)", pattern)


def _either(patterns: list[str]) -> str:
    return patterns[0] if len(patterns) == 1 else "|".join(f"(?:{p})" for p in patterns)


def _merge_ignores(rules: list[ScreenRule]) -> list[ScreenRule]:
    """Join neighbouring Ignore rules of one column into one pattern.

    They end the search the same way, so their order among themselves is free;
    hundreds of rules become a few patterns.  Patterns whose meaning depends on
    their place (see :func:`_joinable`) stay by themselves.
    """
    merged = []
    for (action, column, sensitive, joins), run in groupby(
            rules, key=lambda r: (r.action, r.column, r.case_sensitive, r.pattern is not None and _joinable(r.pattern))):
        run = list(run)
        if action == "Ignore" and joins:
            merged.append(ScreenRule(action, column, _either([r.pattern for r in run]), None, sensitive))
        else:
            merged.extend(run)
    return merged


def _first_report(value: Column, rules: list[ScreenRule]) -> Column:
    """``struct(classification, marked)`` of the first rule that holds.

    ``marked`` is the value with each match bracketed; null after an Ignore.
    """
    none = F.lit(None).cast("struct<classification:string,marked:string>")
    case = F
    plain = F.translate(value, _OPEN + _CLOSE, "  ")
    for rule in rules:
        holds = F.lit(True) if rule.regex is None else value.rlike(rule.regex)
        if rule.action == "Ignore":
            case = case.when(holds, none)
        else:
            marked = (F.concat(F.lit(_OPEN), plain, F.lit(_CLOSE)) if rule.regex is None else
                      F.regexp_replace(plain, rule.regex, f"{_OPEN}$0{_CLOSE}"))
            case = case.when(holds, F.struct(F.lit(rule.classification).cast("string").alias("classification"),
                                             marked.alias("marked")))
    return case.otherwise(none) if rules else none


def _parts(hit: Column, shift: Column) -> Column:
    """Parts of a marked value; ``shift`` is where the value starts in its cell."""
    cut = F.filter(F.split(hit["marked"], _CLOSE), lambda p: p.contains(_OPEN))

    def parts(pieces: Column, lengths: Column) -> Column:
        # Text before piece i: all earlier pieces, each one mark longer than its text.
        start = lambda p, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x - 1) + F.instr(p, _OPEN) - 1
        return F.transform(pieces, lambda p, i: F.struct(
            hit["classification"].alias("Classification"),
            (start(p, i) + shift).cast("int").alias("Offset"),
            F.substring_index(p, _OPEN, -1).alias("Word")))

    return _once(cut, lambda pieces: _once(F.transform(pieces, F.length), lambda lengths: parts(pieces, lengths)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def _parts_of(value: Column, verdict_of) -> Column:
    """Parts of one cell, null when it passes; joined cells value by value."""
    values = F.split(value, r"\\")
    hit_at = lambda hit, at: F.struct(hit.alias("hit"), at.alias("at"))
    starts = F.transform(values, lambda v, i: F.aggregate(
        F.slice(values, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1))
    taken_apart = F.filter(F.zip_with(F.transform(values, verdict_of), starts, hit_at), lambda h: h["hit"].isNotNull())
    # One value per cell is the rule; only joined cells are taken apart.
    whole = verdict_of(value)
    hits = F.when(value.contains("\\"), taken_apart).when(whole.isNotNull(), F.array(hit_at(whole, F.lit(0))))
    return F.when(F.size(hits) > 0, F.flatten(F.transform(hits, lambda h: _parts(h["hit"], h["at"]))))


#: From so many rules on they are tried by their required texts.
MANY_RULES = 24


def _decided(value: Column, column: Column, rules: list[ScreenRule], decide: Decider) -> Column:
    """As :func:`_first_report`, for the rule that :mod:`radloom.operators.prefilter` finds."""
    def report(number: Column) -> Column:
        classification = by_number([r.classification for r in rules])(number)
        marked = F.regexp_replace(F.translate(value, _OPEN + _CLOSE, "  "), F.get(decide.patterns(), number), F.lit(f"{_OPEN}$0{_CLOSE}"))
        reported = by_number(["1" if r.action != "Ignore" else None for r in rules])(number).isNotNull()
        return F.when(reported, F.struct(classification.alias("classification"), marked.alias("marked")))

    return F.transform(F.array(decide(value, column)), report)[0]


def _parts_by_texts(value: Column, column: Column, rules: list[ScreenRule], decide: Decider) -> Column:
    """Parts of one cell under many rules, null when it passes."""
    hits = _once(F.split(value, r"\\"), lambda pieces: F.zip_with(
        F.transform(pieces, lambda v: _decided(v, column, rules, decide)), _starts(pieces), lambda hit, at: F.struct(hit.alias("hit"), at.alias("at"))))
    found = F.flatten(F.transform(F.filter(hits, lambda h: h["hit"].isNotNull()), lambda h: _parts(h["hit"], h["at"])))
    return F.transform(F.array(found), lambda parts: F.when(F.size(parts) > 0, parts))[0]


def _starts(pieces: Column) -> Column:
    """Where each piece of a joined value starts."""
    return _once(F.transform(pieces, F.length), lambda lengths: F.transform(pieces, lambda v, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x + 1)))


def _cell_parts(value: Column, column: Column, rules: list[ScreenRule]) -> Column:
    """Parts of one cell, whose column is known per row."""
    if len(rules) >= MANY_RULES:
        return _parts_by_texts(value, column, rules, Decider(tuple(r.regex for r in rules), tuple(r.column for r in rules)))
    columns = list(dict.fromkeys(r.column for r in rules if r.column))

    def verdict_of(value: Column) -> Column:
        anywhere = _first_report(value, _merge_ignores([r for r in rules if not r.column]))
        case = F
        for named in columns:
            mine = _merge_ignores([r for r in rules if r.column in (None, named)])
            case = case.when(column == named, _first_report(value, mine))
        return case.otherwise(anywhere) if columns else anywhere

    return _parts_of(value, verdict_of)


def screen_cells(cells: DataFrame, rules: list[ScreenRule]) -> DataFrame:
    """Every cell with its ``parts``; null for a cell that passes.

    Rules are tried in order and the first that holds decides; a value no rule
    speaks about passes.  A cell joined by ``\\`` is screened value by value.  Many rules are
    tried by the texts they require (:mod:`radloom.operators.prefilter`), with the same result.
    """
    return cells.select("resource", "column", "value", _cell_parts(F.col("value"), F.col("column"), rules).alias("parts"))


def screen(cells: DataFrame, rules: list[ScreenRule]) -> DataFrame:
    """Failing cells with their parts."""
    return screen_cells(cells, rules).where(F.col("parts").isNotNull())


def _verdict_by(rules: list[ScreenRule]):
    return lambda value: _first_report(value, rules)


def screen_rows(df: DataFrame, rules: list[ScreenRule], columns: list[str], skip: list[str] | None = None) -> DataFrame:
    """Add ``failures``: the failing cells of each row, in column order.

    A row is screened where it is; nothing is unpivoted or brought together
    again, so this is the form for whole files.
    """
    skipped = {s.lower() for s in skip or []}
    used = [c for c in columns if c.lower() not in skipped]
    if len(rules) >= MANY_RULES and used:
        decide = Decider(tuple(r.regex for r in rules), tuple(r.column for r in rules))
        named = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in used])
        screened = F.transform(named, lambda c: F.struct(c["column"].alias("column"), c["value"].alias("value"),
                                                         _parts_by_texts(c["value"], c["column"], rules, decide).alias("parts")))
        return df.withColumn("failures", F.filter(screened, lambda c: c["parts"].isNotNull()))
    cells = []
    for name in used:
        parts = _parts_of(F.col(name), _verdict_by(_merge_ignores([r for r in rules if r.column in (None, name)])))
        cells.append(F.struct(F.lit(name).alias("column"), F.col(name).alias("value"), parts.alias("parts")))
    return df.withColumn("failures", F.filter(F.array(*cells), lambda c: c["parts"].isNotNull()))


def _not_allowed(column: Column, value: Column, parts: Column, rules: list[AllowRule]) -> Column:
    """The parts no allow rule speaks for."""
    grouped: dict[tuple, list[str]] = {}
    for r in rules:
        grouped.setdefault((r.pattern, r.column, r.classification, r.case_sensitive, r.part_pattern is None), []).append(
            r.part_pattern or "")

    def allowed(part: Column) -> Column:
        verdict = F.lit(False)
        for (pattern, named, classification, sensitive, whole), words in grouped.items():
            flag = "" if sensitive else "(?i)"
            term = F.lit(True)
            if not whole:
                joined = [w for w in words if _joinable(w)]
                tests = [part["Word"].rlike(flag + w) for w in ([_either(joined)] if joined else []) + [w for w in words if not _joinable(w)]]
                term = reduce(Column.__or__, tests)
            if pattern is not None:
                term = term & value.rlike(flag + pattern)
            if named is not None:
                term = term & (column == named)
            if classification is not None:
                term = term & F.coalesce(part["Classification"] == classification, F.lit(False))
            verdict = verdict | term
        return verdict

    return F.filter(parts, lambda p: ~allowed(p))


def filter_failures(failures: DataFrame, rules: list[AllowRule]) -> DataFrame:
    """Remove allowed parts; a failure that loses all of them is dropped."""
    kept = _not_allowed(F.col("column"), F.col("value"), F.col("parts"), rules)
    return (failures.withColumn("_before", F.size("parts")).withColumn("parts", kept)
            .where((F.size("parts") > 0) | (F.col("_before") == 0)).drop("_before"))


def drop_listed(failures: DataFrame, listed: DataFrame) -> DataFrame:
    """Drop failures whose whole value is on an allow list."""
    values = unique_side(listed.select(F.col(listed.columns[0]).alias("value")), "value")
    return failures.join(values, "value", "left_anti")


def reject_all(files: DataFrame) -> DataFrame:
    """Add ``failures`` with one failure, whatever is in the file."""
    part = F.struct(F.lit("Person").alias("Classification"), F.lit(-1).alias("Offset"),
                    F.lit("Reject All classifier rejected all content").alias("Word"))
    none = F.lit(None).cast("string")
    return files.withColumn("failures", F.array(F.struct(
        none.alias("column"), none.alias("value"), F.array(part).alias("parts"))))


class Classifier(Protocol):
    """Adds ``failures`` to files, zero or more per file."""

    def classify(self, files: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleClassifier:
    """Rules, then allow rules on what they found."""

    columns: tuple[str, ...]
    rules: tuple[ScreenRule, ...]
    allow: tuple[AllowRule, ...] = ()
    skip: tuple[str, ...] = ()

    def classify(self, files: DataFrame) -> DataFrame:
        found = screen_rows(files, list(self.rules), list(self.columns), list(self.skip))
        if not self.allow:
            return found
        left = F.transform("failures", lambda f: F.struct(
            f["column"].alias("column"), f["value"].alias("value"),
            _not_allowed(f["column"], f["value"], f["parts"], list(self.allow)).alias("parts")))
        return found.withColumn("failures", F.filter(left, lambda f: F.size(f["parts"]) > 0))


class RejectAllClassifier:
    def classify(self, files: DataFrame) -> DataFrame:
        return reject_all(files)


def verdict(files: DataFrame) -> DataFrame:
    """Screening status and JSON report of each file.

    ``files`` has ``resource``, ``present`` and the ``failures`` of
    :func:`screen_rows`, which become the report without another pass.
    """
    listed = F.transform("failures", lambda f: F.struct(
        f["parts"].alias("Parts"), F.col("resource").cast("string").alias("Resource"),
        F.lit(None).cast("string").alias("ResourcePrimaryKey"),
        f["column"].alias("ProblemField"), f["value"].alias("ProblemValue")))
    found = F.when(F.col("present"), F.size("failures")).otherwise(F.lit(0))
    status = F.when(~F.col("present"), "ErrorWontRetry").when(found > 0, "IsIdentifiable").otherwise("NotIdentifiable")
    report = F.when(~F.col("present"), F.concat(F.lit("Could not find file to process '"), F.col("resource"), F.lit("'"))) \
              .otherwise(F.to_json(listed))
    return files.select("*", found.cast("long").alias("n_failures"), status.alias("status"), report.alias("report"))


def column_report(screened: DataFrame) -> DataFrame:
    """Cells, failing cells and their share per column, from screened cells."""
    counts = screened.groupBy("column").agg(
        F.count("*").alias("cells"), F.count_if(F.col("parts").isNotNull()).alias("failing"))
    return counts.withColumn("proportion", F.round(F.col("failing") / F.col("cells"), 6))


def value_report(failures: DataFrame) -> DataFrame:
    """Each failing value once per column."""
    return failures.select("column", "value").distinct()
