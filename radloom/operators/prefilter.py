"""Screening by many rules: only those are tried whose required text stands in the value.

Most patterns cannot match without some literal text.  :func:`required_texts` reads it off a pattern, or says that there is none it is sure
of.  All required texts make one pattern, which one pass over a value looks for at every place; the texts found name the rules worth trying.
Rules without such a text are tried on every value that holds the shorter text they may require.  The first rule that holds decides, in the order of all.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

RUN = 3
_BREAK = "\u0003"


class _Unsure(Exception):
    """The pattern uses something this reader does not follow."""


class _Reader:
    """Texts of which every match must hold one, from a Java pattern; ``None`` where nothing is certain."""

    def __init__(self, pattern: str, least: int):
        self.text, self.at, self.least = pattern, 0, least

    def peek(self, n: int = 1) -> str:
        return self.text[self.at:self.at + n]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise _Unsure
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> frozenset[str] | None:
        found = [self.branch()]
        while self.peek() == "|":
            self.take()
            found.append(self.branch())
        return None if None in found else frozenset().union(*found)

    def branch(self) -> frozenset[str] | None:
        best, run = None, ""

        def better(texts: frozenset[str] | None) -> None:
            nonlocal best
            if texts and min(map(len, texts)) >= self.least and (best is None or (min(map(len, texts)), -len(texts)) > (min(map(len, best)), -len(best))):
                best = texts

        while self.peek() not in ("", "|", ")"):
            char, inner = self.atom()
            least, fixed = self.quantifier()
            if char == "":  # stands between characters without taking one
                if least is not None:
                    raise _Unsure
                better(inner)
                continue
            if char is not None and least is None:
                run += char
                continue
            if char is not None and least:
                run += char
            better(frozenset([run]))
            run = char if char is not None and least == 1 and fixed else ""
            if inner is not None and (least is None or least > 0):
                better(inner)
        better(frozenset([run]))
        return best

    def atom(self) -> tuple[str | None, frozenset[str] | None]:
        """A character, "" for a place between characters, or None; and the texts a group requires."""
        char = self.take()
        if char == "(":
            return self.group()
        if char == "[":
            return self.character_class(), None
        if char in "^$":
            return "", None
        if char == ".":
            return None, None
        if char == "\\":
            return self.escape(), None
        if char in "*+?{":
            raise _Unsure
        return (char.lower() if char.isascii() else None), None

    def group(self) -> tuple[str | None, frozenset[str] | None]:
        kind = None
        if self.peek() == "?":
            kind = next((k for k in ("?:", "?=", "?!", "?<=", "?<!") if self.text.startswith(k, self.at)), None)
            if kind is None:
                raise _Unsure  # flags, names, atomic groups
            self.at += len(kind)
        inner = self.alternatives()
        if self.take() != ")":
            raise _Unsure
        return (None, inner) if kind in (None, "?:") else ("", None)

    def character_class(self) -> str | None:
        inside, first = "", True
        while (char := self.take()) != "]" or first and inside in ("", "^"):
            if char in "[&":
                raise _Unsure
            inside += char + (self.take() if char == "\\" else "")
            first = inside in ("", "^")
        return inside.lower() if len(inside) == 1 and inside.isascii() and inside != "^" else None

    def escape(self) -> str | None:
        char = self.take()
        if char in "bBAzZ":
            return ""
        if char in "dDwWsShHvVtnrfae123456789":
            return None
        if not char.isascii() or char.isalnum():
            raise _Unsure
        return char

    def quantifier(self) -> tuple[int | None, bool]:
        """The least number of times, None without a quantifier, and whether it is the number."""
        found = re.compile(r"([*+?]|\{(\d+)(,?)(\d*)\})[+?]?").match(self.text, self.at)
        if found is None:
            return None, True
        self.at = found.end()
        if found.group(2):
            return int(found.group(2)), not found.group(3)
        return (1 if found.group(1) == "+" else 0), False


def required_texts(pattern: str, least: int = RUN) -> frozenset[str] | None:
    """Lower-case ASCII texts of ``least`` characters or more, one of which every match of a Java pattern holds in some case; None if unknown."""
    reader = _Reader(pattern, least)
    try:
        found = reader.alternatives()
    except _Unsure:
        return None
    return found if reader.at == len(pattern) else None


def _by_text(texts: list[frozenset[str] | None]) -> dict[str, list[int]]:
    """Rules by their texts; a text also names the rules of those it starts with, since the longest one found at a place stands for all."""
    every = {text for of_rule in texts for text in of_rule or ()}
    return {t: [n for n, of_rule in enumerate(texts) if of_rule and any(t.startswith(x) for x in of_rule)] for t in sorted(every)}


def _longest_of(texts: list[str]) -> str:
    """A Java pattern that matches the longest of the texts standing at a place, without trying them one by one."""
    rests: dict[str, list[str]] = {}
    for text in texts:
        if text:
            rests.setdefault(text[0], []).append(text[1:])
    if not rests:
        return ""
    either = "|".join(re.escape(first) + _longest_of(rest) for first, rest in rests.items())
    return f"(?:{either})" + ("?" if "" in texts else "")


def _holds_one(value: Column, texts: frozenset[str] | None) -> Column | None:
    """Whether a value holds one of a few short texts; None where that is not worth a test."""
    if not texts or len(texts) > 4:
        return None
    looked_at = F.lower(value) if any(c.isalpha() for t in texts for c in t) else value
    return reduce(Column.__or__, [looked_at.contains(t) for t in sorted(texts)])


@dataclass(frozen=True)
class Decider:
    """The first rule that holds for a value of a column, as its number; null if none does."""

    regexes: tuple[str | None, ...]
    columns: tuple[str | None, ...]

    def __call__(self, value: Column, column: Column) -> Column:
        texts = [None if r is None else required_texts(r.removeprefix("(?i)")) for r in self.regexes]
        named = _by_text(texts)
        case, any_always = F, False
        for number, (regex, of) in enumerate(zip(self.regexes, self.columns)):
            if texts[number] is None:
                holds = F.lit(True) if regex is None else value.rlike(regex)
                needed = None if regex is None else _holds_one(value, required_texts(regex.removeprefix("(?i)"), 1))
                holds = holds if needed is None else needed & holds
                case, any_always = case.when((column == of) & holds if of else holds, F.lit(number)), True
        always = case.otherwise(F.lit(None).cast("int")) if any_always else F.lit(None).cast("int")
        return F.least(self._named(value, column, named), always) if named else always

    def _named(self, value: Column, column: Column, named: dict[str, list[int]]) -> Column:
        """The first rule with a required text that holds."""
        regexes, columns = self.patterns(), _texts([c or "" for c in self.columns])
        by_text = F.from_json(F.lit(json.dumps(named)), "map<string,array<int>>")
        # A place is looked at without taking it, so texts that overlap are all found.
        found = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(f"(?=({_longest_of(list(named))}))"), F.lit(1)))
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda t: F.try_element_at(by_text, t)))))
        holds = lambda n: F.get(columns, n).isin("", column) & F.regexp_like(value, F.get(regexes, n))
        first = F.aggregate(numbers, F.lit(None).cast("int"), lambda before, n: F.when(before.isNotNull(), before).when(holds(n), n))
        return F.when(F.length(value) >= RUN, first)

    def patterns(self) -> Column:
        """The patterns by number; a rule without one takes the whole value."""
        return _texts([r if r is not None else r"(?s)\A.*\z" for r in self.regexes])


def _texts(values: list[str]) -> Column:
    return F.split(F.lit(_BREAK.join(values)), _BREAK)


def by_number(values: list[str | None]) -> Callable[[Column], Column]:
    """Looks up one of the values by its number."""
    listed = F.from_json(F.lit(json.dumps(values)), "array<string>")
    return lambda number: F.get(listed, number)
