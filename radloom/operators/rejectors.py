"""Rejection rules: each yields a reason column, the first reason wins.

A rejector may need lookups; ``prepare`` adds them as columns by equi joins
against distinct key lists, and ``reason`` then reads those columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import unique_side
from radloom.functions.text import blank_to_null
from radloom.schemas import SERIES, SOP, STUDY, Catalogue


class Rejector(Protocol):
    def prepare(self, df: DataFrame, slot: str) -> DataFrame: ...

    def reason(self, slot: str) -> Column: ...


def _flag_members(df: DataFrame, column: Column, listed: DataFrame, flag: str) -> DataFrame:
    """Add ``flag``: true where ``column`` occurs in the one-column list."""
    keys = unique_side(listed.toDF("_member").where(F.col("_member").isNotNull()), "_member").withColumn(flag, F.lit(True))
    return df.join(keys, column == F.col("_member"), "left").drop("_member")


@dataclass(frozen=True)
class Lookup:
    """One equi join of a rejector: the flag tells whether ``value``, made of ``column`` alone, is on the list."""

    column: str
    value: Column
    listed: DataFrame
    flag: str


def _prepared(df: DataFrame, lookups: list[Lookup]) -> DataFrame:
    for lookup in lookups:
        df = _flag_members(df, lookup.value, lookup.listed, lookup.flag)
    return df


@dataclass(frozen=True)
class Blacklist:
    """Reject rows whose study, series or instance UID is on a list.

    Each UID column the list has takes part as its own equi join; the outcomes
    are OR-ed afterwards, which keeps hash and merge joins possible.
    """

    catalogue: Catalogue

    def _columns(self) -> list[tuple[str, str]]:
        found = [(c, self.catalogue.column(c)) for c in (STUDY, SERIES, SOP)]
        used = [(c, own) for c, own in found if own]
        if not used:
            raise ValueError(f"{self.catalogue.name} has none of the image UID columns")
        return used

    def lookups(self, df: DataFrame, slot: str) -> list[Lookup]:
        return [Lookup(column, F.col(column), self.catalogue.df.select(own), f"{slot}_{at}")
                for at, (column, own) in enumerate(self._columns())]

    def prepare(self, df: DataFrame, slot: str) -> DataFrame:
        return _prepared(df, self.lookups(df, slot))

    def reason(self, slot: str) -> Column:
        flags = [F.col(f"{slot}_{at}") for at in range(len(self._columns()))]
        return F.when(F.coalesce(*flags, F.lit(False)), F.lit(f"Blacklisted in {self.catalogue.name}"))


@dataclass(frozen=True)
class ColumnValues:
    """Reject rows whose value in one column is on a list; null is accepted.

    A list that comes from a table is compared without regard to case.
    """

    column: str
    values: DataFrame | tuple[str, ...]
    ignore_case: bool | None = None

    REASON = "Patient or Identifier was in reject list"

    def _from_table(self) -> bool:
        return isinstance(self.values, DataFrame)

    def lookups(self, df: DataFrame, slot: str) -> list[Lookup]:
        if self.column.lower() not in {c.lower() for c in df.columns}:
            raise ValueError(f"expected a column called {self.column}")
        if not self._from_table():
            return []
        fold = F.lower if self.ignore_case is not False else (lambda c: c)
        listed = self.values.select(fold(F.col(self.values.columns[0]).cast("string")))
        return [Lookup(self.column, fold(F.col(self.column).cast("string")), listed, slot)]

    def prepare(self, df: DataFrame, slot: str) -> DataFrame:
        return _prepared(df, self.lookups(df, slot))

    def reason(self, slot: str) -> Column:
        if self._from_table():
            hit = F.coalesce(F.col(slot), F.lit(False))
        else:
            fold = F.lower if self.ignore_case else (lambda c: c)
            wanted = [v.lower() if self.ignore_case else v for v in self.values]
            hit = F.coalesce(fold(F.col(self.column)).isin(*wanted), F.lit(False))
        return F.when(hit, F.lit(self.REASON))


@dataclass(frozen=True)
class Rule:
    when: str
    reason: str


@dataclass(frozen=True)
class DynamicRules:
    """Ordered rules written by users: a SQL condition and a SQL reason.

    The first rule whose condition holds ends the set; if its reason is blank the
    row is accepted.  The set compiles to one CASE expression.
    """

    rules: tuple[Rule, ...] = field(default_factory=tuple)

    @classmethod
    def from_yaml(cls, text: str) -> "DynamicRules":
        return cls(tuple(Rule(str(r["when"]), str(r["reason"])) for r in yaml.safe_load(text)))

    def prepare(self, df: DataFrame, slot: str) -> DataFrame:
        return df

    def reason(self, slot: str) -> Column:
        if not self.rules:
            return F.lit(None).cast("string")
        case = F
        for rule in self.rules:
            case = case.when(F.expr(rule.when), blank_to_null(F.expr(rule.reason).cast("string")))
        return case.otherwise(F.lit(None).cast("string"))

    def explain(self, df: DataFrame) -> DataFrame:
        """The verdict per row, and which rules hold on their own."""
        hits = [F.coalesce(F.expr(r.when), F.lit(False)).alias(f"rule_{n}") for n, r in enumerate(self.rules, 1)]
        reason = self.reason("")
        return df.select("*", *hits, reason.isNotNull().alias("reject"), reason.alias("reason"))


@dataclass(frozen=True)
class RejectAll:
    def prepare(self, df: DataFrame, slot: str) -> DataFrame:
        return df

    def reason(self, slot: str) -> Column:
        return F.lit("Rejector is RejectAll")


@dataclass(frozen=True)
class BatchFunction:
    """A rule SQL cannot express: pandas columns in, a series of reasons out.

    The function gets the named columns of one Arrow batch and returns a reason,
    or None, per row.
    """

    columns: tuple[str, ...]
    function: Callable[..., pd.Series]

    def prepare(self, df: DataFrame, slot: str) -> DataFrame:
        return df

    def reason(self, slot: str) -> Column:
        return blank_to_null(F.pandas_udf(self.function, "string")(*[F.col(c) for c in self.columns]))


@dataclass(frozen=True)
class ModalityRules:
    """A rejector for some modalities, beside or instead of the usual ones."""

    modalities: str
    rejector: Rejector
    overrides: bool = False

    def applies_to(self, modality: str) -> bool:
        listed = [m for m in self.modalities.split(",") if m] if self.modalities.strip() else []
        return modality.lower() in {m.lower() for m in listed}


def select_chain(modality: str, base: list[Rejector], specific: list[ModalityRules], no_filters: bool = False) -> list[Rejector]:
    """The rejectors for one request, in the order they are asked."""
    if no_filters:
        return []
    applicable = [s for s in specific if s.applies_to(modality)]
    if any(s.overrides for s in applicable):
        if not all(s.overrides for s in applicable):
            raise ValueError(f"overriding and non-overriding rules are mixed for modality {modality}")
        return [s.rejector for s in applicable]
    chain: list[Rejector] = []
    for rejector in [*(s.rejector for s in applicable), *base]:
        if not any(rejector is seen for seen in chain):
            chain.append(rejector)
    return chain


def _row_local(rejector: Rejector) -> bool:
    """Whether a verdict is a cheap expression of the row alone."""
    return isinstance(rejector, (DynamicRules, RejectAll)) or isinstance(rejector, ColumnValues) and not rejector._from_table()


def apply_rejectors(df: DataFrame, chain: list[Rejector], key: str | None = None) -> DataFrame:
    """Add ``reject`` and ``reason``; the first rejector with a reason decides.

    Rows that leading rules decide by themselves (rules give one row one verdict each time) are kept out of the
    lookups that follow: each row goes one of two ways, and only undecided ones are shuffled for the lists.
    Lists are met in any order, so those of the column ``key`` come last: the rows then lie by what the caller goes on with.
    """
    leading = next((at for at, r in enumerate(chain) if not _row_local(r)), len(chain))
    if 0 < leading < len(chain):
        first = F.coalesce(*[r.reason("") for r in chain[:leading]])
        for rejector in chain[:leading]:
            rejector.prepare(df, "")  # its checks
        decided = df.where(first.isNotNull()).select("*", F.lit(True).alias("reject"), first.alias("reason"))
        return decided.unionByName(apply_rejectors(df.where(first.isNull()), chain[leading:], key))
    columns = df.columns
    reasons, lookups = [], []
    for at, rejector in enumerate(chain):
        slot = f"_reject_{at}"
        if isinstance(rejector, (Blacklist, ColumnValues)):
            lookups += rejector.lookups(df, slot)
        else:
            df = rejector.prepare(df, slot)
        reasons.append(rejector.reason(slot))
    df = _prepared(df, sorted(lookups, key=lambda lookup: key is not None and lookup.column.lower() == key.lower()))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    judged = df.withColumn("reason", reason)
    return judged.select(*columns, F.col("reason").isNotNull().alias("reject"), "reason")


def apply_by_modality(df: DataFrame, modality: str, values: list[str], base: list[Rejector],
                      specific: list[ModalityRules]) -> DataFrame:
    """One pass over rows of several modalities, each under its own chain."""
    chains = {v: select_chain(v, base, specific) for v in values}
    known: list[Rejector] = []
    for rejector in [*base, *(r for chain in chains.values() for r in chain)]:
        if not any(rejector is seen for seen in known):
            known.append(rejector)
    columns = df.columns
    for at, rejector in enumerate(known):
        df = rejector.prepare(df, f"_reject_{at}")
    place = lambda r: next(at for at, seen in enumerate(known) if seen is r)

    def reason_of(chain: list[Rejector]) -> Column:
        found = [r.reason(f"_reject_{place(r)}") for r in chain]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    case = F
    for value, chain in chains.items():
        case = case.when(F.col(modality) == value, reason_of(chain))
    judged = df.withColumn("reason", case.otherwise(reason_of(base)) if chains else reason_of(base))
    return judged.select(*columns, F.col("reason").isNotNull().alias("reject"), "reason")
