"""Tag sets to template columns, elevation of nested tags, column choice."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.tags import parse_items, parse_some, tag_text
from radloom.schemas import PATH
from radloom.template import TAG_OF_KEYWORD, TemplateTable, require_tags

# Columns that describe the file or its message and never come from tags.
BOOKKEEPING = (PATH, "MessageGuid", "DicomFileSize")


def flatten(df: DataFrame, tables: list[TemplateTable], json: str = "DicomDataset", path: str = "DicomFilePath",
            tags: str | None = None, carry: tuple[str, ...] = (), tags_of: dict[str, str] = TAG_OF_KEYWORD) -> DataFrame:
    """Columns of a template from tag sets, plus path, size and message guid.

    Columns named in ``carry`` go along as they are.
    Reads a parsed map when ``tags`` names one; else the JSON text is parsed once
    per row, and only for the template's own tags.  Multi-valued tags keep their
    ``\\`` joint and sequences keep their JSON.  A column whose tag neither the
    template nor ``tags_of`` gives is an error; see ``template.load_tags``.
    """
    names = list(dict.fromkeys(n for t in tables for n in t.names))
    given = {PATH: F.col(path)}
    for carried in (*BOOKKEEPING[1:], *carry):
        if carried in df.columns:
            given[carried] = F.col(carried)
    stated = {c.name: c.tag for t in tables for c in t.columns if c.tag}
    wanted = require_tags([n for n in names if n not in given and n not in BOOKKEEPING], {**tags_of, **stated})
    if tags is not None:
        read = {n: tag_text(F.col(tags), tag) for n, tag in wanted.items()}
    else:
        df = df.withColumn("_tags", parse_some(F.col(json), list(dict.fromkeys(wanted.values()))))
        read = {n: F.col(f"_tags.`{tag}`.val") for n, tag in wanted.items()}
    out = [given.pop(n).alias(n) if n in given else read.get(n, F.lit(None).cast("string")).alias(n) for n in names]
    return df.select(*out, *[c.alias(n) for n, c in given.items()])


@dataclass(frozen=True)
class Elevation:
    """Lift a tag inside sequences to a column, optionally on a condition."""

    column: str
    pathway: tuple[str, ...]
    condition: tuple[str, ...] | None = None
    pattern: str | None = None


def load_elevations(xml: str) -> list[Elevation]:
    steps = lambda text: tuple(s.strip() for s in text.split("->"))
    rules = []
    for request in ET.fromstring(re.sub(r"<!DOCTYPE.*?\]>", "", xml, flags=re.DOTALL).strip()):
        conditional = request.find("Conditional")
        rules.append(Elevation(
            request.findtext("ColumnName").strip(), steps(request.findtext("ElevationPathway")),
            steps(conditional.findtext("ConditionalPathway")) if conditional is not None else None,
            conditional.findtext("ConditionalRegex").strip() if conditional is not None else None))
    return rules


def _leaves(tags: Column, steps: tuple[str, ...], tags_of: dict[str, str]) -> Column:
    """All values at a path of tags, through every item of each sequence."""
    entry = lambda m, name: F.try_element_at(m, F.lit(require_tags([name], tags_of)[name]))
    maps = F.array(tags)
    for name in steps[:-1]:
        maps = F.flatten(F.transform(maps, lambda m: parse_items(F.coalesce(entry(m, name)["val"], F.lit("[]")))))
    return F.array_compact(F.transform(maps, lambda m: entry(m, steps[-1])["val"]))


def elevate(df: DataFrame, rules: list[Elevation], tags: str = "tags", tags_of: dict[str, str] = TAG_OF_KEYWORD) -> DataFrame:
    """One column per rule; several matches are joined by ``\\``.  An unknown keyword is an error."""
    for rule in rules:
        values = _leaves(F.col(tags), rule.pathway, tags_of)
        text = F.when(F.size(values) > 0, F.array_join(values, "\\"))
        if rule.condition:
            holds = F.exists(_leaves(F.col(tags), rule.condition, tags_of), lambda v: v.rlike(rule.pattern))
            text = F.when(holds, text)
        df = df.withColumn(rule.column, text)
    return df


def select_columns(df: DataFrame, allow: list[str] | None = None, deny_pattern: str | None = None) -> DataFrame:
    """Leave out columns a target does not have or a pattern forbids."""
    wanted = {a.lower() for a in allow} if allow is not None else None
    return df.select(*[c for c in df.columns if (wanted is None or c.lower() in wanted)
                       and not (deny_pattern and re.search(deny_pattern, c))])


def project_common(source: DataFrame, target: DataFrame) -> DataFrame:
    """The columns both sides have, distinct, in the target's order."""
    have = {c.lower(): c for c in source.columns}
    return source.select(*[F.col(have[c.lower()]).alias(c) for c in target.columns if c.lower() in have]).distinct()
