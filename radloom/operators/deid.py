"""De-identification of tag maps by an allow-list script.

The script becomes sets of tags per action; a row is rewritten by two map
expressions, so nothing is exploded, joined or regrouped.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.tags import any_lower, merged_keys, parse_items
from radloom.template import TAG_OF_KEYWORD, require_tags

# How deep sequences are rewritten; deeper ones are removed.
MAX_NESTING = 3

_CALL = re.compile(r"@(\w+)\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
MAX_DATE_SHIFT = 3650


@dataclass(frozen=True)
class Script:
    params: dict[str, str] = field(default_factory=dict)
    actions: dict[str, str] = field(default_factory=dict)
    keep_groups: frozenset[str] = frozenset()
    removals: frozenset[str] = frozenset()


def load_script(xml: str) -> Script:
    """Read ``p`` parameters, ``e`` elements, ``k`` kept groups, ``r`` removals.

    Entries switched off (``en="F"``) do not count.
    """
    params, actions, groups, removals = {}, {}, set(), set()
    for node in ET.fromstring(xml):
        tag = node.get("t")
        if node.tag == "p":
            params[tag] = (node.text or "").strip()
        elif node.get("en", "T") != "T":
            continue
        elif node.tag == "e":
            actions[tag.upper()] = (node.text or "").strip()
        elif node.tag == "k":
            groups.add(tag.upper())
        elif node.tag == "r":
            removals.add(tag)
    return Script(params, actions, frozenset(groups), frozenset(removals))


def digest(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), value), 256)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def hash_text(value: Column, length: int, salt: str) -> Column:
    return F.upper(F.substring(digest(value, salt), 1, length))


def hash_uid(value: Column, root: str, salt: str) -> Column:
    """A UID under ``root`` with 120 bits of the value's digest in decimal."""
    number = lambda d, at: F.conv(F.substring(d, at, 15), 16, 10)
    return once(digest(value, salt), lambda d: F.concat(F.lit(root + "."), number(d, 1), F.lpad(number(d, 16), 19, "0")))


def days_back(patient: Column, salt: str, span: int = MAX_DATE_SHIFT) -> Column:
    """Date shift of a patient: the same for all of the patient's dates."""
    return (F.conv(F.substring(digest(patient, salt), 1, 8), 16, 10).cast("long") % span).cast("int")


def hash_date(value: Column, patient: Column, salt: str, span: int = MAX_DATE_SHIFT) -> Column:
    """A ``yyyyMMdd`` date moved back by its patient's shift; null if no date."""
    day = F.to_date(F.try_to_timestamp(value, F.lit("yyyyMMdd")))
    return F.date_format(F.date_sub(day, days_back(patient, salt, span)), "yyyyMMdd")


@dataclass(frozen=True)
class _Context:
    """What an action may refer to."""

    tags: Column
    script: Script
    salt: str
    now: Column | None
    tags_of: dict[str, str]

    def param(self, name: str) -> str:
        return self.script.params.get(name.strip().lstrip("@"), "")

    def value_of(self, name: str, this: Column) -> Column:
        if name.strip() == "this":
            return this
        entry = F.try_element_at(self.tags, F.lit(require_tags([name.strip()], self.tags_of)[name.strip()]))
        return F.coalesce(entry["val"], F.lit(""))

    def instant(self) -> Column:
        if self.now is None:
            raise ValueError("the script writes dates or times; pass now=")
        return self.now


def _braces(text: str) -> list[str]:
    """The top-level ``{...}`` groups of a text."""
    groups, depth, start = [], 0, 0
    for at, ch in enumerate(text):
        if ch == "{":
            depth, start = depth + 1, at + 1 if depth == 0 else start
        elif ch == "}":
            depth -= 1
            if depth == 0:
                groups.append(text[start:at])
    return groups


REMOVED = None


def _each(this: Column, action) -> Column:
    """``action`` on every value of a multi-valued text."""
    parts = F.transform(F.split(this, r"\\"), lambda v: F.coalesce(action(v), F.lit("")))
    return F.when(this.contains("\\"), F.array_join(parts, "\\")).otherwise(action(this))


def _value(action: str, this: Column, ctx: _Context) -> Column | None:
    """New value of an element under an action; ``REMOVED`` drops it."""
    call = _CALL.match(action)
    if not call:
        return F.lit(action)
    name, args, rest = call.group(1), [a for a in call.group(2).split(",") if a.strip()], action[call.end():]
    if name in ("keep", "require"):
        return this
    if name == "remove":
        return REMOVED
    if name == "empty":
        return F.lit("")
    if name == "always":
        return _text(rest, this, ctx)
    if name == "hashuid":
        return _each(this, lambda v: hash_uid(v, ctx.param(args[0]), ctx.salt))
    if name == "hash":
        return _each(this, lambda v: hash_text(ctx.value_of(args[0], v), int(args[1]) if len(args) > 1 else 64, ctx.salt))
    if name == "hashdate":
        return _each(this, lambda v: hash_date(v, ctx.value_of(args[1], v), ctx.salt))
    if name == "hashptid":
        return F.concat(F.lit(ctx.param(args[0]) + "-"), hash_text(ctx.value_of(args[1], this), 16, ctx.salt))
    if name == "append":
        added = _text(_braces(rest)[0], this, ctx)
        return F.when(F.length(this) > 0, F.concat(this, F.lit("\\"), added)).otherwise(added)
    if name == "if":
        if args[1].strip() != "isblank":
            raise ValueError(f"condition {args[1]} is not supported")
        return _branch(F.length(F.trim(ctx.value_of(args[0], this))) == 0, _braces(rest), this, ctx)
    return _text(action, this, ctx)


def _branch(condition: Column, branches: list[str], this: Column, ctx: _Context) -> Column:
    # A removed branch becomes null; null values are filtered out afterwards.
    yes, no = (F.lit(None).cast("string") if v is REMOVED else v
               for v in (_value(b, this, ctx) for b in (branches + [""])[:2]))
    return F.when(condition, yes).otherwise(no)


def _text(text: str, this: Column, ctx: _Context) -> Column:
    """Text in which parameters, the date and the time are filled in."""
    pieces, at = [], 0
    for call in _CALL.finditer(text):
        pieces.append(F.lit(text[at:call.start()]))
        name, arg = call.group(1), call.group(2)
        if name == "param":
            pieces.append(F.lit(ctx.param(arg)))
        elif name in ("date", "time"):
            pieces.append(F.date_format(ctx.instant(), "yyyyMMdd" if name == "date" else "HHmmss"))
        else:
            raise ValueError(f"action {name} is not supported")
        at = call.end()
    pieces.append(F.lit(text[at:]))
    return F.concat(*pieces)


def _kept(tag: Column, script: Script) -> Column:
    """Whether an element survives, by its own action or by its group."""
    gone = [t for t, a in script.actions.items() if a.startswith("@remove")]
    group = F.substring(tag, 1, 4)
    by_group = group.isin(*script.keep_groups) if script.keep_groups else F.lit(False)
    other = by_group if "unspecifiedelements" in script.removals else F.lit(True)
    if "privategroups" in script.removals:
        other = other & ~F.substring(tag, 4, 1).isin(*"13579BDF")
    if "curves" in script.removals:
        other = other & ~group.startswith("50")
    if "overlays" in script.removals:
        other = other & ~group.startswith("60")
    stays = [t for t in script.actions if t not in gone]
    verdict = F
    for own, stay in ((stays, True), (gone, False)):
        verdict = verdict.when(tag.isin(*own), F.lit(stay)) if own else verdict
    return verdict.otherwise(other) if script.actions else other


def deidentify(df: DataFrame, script: Script, salt: str, tags: str = "tags", now: Column | None = None,
               tags_of: dict[str, str] = TAG_OF_KEYWORD) -> DataFrame:
    """Rewrite ``map<tag, struct<vr, val>>``, as :func:`radloom.functions.tags.parse_tags` reads it, under a script.

    Hashes and dates go value by value.  A sequence that the script
    keeps has the same script applied to each of its items, where references to
    other elements mean those of the whole tag set; sequences nested deeper than
    ``MAX_NESTING`` are removed.  Without a VR, items that are
    tag sets make a sequence; other objects without a known VR are removed.
    """
    ctx = _Context(F.col(tags), script, salt, now, tags_of)
    # Maps that were not read by parse_tags may hold lower-case tags.  A column of their own keeps the keys from being tested again for every use.
    upper, given = f"_upper_{tags}", F.col(tags)
    df = df.withColumn(upper, F.when(any_lower(given), merged_keys(given)).otherwise(given))
    return df.withColumn(tags, _rewritten(F.col(upper), script, ctx, MAX_NESTING)).drop(upper)


_TAG_SETS = r'^\s*\[\s*\{\s*"[0-9A-Fa-f]{8}"\s*:\s*\{'


def _is_sequence(entry: Column) -> Column:
    """By the VR; without one, by items that are tag sets."""
    return entry["vr"].eqNullSafe("SQ") | (entry["vr"].isNull() & F.coalesce(entry["val"].rlike(_TAG_SETS), F.lit(False)))


def _is_unknown(entry: Column) -> Column:
    """Objects of no known representation, which no action could reach into."""
    objects = entry["val"].rlike(r'^\s*(\[\s*)*\{\s*["}]') & ~entry["val"].rlike(_TAG_SETS)
    return entry["vr"].isNull() & F.coalesce(objects, F.lit(False))


def _rewritten(source: Column, script: Script, ctx: _Context, depth: int) -> Column:
    by_action: dict[str, list[str]] = {}
    for tag, action in script.actions.items():
        if not action.startswith(("@remove", "@keep", "@require")):
            by_action.setdefault(action, []).append(tag)

    def nested(entry: Column) -> Column:
        return F.to_json(F.transform(parse_items(entry["val"]), lambda item: _rewritten(item, script, ctx, depth - 1)))

    def rewritten(tag: Column, entry: Column) -> Column:
        plain = entry["val"]
        this = F.coalesce(plain, F.lit(""))
        value = F
        for action, tags_with in by_action.items():
            value = value.when(tag.isin(*tags_with), _value(action, this, ctx))
        if depth:
            # What the script rewrites as text has no items left to rewrite.
            value = value.when(_is_sequence(entry), nested(entry))
        new = value.otherwise(plain) if by_action or depth else plain
        return F.struct(entry["vr"].alias("vr"), new.alias("val"))

    gone = lambda entry: _is_unknown(entry) if depth else _is_unknown(entry) | _is_sequence(entry)
    kept = F.map_filter(source, lambda tag, entry: _kept(tag, script) & ~gone(entry))
    kept = F.transform_values(kept, rewritten)
    if any(a.startswith("@if") for a in by_action):
        conditional = [t for a, ts in by_action.items() if a.startswith("@if") for t in ts]
        kept = F.map_filter(kept, lambda tag, e: ~tag.isin(*conditional) | e["val"].isNotNull())
    added = [(t, _value(a, F.lit(""), ctx) if a.startswith("@always") else F.lit(""))
             for t, a in script.actions.items() if a.startswith(("@always", "@require"))]
    if added and depth == MAX_NESTING:  # items get no elements they did not have
        entries = F.array(*[F.when(~F.map_contains_key(source, t), F.struct(F.lit(t).alias("key"), F.struct(
            F.lit(None).cast("string").alias("vr"), v.alias("val")).alias("value"))) for t, v in added])
        kept = F.map_concat(kept, F.map_from_entries(F.array_compact(entries)))
    return kept


def anon_status(df: DataFrame, status: str = "status", output_path: str = "output_path") -> DataFrame:
    """Output path and route of a de-identified file; a failure has no output."""
    done = F.coalesce(F.col(status) == "Anonymised", F.lit(False))
    return df.withColumn(output_path, F.when(done, F.col(output_path))).withColumn(
        "route", F.when(done, "verify").otherwise("noverify"))
