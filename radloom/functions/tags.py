"""Tag sets: JSON text in, maps or single values out.

The interchange form is ``{"<8 hex digits>": {"vr": .., "val": ..}}``; a second
dialect spells the value ``Value`` and always uses an array.  Both are read.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAG_MAP = "map<string,struct<vr:string,val:string,Value:string>>"
TAG_ITEMS = f"array<{TAG_MAP}>"
# --- fixed values -------------------------------------------------------------
PATIENT_ID = "00100020"
PIXEL_DATA = "7FE00010"
BULK_VRS = ("OB", "OW", "OD", "OF", "OL", "OV")
NAME_GROUPS = ("Alphabetic", "Ideographic", "Phonetic")

# A character that is none, put before a string's leading "[" so that lists alone start with one once parsed.
_MARK = "\ufdd0"


def _may_quote_bracket(json: Column) -> Column:
    """Whether some string of a JSON text may start with ``[``."""
    # Quotes are frequent: a text that starts with one is searched only where its rarer rest stands.
    return (json.contains("[") & json.contains('"[')) | (json.contains("\\u005") & json.contains('"\\u005'))


def _marked(json: Column) -> Column:
    # A quote before a bracket opens a string, or is an escaped one inside a string; marks there go with the others.
    return F.regexp_replace(json, r'"(\[|\\u005[bB])', f'"{_MARK}$1')


def _unmarked(text: Column) -> Column:
    return F.translate(text, _MARK, "")


def _may_be_lower(json: Column) -> Column:
    """Whether some key of a JSON text may be a tag with lower-case digits."""
    return json.rlike(r'"[0-9A-F]{0,7}[a-f][0-9A-Fa-f]{0,7}"\s*:')


def _name(value: Column) -> Column:
    """The component groups of a person name object joined by ``=``; null if it is none."""
    groups = F.from_json(value, ", ".join(f"{g} string" for g in NAME_GROUPS))
    text = F.rtrim(F.concat_ws("=", *[F.coalesce(groups[g], F.lit("")) for g in NAME_GROUPS]), F.lit("="))
    return F.when(F.coalesce(*[groups[g] for g in NAME_GROUPS]).isNotNull(), text)


def _plain_entry(vr: Column, text: Column, clean) -> Column:
    """``struct<vr, val>`` of an element whose value was read as text that starts with ``[`` only if it is a list; ``clean`` takes marks away.

    Lists become their values joined by ``\\``, person name objects their component groups joined by ``=``; any other text stays as it
    is.  The items of a sequence (VR ``SQ``, and nothing else makes one) keep their JSON.  Objects under another
    or no VR keep their JSON too, with a null VR: no representation is known for them.
    """
    is_sequence, is_name = vr.eqNullSafe("SQ"), vr.eqNullSafe("PN")
    listed = text.startswith("[") & ~is_sequence
    objects = listed & ~is_name & text.rlike(r"^\[\s*\{")
    name = lambda v: F.when(is_name & v.startswith("{"), F.coalesce(_name(v), v)).otherwise(v)
    joined = F.array_join(F.transform(F.from_json(text, "array<string>"), name), "\\")
    plain = F.when(objects | is_sequence, text).when(listed, joined).otherwise(name(text))
    return F.struct(F.when(~F.coalesce(objects, F.lit(False)), vr).alias("vr"), clean(plain).alias("val"))


def _entries(tags: Column, clean) -> Column:
    return F.transform_values(tags, lambda _, e: _plain_entry(e["vr"], F.coalesce(e["Value"], e["val"]), clean))


def any_lower(tags: Column) -> Column:
    """Whether some key is not in upper case; all keys are looked at as one text."""
    keys = F.array_join(F.map_keys(tags), '"')
    return keys != F.upper(keys)


def merged_keys(tags: Column) -> Column:
    """The map with keys in upper case, as :func:`upper_keys` gives it."""
    entries = F.transform(F.map_entries(tags), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"), (e["key"] != F.upper(e["key"])).alias("lower")))
    ranked = F.concat(F.filter(entries, lambda e: ~e["lower"]), F.filter(entries, lambda e: e["lower"]))
    keys = F.transform(ranked, lambda e: e["key"])
    firsts = F.filter(ranked, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"])))


def upper_keys(tags: Column) -> Column:
    """The map with keys in upper case; of two spellings of a tag the upper-case one stays, else the first."""
    return F.transform(F.array(tags), lambda m: F.when(any_lower(m), merged_keys(m)).otherwise(m))[0]


def _as_it_is(text: Column) -> Column:
    return text


def parse_tags(json: Column) -> Column:
    """Tag JSON to ``map<tag, struct<vr, val>>``; null if it is not an object.

    Values are plain text, those of a list joined by ``\\`` and person name objects as their component groups; a text that starts with ``[`` is one
    nevertheless.  Sequences (VR ``SQ``) keep the JSON of their items; objects of any other VR, or none, have a null VR and their JSON.  Tags are in upper case.
    """
    lists = json.contains("[") | (json.contains('Value"') & json.contains('"Value"')) | json.contains(NAME_GROUPS[0])
    read = F.when(_may_quote_bracket(json), _entries(F.from_json(_marked(json), TAG_MAP), _unmarked)).when(
        lists, _entries(F.from_json(json, TAG_MAP), _as_it_is)).otherwise(F.from_json(json, "map<string,struct<vr:string,val:string>>"))
    # The text is searched for lower-case tags only where a key has been read that is not in upper case.
    return F.transform(F.array(read), lambda m: F.when(any_lower(m) & _may_be_lower(json), merged_keys(m)).otherwise(m))[0]


def parse_items(json: Column) -> Column:
    """The items of a sequence, each as :func:`parse_tags` gives it."""
    def items(text: Column, clean) -> Column:
        return F.transform(F.from_json(text, TAG_ITEMS), lambda item: _entries(item, clean))

    read = F.when(_may_quote_bracket(json), items(_marked(json), _unmarked)).otherwise(items(json, _as_it_is))
    return F.when(_may_be_lower(json), F.transform(read, upper_keys)).otherwise(read)


def parse_some(json: Column, tags: list[str]) -> Column:
    """A struct of ``struct<vr, val>`` with only the named tags, as :func:`parse_tags` reads them.

    The parser skips every other tag, so wide sets cost little.  Where a set spells a tag in lower case, all of it is read.
    """
    schema = ", ".join(f"`{t}` struct<vr:string,val:string,Value:string>" for t in tags)
    quoted = _may_quote_bracket(json)

    def one(read: Column, tag: str) -> Column:
        entry = read[tag]
        return F.when(entry.isNotNull(), _plain_entry(entry["vr"], F.coalesce(entry["Value"], entry["val"]), _unmarked)).alias(tag)

    few = F.transform(F.array(F.from_json(F.when(quoted, _marked(json)).otherwise(json), schema)), lambda read: F.struct(*[one(read, t) for t in tags]))[0]
    if all(t == t.lower() for t in tags):
        return few
    return F.when(_may_be_lower(json), F.transform(F.array(parse_tags(json)), lambda m: F.struct(*[F.try_element_at(m, F.lit(t)).alias(t) for t in tags]))[0]).otherwise(few)


def tags_to_json(tags: Column) -> Column:
    return F.to_json(tags)


def entry_values(entry: Column) -> Column:
    """All values of one parsed tag entry."""
    return F.split(entry["val"], r"\\")


def tag_text(tags: Column, tag: str) -> Column:
    """Values of a tag joined by ``\\``; null when absent or empty."""
    return F.try_element_at(tags, F.lit(tag))["val"]


def variant_value(variant: Column, *tags: str, as_type: str = "string") -> Column:
    """First value found at a path of tags, in either dialect.

    Steps through a sequence take its first item.
    """
    found = []
    for name in ("val", "Value"):
        path = "$" + f".{name}[0]".join(f"['{t}']" for t in tags)
        for leaf in (f".{name}[0]", f".{name}"):
            found.append(F.try_variant_get(variant, path + leaf, as_type))
    return F.coalesce(*found)


def strip_bulk(tags: Column) -> Column:
    """Drop pixel data and every other binary element."""
    return F.map_filter(tags, lambda tag, e: (tag != PIXEL_DATA) & ~F.coalesce(e["vr"].isin(*BULK_VRS), F.lit(False)))


def select_tags(tags: Column, allow: list[str] | None = None, deny_pattern: str | None = None) -> Column:
    """Keep listed tags and drop those whose name matches a pattern."""
    if allow is not None:
        tags = F.map_filter(tags, lambda tag, _: tag.isin(*allow))
    if deny_pattern:
        tags = F.map_filter(tags, lambda tag, _: ~tag.rlike(deny_pattern))
    return tags
