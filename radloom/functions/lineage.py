"""Message lineage: which record was produced from which."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ARROW = "->"


def child_header(parent: Column, guid: Column, producer: str) -> Column:
    """Header of a record made from ``parent``; the first timestamp is kept."""
    return F.struct(
        guid.alias("guid"),
        F.lit(producer).alias("producer"),
        parent["original_unix"].alias("original_unix"),
        F.concat(F.coalesce(parent["parents"], F.array().cast("array<string>")), F.array(parent["guid"])).alias("parents"),
    )


def parents_to_text(parents: Column) -> Column:
    return F.array_join(parents, ARROW)


def text_to_parents(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, ARROW)).otherwise(F.array().cast("array<string>"))


def is_descendant(header: Column, ancestor_guid: Column) -> Column:
    return F.array_contains(header["parents"], ancestor_guid)
