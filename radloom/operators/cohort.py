"""Cohort selection: identifiers to images, verdicts, counts and dispatch."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions import paths
from radloom.functions.joins import join_side, unique_side
from radloom.functions.ordering import with_position
from radloom.operators.rejectors import Rejector, apply_rejectors
from radloom.schemas import MAX_IDS_PER_MESSAGE, PATH, SERIES, SOP, STUDY, Catalogue

DEFAULT_ROUTING = r"^([A-Z]+)_.*$"


def route_catalogues(catalogues: list[Catalogue], modality: str, key: str,
                     routing: str = DEFAULT_ROUTING) -> list[Catalogue]:
    """Catalogues named for the modality that have the key column."""
    pattern = re.compile(routing)
    if pattern.groups != 1:
        raise ValueError("the routing pattern must have exactly one capture group")
    routed = []
    for catalogue in catalogues:
        found = pattern.search(catalogue.name)
        if catalogue.column(PATH) and catalogue.column(key) and found and found.group(1) == modality:
            routed.append(catalogue)
    if not routed:
        raise ValueError(f"no catalogue holds {key} for modality {modality}")
    return routed


def routed_modality(name: Column, routing: str = DEFAULT_ROUTING) -> Column:
    """Modality a catalogue name stands for; empty text when it has none."""
    return F.regexp_extract(name, routing, 1)


def _held(catalogue: Catalogue) -> DataFrame:
    """Rows of a catalogue that its own filters let through."""
    rows = catalogue.df
    for condition in catalogue.mandatory_filters:
        rows = rows.where(F.expr(condition))
    return rows.where(F.col(catalogue.column(PATH)).isNotNull())


def _requested(catalogue: Catalogue, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a catalogue that its own filters and the request let through."""
    return _held(catalogue).join(wanted, F.col(catalogue.column(key)) == F.col("_wanted"), "left_semi")


def _wanted(ids: DataFrame) -> DataFrame:
    return unique_side(ids.select(F.col("key_value").alias("_wanted")), "_wanted")


def match_images(ids: DataFrame, key: str, catalogues: list[Catalogue], chain: list[Rejector]) -> DataFrame:
    """Every image of the requested identifiers with its verdict.

    The catalogue is cut down by a semi join with the distinct identifiers first;
    verdicts and de-duplication then see requested images only.  The last join of
    every row is on the key, so de-duplication and what goes on by identifier find
    the rows in place; where a large study was split for that join, both deal it
    out again, de-duplication by all result columns.  A single catalogue with a
    primary key needs none.  The result is per distinct identifier; see
    :func:`match_cohort`.
    """
    wanted, results = _wanted(ids), None
    for catalogue in catalogues:
        named = [F.col(catalogue.column(c)).alias(c) for c in (PATH, STUDY, SERIES, SOP)]
        if key not in (PATH, STUDY, SERIES, SOP):
            named.append(F.col(catalogue.column(key)).alias(key))
        judged = apply_rejectors(_requested(catalogue, key, wanted), chain, catalogue.column(key)).select(*named, "reason")
        results = judged if results is None else results.unionByName(judged)
    if len(catalogues) > 1 or not catalogues[0].unique:
        results = results.distinct()
    # What follows from these columns is added after the shuffle, not carried through it.
    return results.select(F.col(key).alias("key_value"), PATH, STUDY, SERIES, SOP,
                          F.col("reason").isNotNull().alias("reject"), "reason")


def match_cohort(ids: DataFrame, key: str, catalogues: list[Catalogue], matched: DataFrame) -> DataFrame:
    """Images per occurrence of each requested identifier.

    An identifier without images appears once per occurrence with nulls.  Those
    are found on their own, from the key column alone: an outer join could not
    split the images of one large study over several tasks, an inner join can.
    """
    asked, present = ids.select("pos", "key_value"), None
    for catalogue in catalogues:
        # All keys, once each: cheaper than to cut the images down to the requested ones first.
        keys = _held(catalogue).select(F.col(catalogue.column(key)).alias("key_value"))
        present = keys if present is None else present.unionByName(keys)
    empty = asked.join(unique_side(present, "key_value"), "key_value", "left_anti")
    return matched.join(asked, "key_value").unionByName(empty, allowMissingColumns=True)


def per_request(ids: DataFrame, per_key: DataFrame) -> DataFrame:
    """Attach one row per key to every occurrence of the key in the request."""
    return ids.select("pos", "key_value").join(join_side(per_key, "key_value"), "key_value", "left")


def match_summary(ids: DataFrame, matched: DataFrame) -> DataFrame:
    """Accepted and rejected images per requested identifier.

    Counts are made per distinct key before they meet the request, so a repeated
    identifier multiplies one row, not its images.
    """
    counts = matched.groupBy("key_value").agg(
        F.count_if(~F.col("reject")).alias("accepted"), F.count_if("reject").alias("rejected"))
    return per_request(ids, counts).select(
        "pos", "key_value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "rejected")])


def rejection_reasons(matched: DataFrame) -> DataFrame:
    """Images per key and reason; spellings differing in case are one reason."""
    return (matched.where("reject").groupBy("key_value", F.lower("reason").alias("_folded"))
            .agg(F.min(F.struct(PATH, SOP, "reason"))["reason"].alias("reason"), F.count("*").alias("n"))
            .drop("_folded"))


def by_series(matched: DataFrame) -> DataFrame:
    """Images per key and series."""
    return matched.groupBy("key_value", SERIES).agg(
        F.count("*").alias("images"), F.count_if("reject").alias("rejected"))


def single_series(matched: DataFrame) -> DataFrame:
    """The one series of each key; null where a key has several."""
    return matched.groupBy("key_value").agg(F.min(SERIES).alias("_lo"), F.max(SERIES).alias("_hi")).select(
        "key_value", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(SERIES))


def dispatch(matched: DataFrame, directory: str, identifiable: bool, resolver: str = "study_series_sop") -> DataFrame:
    """A file record per accepted image: route, source path, output path."""
    out = paths.RESOLVERS[resolver](F.lit(identifiable))
    return matched.where(~F.col("reject")).select(
        "key_value",
        F.lit("ident" if identifiable else "anon").alias("route"),
        F.ltrim(F.col(PATH), F.lit("/\\")).alias("file_path"),
        F.lit(directory.rstrip("/\\")).alias("directory"),
        F.translate(out, "\\", "/").alias("output_path"),
    )


def collection_info(ids: DataFrame, matched: DataFrame) -> DataFrame:
    """One row per requested identifier: files sent, images and reasons rejected.

    Also for identifiers that match nothing.  The files themselves stay rows
    (:func:`dispatch`) and reasons stay rows (:func:`rejection_reasons`), since
    one key may own any number of them; :func:`collection_messages` packs both
    into records of bounded size.
    """
    by_reason = matched.groupBy("key_value", F.lower("reason").alias("_reason")).agg(F.count("*").alias("_n"))
    per_key = by_reason.groupBy("key_value").agg(
        F.sum(F.when(F.col("_reason").isNull(), F.col("_n"))).alias("dispatched"),
        F.sum(F.when(F.col("_reason").isNotNull(), F.col("_n"))).alias("rejected"),
        F.count("_reason").alias("reasons"))
    return per_request(ids, per_key).select(
        "pos", "key_value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dispatched", "rejected", "reasons")])


def collection_messages(ids: DataFrame, matched: DataFrame, files: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Collection records of about ``part_size`` files or reasons each.

    Part 0 exists for every requested identifier.  A key with more content gets
    more parts; content is spread over a key's parts by hash, so no task ever
    holds a whole key.  Pass a kept ``matched``: it is read more than once.
    """
    content = (files.select("key_value", F.col("output_path").alias("file"))
               .unionByName(rejection_reasons(matched), allowMissingColumns=True)
               .unionByName(ids.select("key_value", F.lit(True).alias("_head")).distinct(), allowMissingColumns=True))
    sizes = matched.groupBy("key_value").agg(F.ceil(F.count("*") / part_size).cast("int").alias("_parts"))
    # Content moves once: it lies by key for the sizes, the grouping and the request, but where a large key was split.
    part = F.when(F.col("_head"), 0).otherwise(F.pmod(F.xxhash64("file", "reason"), F.col("_parts")).cast("int"))
    whole = (content.join(join_side(sizes, "key_value"), "key_value", "left").withColumn("part", part)
             .where(F.col("part").isNotNull())
             .groupBy("key_value", "part")
             .agg(F.array_sort(F.collect_list("file")).alias("files"),
                  F.map_from_entries(F.filter(F.collect_list(F.struct("reason", "n")),
                                              lambda e: e["reason"].isNotNull())).alias("reasons")))
    return whole.join(ids.select(F.col("pos").alias("key_pos"), "key_value"), "key_value").select(
        "key_value", "key_pos", "part", "files", "reasons")


def chunk_ids(ids: DataFrame, size: int = MAX_IDS_PER_MESSAGE, order: str = "pos") -> DataFrame:
    """Identifiers packed in order, at most ``size`` per request."""
    if size <= 0:
        raise ValueError("max identifiers per message must be positive")
    placed = with_position(ids.select(F.col(order).alias("_order"), "key_value"), "_order", "key_value", name="_at")
    return (placed.groupBy(F.floor(F.col("_at") / size).alias("chunk"))
            .agg(F.array_sort(F.collect_list(F.struct("_at", "key_value"))).alias("_rows"))
            .select("chunk", F.transform("_rows", lambda r: r["key_value"]).alias("identifiers")))


def job_info(ids: DataFrame, key: str) -> DataFrame:
    """The record that opens a job; repeated identifiers count."""
    return ids.agg(F.count("*").alias("key_count")).select(F.lit(key).alias("key_tag"), "key_count")
