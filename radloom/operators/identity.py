"""Patient identifiers: lookup, persistent surrogates, swapping in tag sets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.functions.tags import PATIENT_ID, entry_values
from radloom.functions.text import blank_to_null, is_blank
from radloom.session import pin


def require_unique(mapping: DataFrame, swap: str = "swap") -> DataFrame:
    """The mapping, if no identifier is in it twice; else an error that names some."""
    repeated = [r[0] for r in mapping.groupBy(swap).count().where("count > 1").select(swap).limit(5).collect()]
    if repeated:
        raise ValueError(f"the mapping holds identifiers more than once: {', '.join(map(str, repeated))}")
    return mapping


def swap_lookup(df: DataFrame, id_column: str, mapping: DataFrame, swap: str = "swap", replacement: str = "replacement") -> DataFrame:
    """Add ``replacement`` and ``fail_reason`` by looking identifiers up.

    The mapping is unique per identifier; see :func:`require_unique`.  A replacement that is null is no match.
    """
    lookup = mapping.select(F.col(swap).alias("_swap"), F.col(replacement).alias("replacement"))
    found = df.join(join_side(lookup, "_swap"), F.col(id_column) == F.col("_swap"), "left").drop("_swap")
    return found.withColumn("fail_reason", F.when(
        F.col("replacement").isNull(),
        F.concat(F.lit("No match found for '"), F.coalesce(F.col(id_column), F.lit("")), F.lit("'"))))


def hashed_surrogate(id_column: Column, salt: str) -> Column:
    """A surrogate two runs agree on without talking to each other."""
    digest = F.sha2(F.concat(F.lit(salt), id_column), 256)
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def allocate_surrogates(ids: DataFrame, id_column: str, known: DataFrame, max_length: int | None = None,
                        surrogate: Column | None = None, salt: str = "") -> DataFrame:
    """New surrogates for identifiers that have none: ``(swap, guid)`` rows.

    Append the result to the surrogate table before any of it is used.  The
    default surrogate is a salted digest, which stays the same when a lost task
    is recomputed; pass ``F.uuid()`` only with a pinned result.
    """
    new = ids.select(F.col(id_column).alias("swap")).where(~is_blank(F.col("swap"))).distinct()
    if max_length:
        new = new.where(F.length("swap") <= max_length)
    return (new.join(known.select(F.col("swap")), "swap", "left_anti")
            .withColumn("guid", surrogate if surrogate is not None else hashed_surrogate(F.col("swap"), salt)))


def too_long(id_column: Column, max_length: int) -> Column:
    """Reason an identifier is too long for the surrogate table, or null."""
    return F.when(F.length(id_column) > max_length, F.concat(
        F.lit("Supplied value was too long ("), F.length(id_column).cast("string"),
        F.lit(f") - max allowed is ({max_length})")))


def swap_with_fallback(df: DataFrame, id_column: str, mapping: DataFrame, surrogates: DataFrame) -> DataFrame:
    """Look up, and use the surrogate where the mapping has nothing usable.

    Both tables are unique per identifier, so they are joined to each other
    first and the rows make one trip.
    """
    both = mapping.select("swap", "replacement").join(surrogates.select("swap", "guid"), "swap", "full") \
                  .select("swap", F.coalesce(blank_to_null(F.col("replacement")), F.col("guid")).alias("replacement"))
    return swap_lookup(df, id_column, both)


PATIENT_ID_PROBLEMS = ("Dataset did not contain PatientID", "PatientID was blank", "multiple values for PatientID")


def with_patient_id(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Add ``pid``, the one patient identifier of a tag map, and ``pid_problem``.

    Blank values are ignored; equal values count once; different ones are an
    error.
    """
    missing, blank, several = PATIENT_ID_PROBLEMS
    present = F.coalesce(F.array_contains(F.map_keys(tags), PATIENT_ID), F.lit(False))
    # Step by step, so that each step is computed once per row.
    read = df.withColumn("_entry", F.try_element_at(F.col(tags), F.lit(PATIENT_ID))).withColumn(
        "_values", F.array_distinct(F.filter(entry_values(F.col("_entry")), lambda v: ~is_blank(v))))
    count = F.coalesce(F.size("_values"), F.lit(0))
    problem = F.when(~present, missing).when(count <= 0, blank).when(count > 1, several)
    return (read.withColumn("pid", F.when(count == 1, F.try_element_at("_values", F.lit(1))))
            .withColumn("pid_problem", problem).drop("_entry", "_values"))


def swap_patient_id(df: DataFrame, mapping: DataFrame, surrogates: DataFrame | None = None, tags: str = "tags") -> DataFrame:
    """Replace the patient identifier inside tag maps.

    Adds ``fail_reason``; a failed row keeps its tags and must not be passed on.
    """
    found = with_patient_id(df, tags)
    swapped = (swap_with_fallback(found, "pid", mapping, surrogates) if surrogates is not None
               else swap_lookup(found, "pid", mapping))
    ok = F.col("pid_problem").isNull() & F.col("replacement").isNotNull()
    renamed = F.transform_values(F.col(tags), lambda tag, e: F.when(
        tag == PATIENT_ID, F.struct(e["vr"].alias("vr"), F.col("replacement").alias("val"))).otherwise(e))
    return (swapped.withColumn("fail_reason", F.coalesce("pid_problem", "fail_reason"))
            .withColumn(tags, F.when(ok, renamed).otherwise(F.col(tags)))
            .drop("pid", "pid_problem", "replacement"))


class Swapper(Protocol):
    """Adds ``replacement`` and ``fail_reason`` for an identifier column."""

    def swap(self, df: DataFrame, id_column: str) -> DataFrame: ...


@dataclass(frozen=True)
class LookupSwapper:
    mapping: DataFrame

    def swap(self, df: DataFrame, id_column: str) -> DataFrame:
        return swap_lookup(df, id_column, self.mapping)


@dataclass(frozen=True)
class SurrogateSwapper:
    """Every identifier gets its surrogate; new ones are stored before use.

    ``stored`` reads the surrogate table, ``append`` adds rows to it.
    """

    stored: Callable[[], DataFrame]
    append: Callable[[DataFrame], None]
    max_length: int | None = None
    salt: str = ""

    def table(self, df: DataFrame, id_column: str) -> DataFrame:
        """The surrogate table after allocation for ``df``."""
        new = allocate_surrogates(df, id_column, self.stored(), self.max_length, salt=self.salt)
        self.append(pin(new))
        return self.stored()

    def swap(self, df: DataFrame, id_column: str) -> DataFrame:
        mapping = self.table(df, id_column).select("swap", F.col("guid").alias("replacement"))
        swapped = swap_lookup(df, id_column, mapping)
        if not self.max_length:
            return swapped
        return swapped.withColumn("fail_reason", F.coalesce(too_long(F.col(id_column), self.max_length), "fail_reason"))


@dataclass(frozen=True)
class FallbackSwapper:
    """The mapping where it has a value, else a stored surrogate."""

    mapping: DataFrame
    fallback: SurrogateSwapper

    def swap(self, df: DataFrame, id_column: str) -> DataFrame:
        unmapped = swap_lookup(df.select(id_column).distinct(), id_column, self.mapping) \
            .where(is_blank(F.col("replacement"))).select(id_column)
        return swap_with_fallback(df, id_column, self.mapping, self.fallback.table(unmapped, id_column))


def swap_stats(swapped: DataFrame, id_column: str, max_length: int | None = None) -> DataFrame:
    """Rows per outcome: success, fail or invalid."""
    invalid = is_blank(F.col(id_column))
    if max_length:
        invalid = invalid | (F.length(id_column) > max_length)
    outcome = F.when(invalid, "invalid").when(F.col("replacement").isNull(), "fail").otherwise("success")
    return swapped.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
