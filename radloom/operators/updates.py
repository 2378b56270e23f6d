"""Mapping changes: find them, resolve their order, apply them everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import join_side
from radloom.functions.ordering import next_marked
from radloom.functions.text import blank_to_null
from radloom.operators.validate import UpdateSpec
from radloom.session import pin


def latest_archive(archive: DataFrame, swap: str = "swap", replacement: str = "replacement",
                   valid_from: str = "valid_from") -> DataFrame:
    """The newest archived row per identifier: ``(swap, old)``.

    ``old`` may be null; the row then still says that there was one.
    """
    # Of several rows of one time the greatest value counts, so that reruns agree.
    newest = F.max_by(F.struct(F.col(replacement).alias("old")), F.struct(F.col(valid_from), F.col(replacement)))
    return archive.groupBy(F.col(swap).alias("swap")).agg(newest.alias("_newest")).select("swap", "_newest.old")


def detect_updates(current: DataFrame, archive: DataFrame | None, surrogates: DataFrame | None, since: Column,
                   swap: str = "swap", replacement: str = "replacement", valid_from: str = "valid_from") -> DataFrame:
    """Old and new replacement of every identifier mapped since a date.

    Step 1 replaces the newest archived value, step 2 a surrogate handed out
    earlier; both may hold for one identifier, in this order.  Identifiers with
    neither are brand new and need no update.
    """
    if archive is None:
        raise ValueError("no archive table exists for the mapping table")
    changed = current.where(F.col(valid_from) >= since).select(
        F.col(swap).alias("swap"), blank_to_null(F.col(replacement)).alias("want"))
    old = latest_archive(archive, swap, replacement, valid_from)
    updates = changed.join(old, "swap").select(
        "swap", F.lit(1).alias("step"), blank_to_null(F.col("old")).alias("have"), "want")
    if surrogates is not None:
        temporary = changed.join(surrogates.select(F.col(swap).alias("swap"), "guid"), "swap").select(
            "swap", F.lit(2).alias("step"), blank_to_null(F.col("guid")).alias("have"), "want")
        updates = updates.unionByName(temporary)
    return updates


def where_expr(spec: UpdateSpec) -> Column:
    """The condition of an update; comparing with null matches nothing."""
    spec.validate()
    compare = {
        "=": lambda c, v: c == v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "is": lambda c, v: c.eqNullSafe(v), "is not": lambda c, v: ~c.eqNullSafe(v),
    }
    condition = F.lit(True)
    for at, (name, value) in enumerate(zip(spec.where_fields, spec.have_values)):
        op = ((spec.operators or [])[at:at + 1] or ["="])[0] or "="
        value = None if isinstance(value, str) and not value.strip() else value
        if op.lower() == "like":
            term = F.col(name).like(value) if value is not None else F.lit(None).cast("boolean")
        else:
            term = compare[op.lower()](F.col(name), F.lit(value))
        condition = condition & term
    return F.coalesce(condition, F.lit(False))


def tables_for(tables: dict[str, DataFrame], spec: UpdateSpec, views: tuple[str, ...] = (),
               configured: tuple[str, ...] = ()) -> list[str]:
    """Names of the tables an update goes to.

    An explicit list wins, then the configured subset; either way a table must
    have every named column, unless it was listed explicitly.
    """
    if spec.tables:
        unknown = [t for t in spec.tables if t not in tables]
        if unknown:
            raise ValueError(f"could not find tables {','.join(unknown)}")
        return [t for t in spec.tables if t not in views]
    fields = {*spec.where_fields, *spec.write_fields}
    found = [n for n, df in tables.items() if (not configured or n in configured) and fields <= set(df.columns)]
    if not found:
        raise ValueError(f"could not find any tables with the fields {sorted(fields)}")
    return [n for n in found if n not in views]


def update_table(df: DataFrame, spec: UpdateSpec) -> DataFrame:
    """The table after an update."""
    missing = {*spec.where_fields, *spec.write_fields} - set(df.columns)
    if missing:
        raise ValueError(f"table has no column {sorted(missing)[0]}")
    hit, written = where_expr(spec), dict(zip(spec.write_fields, spec.values))
    blank = lambda v: None if isinstance(v, str) and not v.strip() else v
    return df.select(*[
        F.when(hit, F.lit(blank(written[c])).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in written else F.col(c) for c in df.columns])


def apply_updates(tables: dict[str, DataFrame], spec: UpdateSpec, views: tuple[str, ...] = (),
                  configured: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Every affected table after the update; the others are left out."""
    return {name: update_table(tables[name], spec) for name in tables_for(tables, spec, views, configured)}


def affected_rows(tables: dict[str, DataFrame], spec: UpdateSpec, views: tuple[str, ...] = (),
                  configured: tuple[str, ...] = ()) -> DataFrame:
    """Rows each table's update touches: ``(table, affected)``."""
    counts = None
    for name in tables_for(tables, spec, views, configured):
        one = tables[name].agg(F.count_if(where_expr(spec)).alias("affected")).select(F.lit(name).alias("table"), "affected")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def resolve_chain(pairs: DataFrame, seq: str = "seq", have: str = "have", want: str = "want", buckets: int = 1024) -> DataFrame:
    """What each old value ends up as after all updates in order, and in how many steps.

    ``pairs`` are ordered by the whole number ``seq``, unique per pair.  A value
    leaves at its first pair, arrives somewhere, and leaves from there at the
    first later pair.  The step after each pair is looked up once; paths are then
    followed by doubling, so a path of n steps takes log2(n) joins.
    """
    # "= null" matches nothing, so a pair from null never applies.
    steps = pairs.where(F.col(have).isNotNull()).select(
        F.col(seq).alias("seq"), F.col(have).alias("have"), F.col(want).alias("want"))
    moves = steps.select(F.col("have").alias("value"), "seq", F.lit(True).alias("leaves")).unionByName(
        steps.where(F.col("want").isNotNull()).select(F.col("want").alias("value"), "seq", F.lit(False).alias("leaves")))
    # A pair that leaves and arrives at one value has both events at one seq; the
    # departure must be later than the arrival, so order alone decides.
    ahead = next_marked(_merged_moves(moves), "value", "seq", F.col("leaves"), buckets)
    arrivals = ahead.where("arrives").select("seq", F.col("next").cast("long").alias("next"))
    state = pin(steps.join(arrivals, "seq", "left").select("seq", "have", F.col("want").alias("final"), "next", F.lit(1).cast("long").alias("steps")))
    ended = []
    while True:
        # Only open paths are joined on; finished ones are set apart as they are.
        ended.append(state.where(F.col("next").isNull()))
        open_ = state.where(F.col("next").isNotNull())
        if open_.isEmpty():
            break
        onward = reduce(DataFrame.unionByName, ended + [open_]).select(
            F.col("seq").alias("next"), F.col("final").alias("_final"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        state = pin(open_.join(join_side(onward, "next"), "next").select(
            "seq", "have", F.col("_final").alias("final"), F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps")))
    first = reduce(DataFrame.unionByName, ended).groupBy("have").agg(F.min_by(F.struct("final", "steps"), "seq").alias("_f"))
    return first.select("have", "_f.final", "_f.steps")


def _merged_moves(moves: DataFrame) -> DataFrame:
    """One row per value and seq, so look-ahead sees strictly later rows."""
    return moves.groupBy("value", "seq").agg(F.bool_or("leaves").alias("leaves"), F.bool_or(~F.col("leaves")).alias("arrives"))


def apply_chain(df: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """A table column after all updates; untouched values stay."""
    final = resolved.select(F.col("have").alias("_have"), F.col("final").alias("_final"), F.lit(True).alias("_hit"))
    joined = df.join(join_side(final, "_have"), F.col(column) == F.col("_have"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.col("_final")).otherwise(F.col(c)).alias(c) if c == column else F.col(c)
                           for c in df.columns])


def update_audit(tables: dict[str, DataFrame], column: str, pairs: DataFrame) -> DataFrame:
    """Per table: updates sent, and rows affected by them in their order, summed.

    A row that one update brings to the old value of a later one is affected by
    both.  Counts are taken per value before the join, so a frequent value is one row.
    """
    sent = pairs.where(F.col("have").isNotNull()).count()
    moved = pin(resolve_chain(pairs).select("have", "steps"))
    result = None
    for name, df in tables.items():
        held = df.groupBy(F.col(column).alias("have")).agg(F.count("*").alias("_n"))
        one = held.join(join_side(moved, "have"), "have").agg(F.coalesce(F.sum(F.col("_n") * F.col("steps")), F.lit(0)).alias("affected"))
        one = one.select(F.lit(name).alias("table"), F.lit(sent).cast("long").alias("queries"), "affected")
        result = one if result is None else result.unionByName(one)
    return result
