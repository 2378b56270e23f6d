"""Join sides for lookups against keys that may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_side(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows as a join side with a shuffle of its own.

    Adaptive execution splits a skewed side only when both sides come straight
    out of a shuffle.  A side that was grouped by the join key would be reused as
    it is, and a frequent key on the other side would then stay in one task.
    Passing the key through an expression ends the reuse; the side is shuffled
    again, which costs little after grouping and nothing when it is broadcast.
    """
    return df.select(*[F.greatest(c, c).alias(c) if c in keys else F.col(c) for c in df.columns])


def unique_side(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys of ``df`` as a join side."""
    return join_side(df.select(*keys).distinct(), *keys)


def within(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among distinct ``members``.

    For a ``df`` that was grouped and is read more than once: a semi join would
    be pushed below the grouping, and each reader would then group anew.
    """
    return df.join(join_side(members.select(key), key), key).select(*df.columns)


def without(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among distinct ``members``; see :func:`within`."""
    marked = join_side(members.select(key), key).withColumn("_member", F.lit(True))
    return df.join(marked, key, "left").where(F.col("_member").isNull()).select(*df.columns)
