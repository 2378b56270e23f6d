"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document gets a 60-bit hash of its id.  A source that is to give more
words than it has repeats all its documents (``base`` whole passes); of the rest
it takes the documents whose hash is below a threshold.  To find a source's
threshold, words are summed by leading hash bits; the bucket in which the budget
ends is the only one looked into further, with the next bits, until it holds one
hash value.  A larger budget gives a higher threshold, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from radloom.functions.joins import join_side
from radloom.functions.ordering import with_position
from radloom.llm.common import packed, stored, word_count

HASH_BITS = 60
#: Hash bits per histogram: a source has 4,096 buckets at most in each.
STEP_BITS = 12


def mixing_hash(key: Column) -> Column:
    """60 bits of the key's MD5; rows of one key (and all null keys) are taken alike."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source of ``sizes(source, size)``: source_size and target.

    Weights go round by the code-point order of the sources, null last.  The
    targets are ``min(cap * source_size, level * weight)`` with the level at which
    they sum to ``share`` of all sizes; it is raised until it no longer moves,
    each time by one aggregate over the sources.
    """
    ranked = stored(with_position(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").isNull(), F.col("source"))
        .withColumn("weight", F.get(F.array(*map(F.lit, map(float, weights))), F.col("pos").cast("int") % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(float(cap))))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, None
    while True:
        closed = F.col("cap") < F.lit(level) * F.col("weight")
        now = ranked.agg(F.count_if(closed), F.sum(F.when(closed, F.col("cap"))), F.sum(F.when(~closed, F.col("weight")))).first()
        if now[0] == full or not now[2]:
            break
        full, level = now[0], (share * total - (now[1] or 0.0)) / now[2]
    return ranked.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source of ``docs(source, size, hash)``: source_size, target, base and threshold.

    ``docs`` should be stored, since it is read once per histogram.  An empty
    table gives an empty plan; a source without words has target 0 and takes nothing.
    The boundary hash is taken if that brings the source nearer to its target.
    """
    targets = source_targets(docs, weights, share, cap)
    base = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(cap)))).otherwise(F.lit(0)).cast("long")
    state = stored(targets.withColumn("base", base).select(
        "*", (F.col("target") - F.col("base") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"),
        F.when((F.col("source_size") == 0) | (F.col("base") >= int(cap)), F.lit(0)).cast("long").alias("threshold")))
    for used in range(0, HASH_BITS, STEP_BITS):
        rest = HASH_BITS - used - STEP_BITS
        open_ = join_side(state.where("threshold is null").select(F.col("source").alias("of"), "left", "prefix"), "of")
        histogram = (docs.join(open_, docs["source"].eqNullSafe(open_["of"]))
                     .where(F.shiftright("hash", rest + STEP_BITS) == F.col("prefix"))
                     .groupBy("source", "left", F.shiftright("hash", rest).alias("bucket"))
                     .agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi")))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = (histogram.withColumn("upto", F.sum("words").over(upto))
                .where((F.col("upto") - F.col("words") <= F.col("left")) & (F.col("upto") > F.col("left")))
                .select(F.col("source").alias("of"), "bucket", "lo", "hi", "words",
                        (F.col("left") - F.col("upto") + F.col("words")).alias("inside")))
        single = F.col("lo") == F.col("hi")
        found = F.when(single, F.when(F.col("inside") * 2 > F.col("words"), F.col("hi") + 1).otherwise(F.col("lo")))
        state = stored(state.join(join_side(edge, "of"), F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "base", F.coalesce("inside", "left").alias("left"),
            F.coalesce("bucket", "prefix").alias("prefix"), F.coalesce("threshold", found).alias("threshold")))
        if state.where("threshold is null").isEmpty():
            break
    return state.select("source", "source_size", "target", "base", "threshold")


def apply_mix(df: DataFrame, plan: DataFrame, source: str = "source", key: str = "doc_id") -> DataFrame:
    """``row`` (the input row), source_size, target and ``copies``: how often the mix takes it, 0 to the cap."""
    side = join_side(plan.withColumnRenamed("source", "of"), "of")
    rows = packed(df, source=F.col(source), hash=mixing_hash(F.col(key)))
    return rows.join(side, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "source_size", "target", (F.col("base") + (F.col("hash") < F.col("threshold")).cast("long")).alias("copies"))


def sized(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The narrow table that :func:`plan_mix` reads, with the key; null texts have no words."""
    return df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), mixing_hash(F.col(key)).alias("hash"))
