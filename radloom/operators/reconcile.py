"""Two tables that should agree: found by digests of buckets, looked at only where they differ.

Rows fall into buckets by the hash of their key.  A bucket's digest is a count, a sum and an exclusive or of row hashes, so it does not
depend on order, and digests of parts add up to those of the whole.  Equal roots end the comparison; else the buckets that
differ are found level by level, and only their rows are compared, exactly.  For tables kept in bucket folders
(:mod:`radloom.sources.sinks`), which are written once, a folder's digest is kept and not computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radloom.functions.joins import join_side
from radloom.sources import commits, sinks

KINDS = ("missing", "changed", "surplus")
#: Digests that one of the level above stands for.
FAN = 64
_DIGEST = "bucket int, rows long, total decimal(38,0), folded long"


def _row_hash(key: str, compared: list[str]) -> Column:
    # Nulls leave a hash as it is, so which columns are null is part of what is hashed.
    return F.xxhash64(key, *compared, F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in [key, *compared]]))


def bucket_digests(df: DataFrame, key: str, compared: list[str], buckets: int) -> DataFrame:
    """``bucket``, ``rows``, ``total`` and ``folded`` of every bucket that has rows with a key; one pass, combined before the shuffle."""
    hashed = commits.spread(df.where(F.col(key).isNotNull()), key, buckets, "bucket").select("bucket", _row_hash(key, compared).alias("h"))
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"),
                                        F.bit_xor("h").alias("folded"))


def _sum_up(digests: DataFrame, fan: int) -> DataFrame:
    return digests.groupBy(F.floor(F.col("bucket") / fan).cast("int").alias("bucket")).agg(
        F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("folded").alias("folded"))


def differing_buckets(left: DataFrame, right: DataFrame, buckets: int, fan: int = FAN) -> list[int]:
    """Buckets whose digests differ, from the root down: below equal digests nothing is looked at.  At most ``buckets``."""
    widths = [1]
    while widths[-1] < buckets:
        widths.append(widths[-1] * fan)
    parents: list[int] | None = None
    for width in reversed(widths):
        sides = [_sum_up(d, width) for d in (left, right)]
        if parents is not None:
            sides = [s.where(F.floor(F.col("bucket") / fan).isin(parents)) for s in sides]
        other = sides[1].select(F.col("bucket").alias("b"), *[F.col(c).alias(f"other_{c}") for c in ("rows", "total", "folded")])
        same = F.lit(True)
        for c in ("rows", "total", "folded"):
            same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
        met = sides[0].join(other, F.col("bucket") == F.col("b"), "full").where(~same)
        parents = sorted(r[0] for r in met.select(F.coalesce("bucket", "b")).collect())
        if not parents:
            return []
    return parents


def compare_rows(store: DataFrame, live: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``kind``, the key, and the ``stored`` and ``live`` row of every key on which the tables differ.

    ``missing`` rows are in the store only, ``surplus`` ones in the live table only, ``changed`` ones differ in a compared column.  Keys
    are unique on either side; rows without a key are not compared.
    """
    whole = lambda df, name: join_side(df.where(F.col(key).isNotNull()).select(F.col(key).alias(f"{name}_key"), F.struct(key, *compared).alias(name)), f"{name}_key")
    both = whole(store, "stored").join(whole(live, "live"), F.col("stored_key") == F.col("live_key"), "full")
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"stored.{c}").eqNullSafe(F.col(f"live.{c}"))
    kind = F.when(F.col("live_key").isNull(), KINDS[0]).when(F.col("stored_key").isNull(), KINDS[2]).when(~same, KINDS[1])
    return both.select(kind.alias("kind"), F.coalesce("stored_key", "live_key").alias(key), "stored", "live").where(F.col("kind").isNotNull())


def reconcile_changes(store: DataFrame, live: DataFrame, key: str, compared: list[str], buckets: int = 1024) -> DataFrame:
    """:func:`compare_rows` of two tables, of those buckets only whose digests differ; each table is read once for them."""
    wrong = differing_buckets(*(bucket_digests(df, key, compared, buckets) for df in (store, live)), buckets)
    few = [commits.spread(df, key, buckets, "_bucket").where(F.col("_bucket").isin(wrong)).drop("_bucket") if wrong else df.limit(0) for df in (store, live)]
    return compare_rows(*few, key, compared)


def folder_digests(spark: SparkSession, path: str, schema, key: str, compared: list[str]) -> DataFrame:
    """Digests of a bucketed table as its last commit has it; only folders that have none yet are read."""
    snap = commits.snapshot(spark, path)
    store = f"{path}/digests/{'-'.join([key, *compared])}"
    kept = spark.read.schema(f"folder string, {_DIGEST}").parquet(store) if commits.names(spark, store) else spark.createDataFrame([], f"folder string, {_DIGEST}")
    known = {r.folder for r in kept.select("folder").distinct().collect()}
    new = {b: f for b, f in snap.live.items() if f not in known}
    folder_of = lambda folders: spark.createDataFrame(sorted(folders.items()), "bucket int, folder string")
    if new:
        rows = spark.read.schema(schema).parquet(*new.values())
        found = bucket_digests(rows, key, compared, snap.count).join(folder_of(new), "bucket").select("folder", "bucket", "rows", "total", "folded")
        found.coalesce(1).write.mode("append").parquet(store)
        kept = spark.read.schema(f"folder string, {_DIGEST}").parquet(store)
    if not snap.live:
        return spark.createDataFrame([], _DIGEST)
    # Two comparisons at once may both have kept a folder's digest.
    return kept.join(folder_of(snap.live).select("folder"), "folder").select("bucket", "rows", "total", "folded").distinct()


def reconcile_tables(spark: SparkSession, store_path: str, live_path: str, schema, key: str, compared: list[str]) -> DataFrame:
    """:func:`compare_rows` of two bucketed tables; only the folders of differing buckets are opened, and folders not seen before."""
    sides = [commits.snapshot(spark, p) for p in (store_path, live_path)]
    counts = {s.count for s in sides if s.number}
    if len(counts) > 1:
        raise ValueError(f"the tables have {sorted(counts)} buckets")
    wrong = set(differing_buckets(*(folder_digests(spark, p, schema, key, compared) for p in (store_path, live_path)), max(counts, default=1)))
    return compare_rows(*(sinks.read_buckets(spark, p, schema, wrong, s) for p, s in zip((store_path, live_path), sides)), key, compared)


def bring_over(changes: DataFrame, load: Callable[[DataFrame], object]) -> DataFrame:
    """Hand the stored rows that are missing or changed to a load, and return the surplus, which a load does not remove."""
    load(changes.where(F.col("kind").isin(*KINDS[:2])).select("stored.*"))
    return changes.where(F.col("kind") == KINDS[2])
