"""Dense positions and look-ahead without ordering a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from radloom.session import pin


def with_position(df: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """Add the 0-based rank of each row under a total order.

    Rows are range-partitioned and sorted, then numbered inside their partition.
    The numbered rows are pinned, because the numbering must not change between
    the pass that counts partitions and the pass that adds the offsets.  The
    table of offsets has one row per partition.
    """
    numbered = pin(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_row", 33))
        .withColumn("_local", F.col("_row") - F.shiftleft(F.col("_slice"), 33))
        .drop("_row")
    )
    sizes = numbered.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (numbered.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_base") + F.col("_local")).drop("_slice", "_local", "_base"))


def next_marked(df: DataFrame, key: str, order: str, marked: Column, buckets: int, name: str = "next") -> DataFrame:
    """For each row, the smallest ``order`` of a later marked row of its key.

    ``order`` holds whole numbers.  A key may own any share of the rows: each key
    is cut into ``buckets`` ranges of ``order``, look-ahead runs inside a range,
    and what crosses ranges is looked up among one row per key and range.
    """
    span = df.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if span.lo is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = (span.hi - span.lo) // buckets + 1
    cut = df.withColumn("_bucket", F.floor((F.col(order) - F.lit(span.lo)) / F.lit(width)))
    mark = F.when(marked, F.col(order))
    later = Window.partitionBy(key, "_bucket").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.min(mark).over(later))
    firsts = cut.groupBy(key, "_bucket").agg(F.min(mark).alias("_first"))
    after = Window.partitionBy(key).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    across = firsts.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"),
                           F.min("_first").over(after).alias("_across"))
    joined = inside.join(across, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(name, F.coalesce("_inside", "_across")).drop("_bucket", "_inside", "_key", "_b", "_across")
