"""A secondary index over the files of a catalogue: which of them can hold an identifier.

For every file and bucket of an identifier's hash the index holds a Bloom filter of the file's identifiers in that bucket,
as a bitmap of 32,768 bits.  A file is indexed when it has been written and never again, so a load adds the rows of its own files.
Looking up a set of identifiers reads only the rows of their buckets and gives the files that can hold one; a file the index does not
know is always among them.  Filters never miss, so a catalogue cut down to those files answers the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radloom.functions.joins import join_side
from radloom.session import kept
from radloom.sources.commits import names

#: Bits of a filter, which is what one bitmap of Spark's holds, and places set for each identifier.
BITS = 32_768
PLACES = 6
#: Identifiers for which a filter of that size is wrong about once in 250 times.
PER_FILTER = 3_000
#: Identifiers that are tested against a filter together.
LIST = 500
_SCHEMA = "column string, bucket int, file string, keys long, filter binary"


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _places(value: Column) -> Column:
    """The places an identifier sets, by two hashes."""
    first, second = (F.shiftright(F.xxhash64(value, F.lit(n)), 8) for n in (1, 2))
    return F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.pmod(first + i * second, F.lit(BITS)).cast("int"))


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


def file_rows(rows: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """The index rows of the files that ``rows`` is read from, for text columns; null identifiers are in no filter."""
    # Values travel with their column's number and 128 bits of their file's path, which is longer than they are.
    path, sides = F.col("_metadata.file_path"), ["_a", "_b"]
    file = [F.xxhash64(path, F.lit(n)).alias(c) for n, c in enumerate(sides)]
    named = rows.select(path.alias("path"), *file).distinct().select(*sides, _plain_column(F.col("path")).alias("file"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("at"), F.col(f"`{c}`").cast("string").alias("value")) for n, c in enumerate(columns)]))
    held = rows.select(*file, pairs.alias("pair")).where(F.col("pair.value").isNotNull()).select(*sides, "pair.at", "pair.value").distinct()
    filter_of = ["at", "bucket", *sides]
    placed = held.select("at", _bucket(F.col("value"), buckets).alias("bucket"), *sides, F.explode(_places(F.col("value"))).alias("place"))
    # Words of 64 places are OR-ed, in the order of the bitmap's bytes, so a task holds at most 512 numbers a filter and sorts no places.
    place, byte = F.col("place"), F.floor((F.col("place") % 64) / 8)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), ((7 - byte) * 8 + place % 8).cast("int"))
    words = placed.select(*filter_of, F.floor(place / 64).cast("int").alias("word"), bit.alias("bit")).groupBy(*filter_of, "word").agg(
        F.count("*").alias("n"), F.bit_or("bit").alias("bits"))
    texts = words.groupBy(*filter_of).agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("word", F.lpad(F.hex("bits"), 16, "0")))).alias("texts"))
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), lambda w: F.coalesce(F.try_element_at("texts", w), F.lit("0" * 16))), "")
    filters = texts.select(*filter_of, (F.col("n") / PLACES).cast("long").alias("keys"), F.unhex(whole).alias("filter"))
    column = F.element_at(F.array(*map(F.lit, columns)), F.col("at") + 1)
    return filters.join(named, sides).select(column.alias("column"), "bucket", "file", "keys", "filter")


def _meta(spark: SparkSession, path: str) -> int | None:
    found = [n for n in names(spark, path) if n.startswith("buckets=")]
    return int(found[0].partition("=")[2]) if found else None


def add_files(spark: SparkSession, path: str, files: Iterable[str], schema, columns: list[str], buckets: int) -> list[str]:
    """Index those Parquet files that the index at ``path`` does not hold yet, in one pass over the named columns; returns them.

    An index has one number of buckets for life.  About ``PER_FILTER`` identifiers a file and bucket keep the filters sharp.
    """
    known = _meta(spark, path)
    if known is not None and known != buckets:
        raise ValueError(f"the index has {known} buckets, not {buckets}")
    asked = _plain(spark, files)
    new = asked if known is None else [r.file for r in _frame(spark, asked).join(join_side(indexed_files(spark, path), "file"), "file", "left_anti").collect()]
    if new:
        rows = spark.read.schema(schema).parquet(*new).select(*columns, "_metadata")
        # A file without identifiers gets one row, so that it counts as indexed; sorted rows let a lookup skip row groups by bucket.
        empty = _frame(spark, new).select(F.lit("").alias("column"), F.lit(-1).alias("bucket"), "file", F.lit(0).cast("long").alias("keys"), F.lit(None).cast("binary").alias("filter"))
        (file_rows(rows, columns, buckets).unionByName(empty).repartitionByRange("column", "bucket").sortWithinPartitions("column", "bucket")
         .write.mode("append").option("parquet.block.size", 16 * 1024 * 1024).parquet(f"{path}/buckets={buckets}"))
    return new


def _plain(spark: SparkSession, files: Iterable[str]) -> list[str]:
    """Paths that readers take, from URIs as ``DataFrame.inputFiles`` gives them."""
    jvm = spark.sparkContext._jvm
    return sorted({jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in files})


def _plain_column(uri: Column) -> Column:
    """The same of a column of URIs."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _frame(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame([(f,) for f in files], "file string")


def _read(spark: SparkSession, path: str) -> DataFrame:
    buckets = _meta(spark, path)
    return spark.read.schema(_SCHEMA).parquet(f"{path}/buckets={buckets}") if buckets is not None else spark.createDataFrame([], _SCHEMA)


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of every file the index holds."""
    return _read(spark, path).where("column = ''").select("file").distinct()


def candidate_files(ids: DataFrame, value: str, path: str, column: str, files: Iterable[str]) -> list[str]:
    """Those of ``files`` that may hold one of the identifiers in ``column``, in order; unknown files are always among them.

    ``files`` are the catalogue's live files, as its reader lists them; files that are gone are forgotten by leaving them out.
    """
    spark = ids.sparkSession
    live = _frame(spark, _plain(spark, files))
    buckets = _meta(spark, path)
    if buckets is None:
        return sorted(r.file for r in live.collect())
    wanted = kept(ids.select(F.col(value).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct().select(
        _bucket(F.col("value"), buckets).alias("b"), "value"))
    # Identifiers of a bucket are tested together, in lists of about LIST, so a row of the index meets few rows; places, which are longer, are made there.
    lists = -(-wanted.count() // (LIST * buckets)) or 1
    grouped = wanted.groupBy("b", F.pmod(F.xxhash64("value", F.lit(3)), F.lit(lists)).alias("n")).agg(F.collect_list("value").alias("asked_values"))
    # At most as many as there are buckets; they let the scan of the index skip the others' rows.
    asked = [r.b for r in wanted.select("b").distinct().collect()]
    index = _read(spark, path)
    met = index.where((F.col("column") == column) & F.col("bucket").isin(asked)).join(grouped, F.col("bucket") == F.col("b")).where(
        F.exists("asked_values", lambda v: F.forall(_places(v), lambda p: _is_set(F.col("filter"), p)))).select("file").distinct()
    unknown = live.join(join_side(indexed_files(spark, path), "file"), "file", "left_anti")
    return sorted(r.file for r in live.join(join_side(met, "file"), "file", "left_semi").unionByName(unknown).distinct().collect())


def cut_down(catalogue: DataFrame, ids: DataFrame, value: str, path: str, column: str) -> DataFrame:
    """A catalogue of Parquet files with only those files that can hold one of the identifiers in ``column``.

    Whatever is asked of these identifiers has the same answer; other rows may be missing.
    """
    found = candidate_files(ids, value, path, column, catalogue.inputFiles())
    spark = catalogue.sparkSession
    return spark.read.schema(catalogue.schema).parquet(*found) if found else spark.createDataFrame([], catalogue.schema)
