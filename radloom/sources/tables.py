"""Table scans and strict record reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from radloom.functions.text import is_blank


def read_table(spark, name: str, **jdbc: str) -> DataFrame:
    """A Parquet folder, a catalog table, or a JDBC table when options are given."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_tagsets(spark, path: str) -> DataFrame:
    """Image records as JSON lines; the tag set stays the text it was."""
    from radloom.schemas import IMAGE_RECORD

    return spark.read.schema(IMAGE_RECORD).json(path)


def parse_strict(df: DataFrame, json: Column, schema: T.StructType, required: list[str]) -> DataFrame:
    """Parse records, naming what is wrong instead of guessing.

    Adds ``record`` and ``bad``: text that is no JSON object, members outside the
    schema, and required members that are missing are all errors.
    """
    known = F.array(*[F.lit(f.name) for f in schema])
    read = df.withColumn("_keys", F.json_object_keys(json)).withColumn("record", F.from_json(json, schema))
    unknown = F.array_sort(F.array_except("_keys", known))
    missing = F.array_compact(F.array(*[
        F.when(is_blank(F.col(f"record.{name}").cast("string")), F.lit(name)) for name in sorted(required)]))
    bad = (F.when(F.col("_keys").isNull(), F.lit("not a JSON object"))
           .when(F.size(unknown) > 0, F.concat(F.lit("unknown member: "), F.array_join(unknown, ",")))
           .when(F.size(missing) > 0, F.concat(F.lit("missing member: "), F.array_join(missing, ","))))
    return read.withColumn("bad", bad).drop("_keys")
