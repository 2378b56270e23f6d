"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radloom.session import ensure_checkpoint_dir

#: The words of every contract here: runs of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as ``row`` beside derived columns, so that no input column can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, computed once however often (or in whatever lambda) ``body`` names it."""
    return F.transform(F.array(value), body)[0]
