"""Cohort lists: one column of identifiers under the name of its key."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, functions as F

from radloom.schemas import EXTRACTION_KEYS


class CohortFormatError(ValueError):
    """The cohort list breaks a rule of its format."""


def parse_cohort(lines: DataFrame, text: str = "value") -> DataFrame:
    """Identifiers of a cohort list's data lines.

    Values are trimmed and blanks dropped; repeated identifiers are kept.  A line
    with more than one field is marked in ``bad`` rather than dropped.
    """
    fields = F.from_csv(F.col(text), "id string, extra string", {"quote": '"', "mode": "PERMISSIVE"})
    parsed = lines.withColumn("_f", fields)
    # A separator outside quotes makes a second field, even an empty one.
    unquoted = F.regexp_replace(F.col(text), r'"([^"]|"")*"', "")
    return (parsed.withColumn("key_value", F.trim(F.col("_f.id")))
            .withColumn("bad", unquoted.contains(","))
            .where((F.length("key_value") > 0) | F.col("bad")).drop("_f"))


def read_cohort(spark, path: str) -> tuple[str, DataFrame]:
    """Read a cohort file: its key name and ``(pos, key_value)`` rows."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    header_row = lines.where(F.length(F.trim("value")) > 0).orderBy("pos").first()
    if header_row is None:
        raise CohortFormatError("CSV is empty")
    header = next(csv.reader([header_row["value"]]))
    if len(header) != 1:
        raise CohortFormatError("CSV must have exactly 1 column")
    key = header[0].strip()
    if key not in EXTRACTION_KEYS:
        raise CohortFormatError(f"CSV header must be a valid ExtractionKey: {','.join(EXTRACTION_KEYS)}")
    ids = parse_cohort(lines.where(F.col("pos") > header_row["pos"]))
    if not ids.where("bad").isEmpty():
        raise CohortFormatError("CSV must have exactly 1 column")
    if ids.isEmpty():
        raise CohortFormatError("No records in the cohort CSV")
    return key, ids.select("pos", "key_value")
