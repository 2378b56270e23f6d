"""Requested files against the inventory of what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from radloom.functions.joins import unique_side


def plan_files(requests: DataFrame, inventory: DataFrame, identifiable_route: bool, path: str = "file_path") -> DataFrame:
    """Status each requested file starts with.

    ``identifiable_route`` says which kind this route serves; requests of the
    other kind are marked in ``bad``.  A missing file is a finished status, a
    present one is copied or goes on to be anonymised.
    """
    here = unique_side(inventory, path).withColumn("_here", F.lit(True))
    found = requests.join(here, path, "left")
    status = F.when(F.col("_here").isNull(), "FileMissing").otherwise("Copied" if identifiable_route else "Anonymised")
    wrong = F.col("identifiable") != F.lit(identifiable_route)
    return found.select(
        *requests.columns,
        F.when(wrong, F.lit("wrong route")).alias("bad"),
        F.when(~wrong, status).alias("status"),
        F.when(~wrong & F.col("_here").isNull(),
               F.concat(F.lit("Could not find '"), F.col(path), F.lit("'"))).alias("message"))
