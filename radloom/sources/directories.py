"""Work-item discovery: which directories of an archive are to be read.

Inputs are file listings (one row per file) or directory listings; a listing
never needs the files' content.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions import paths
from radloom.functions.joins import join_side, without

# --- fixed values: directory levels of a dated archive ------------------------
DAY_LEVEL = r"20\d{2}[\\/]\d{2}[\\/]\d{2}([\\/]|$)"
# A day level ends its folder (or stands before a backslash in it); one more folder follows.
FIRST_ITEM = r"(?s)^(.*?20\d{2}[\\/]\d{2}[\\/]\d{2}(?:\\[^/]*|\r\n|[\n\r\x{85}\x{2028}\x{2029}])?/[^/]*)"
ACCESSION_LEVEL = r"20\d{2}[\\/]\d{2}[\\/]\d{2}[\\/][a-zA-Z0-9._-]+[\\/]$"


def list_files(spark, root: str | list[str], pattern: str | None = None) -> DataFrame:
    """File listing below ``root``: path, size and modification time only.

    Spark lists several roots (days, say) as a job on the executors once there are more
    than ``spark.sql.sources.parallelPartitionDiscovery.threshold``, but the driver
    holds the whole listing; from some ten million files on read an inventory table of the store instead.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), "modificationTime")


def _dirs_holding(files: DataFrame, keep: Column) -> DataFrame:
    return files.where(keep).select(paths.parent_dir(F.col("path")).alias("dir")).distinct()


def find_dirs(files: DataFrame, pattern: str = "*.dcm") -> DataFrame:
    """Shallowest directories holding a matching file.

    Once a directory qualifies, nothing below it is a work item of its own.
    """
    holding = _dirs_holding(files, paths.like_glob(paths.file_name(F.col("path")), pattern))
    # Only the set of qualifying directories is compared, never the files, and
    # all uses of the set share one shuffle of it.
    shadowed = (
        holding.select("dir", F.explode(paths.ancestors(F.col("dir"))).alias("above"))
        .join(join_side(holding.select(F.col("dir").alias("above")), "above"), "above")
        .select("dir").distinct()
    )
    return without(holding, shadowed, "dir")


def find_dirs_pacs(dirs: DataFrame, root: str) -> DataFrame:
    """Directories directly under the day level, with or without files in them.

    A root that already is an accession directory is the only work item.  A
    directory counts when its parent is the first on its path to match the day
    level, because nothing below a work item is visited.
    """
    if re.search(ACCESSION_LEVEL, root):
        return dirs.sparkSession.createDataFrame([(root.strip("/\\"),)], "dir string")
    full = F.trim(F.col("dir"), F.lit("/"))
    if not root.strip("/"):
        # Without a root's depth to count one search does: the first day level that a folder below it ends, and that folder.
        found = F.regexp_extract(full, FIRST_ITEM, 1)
        below = dirs.where(paths.below_root(F.col("dir"), root)) if root else dirs
        return below.select(found.alias("dir")).where(F.col("dir") != "").distinct()
    above = paths.ancestors(full)
    # The root itself may lie below a day level; then its children are the items.
    root_depth = len([p for p in root.strip("/").split("/") if p])
    visited = F.filter(above, lambda a: F.size(F.split(a, "/")) >= max(root_depth, 1)) if root_depth else above
    first_day = F.try_element_at(F.filter(visited, lambda a: a.rlike(DAY_LEVEL)), F.lit(1))
    depth = F.size(F.split(full, "/"))
    item = F.array_join(F.slice(F.split(full, "/"), 1, F.size(F.split(first_day, "/")) + 1), "/")
    below = dirs.where(paths.below_root(F.col("dir"), root)) if root else dirs
    return (below.withColumn("_item", F.when(first_day.isNotNull() & (depth > F.size(F.split(first_day, "/"))), item))
            .where(F.col("_item").isNotNull()).select(F.col("_item").alias("dir")).distinct())


def list_dirs(lines: DataFrame, files: DataFrame, pattern: str = "*.dcm") -> DataFrame:
    """Listed accession directories that exist and hold a matching file.

    ``lines`` has one text column ``value``; commas are removed, and a line must
    end in a separator right below the day level.  Repeated lines stay repeated.
    """
    wanted = lines.select(F.replace(F.col("value"), F.lit(","), F.lit("")).alias("listed")) \
                  .where(F.col("listed").rlike(ACCESSION_LEVEL)) \
                  .select(F.rtrim(F.col("listed"), F.lit("/\\")).alias("dir"))
    holding = _dirs_holding(files, paths.like_glob(paths.file_name(F.col("path")), pattern))
    return wanted.join(join_side(holding, "dir"), "dir", "left_semi")


def rejected_lines(lines: DataFrame, files: DataFrame, pattern: str = "*.dcm") -> DataFrame:
    """The listed lines :func:`list_dirs` skips, each with its reason."""
    clean = lines.select(F.replace(F.col("value"), F.lit(","), F.lit("")).alias("listed"))
    shaped = F.coalesce(F.col("listed").rlike(ACCESSION_LEVEL), F.lit(False))
    malformed = clean.where(~shaped).select("listed", F.lit("not an accession directory").alias("reason"))
    holding = _dirs_holding(files, paths.like_glob(paths.file_name(F.col("path")), pattern))
    empty = (clean.where(shaped).withColumn("dir", F.rtrim(F.col("listed"), F.lit("/\\")))
             .join(join_side(holding, "dir"), "dir", "left_anti")
             .select("listed", F.lit("missing or without matching files").alias("reason")))
    return malformed.unionByName(empty)


def find_dirs_zips(files: DataFrame) -> DataFrame:
    """Every directory, at every depth, holding an image file or an archive."""
    ext = paths.extension(F.col("path"))
    return _dirs_holding(files, ext.isin(".dcm", *paths.ARCHIVE_EXTS))
