"""Writers: the document store, series table, versioned tables, job reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from radloom.operators.load import Merge, modality_group
from radloom.operators.validate import guard_size
from radloom.session import pin
from radloom.sources import commits
from radloom.sources.commits import hadoop_path as _hadoop_path


def write_images(df: DataFrame, path: str, modality: str = "Modality") -> DataFrame:
    """Append image documents, one folder per modality group.

    Returns the documents over the size limit; those are not written.
    """
    sized = guard_size(df)
    (sized.where(~F.col("too_large")).drop("too_large")
     .withColumn("modality_group", modality_group(F.col(modality)))
     .write.partitionBy("modality_group").mode("append").parquet(path))
    return sized.where("too_large").drop("too_large")


def write_series(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_version(df: DataFrame, path: str) -> str:
    """Write the next version of a table beside the old ones.

    Nothing that is being read is overwritten.  A version counts from the moment
    its folder is complete (the writer's ``_SUCCESS`` mark); readers take the
    latest complete one, so a lost writer leaves the table as it was.
    """
    target = _claim(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(target)
    return target


def _claim(spark, path: str) -> str:
    """The folder of the next version; its number is taken by creating a file, which only one writer can."""
    done = _versions(spark, path)
    number = max(done) if done else 0
    while True:
        number += 1
        fs, claim = _hadoop_path(spark, f"{path}/claims/{number:08d}")
        if fs.createNewFile(claim):
            return f"{path}/v{number:08d}-{uuid.uuid4().hex[:8]}"


_BUCKET = "live_bucket"
#: Attempts of a load whose buckets others change meanwhile.
ATTEMPTS = 8


def _folder(place: str, number: int) -> str:
    return f"{place}/v{number:08d}-{uuid.uuid4().hex[:8]}"


def _counted(df: DataFrame, folder: str, *partition: str) -> int:
    """Write rows and count them in the same pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").partitionBy(*partition).parquet(folder)
    return seen.get["rows"]


def _live_folders(spark, folder: str) -> dict[int, str]:
    return {int(n.partition("=")[2]): f"{folder}/{n}" for n in commits.names(spark, folder) if n.startswith(f"{_BUCKET}=")}


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """Write rows as the whole table, a folder for every bucket of the key's hash; returns the folder of them all."""
    spark = df.sparkSession
    while True:
        base = commits.snapshot(spark, path)
        target = _folder(path, base.number + 1)
        n = _counted(commits.spread(df, key, buckets, _BUCKET), target, _BUCKET)
        live = {**dict.fromkeys(base.live), **_live_folders(spark, target)}
        if commits.publish(spark, path, base, buckets, live, {}, {"live": n}):
            return target


def read_buckets(spark, path: str, schema, only: set[int] | None = None, snap: commits.Snapshot | None = None) -> DataFrame:
    """The rows of a bucketed table, or of some of its buckets, now or as a snapshot has them."""
    snap = snap or commits.snapshot(spark, path)
    folders = [folder for n, folder in sorted(snap.live.items()) if only is None or n in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_part(spark, path: str, part: str, schema, snap: commits.Snapshot | None = None) -> DataFrame:
    """All archived or refused rows of a bucketed table, now or as a snapshot has them."""
    folders = (snap or commits.snapshot(spark, path)).parts.get(part, ())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge_buckets(stage: DataFrame, path: str, schema, key: str, buckets: int,
                  merge: Callable[[DataFrame, DataFrame], Merge | DataFrame], attempts: int = ATTEMPTS) -> set[int]:
    """Bring staged rows into a bucketed table; only buckets that hold staged keys are read and written.

    ``merge(live, stage)`` returns a whole ``load.merge_live(...)``, or only the new live rows of
    those buckets.  Live, archived and refused rows (those without a key, and those a whole merge refuses)
    become visible together, by one commit.  If another load changed one of the buckets meanwhile,
    the merge is made anew from what that load left; after ``attempts`` of these it is an error and nothing has changed.
    What a merge that returns only live rows refuses is not known here.
    Returns the buckets; there are at most ``buckets`` of them.
    """
    spark = stage.sparkSession
    stage = pin(stage)
    keyed, keyless = stage.where(F.col(key).isNotNull()), stage.where(F.col(key).isNull())
    touched = {r[0] for r in commits.spread(keyed, key, buckets, _BUCKET).select(_BUCKET).distinct().collect()}
    for _ in range(attempts):
        base = commits.snapshot(spark, path)
        whole = merge(read_buckets(spark, path, schema, touched, base), keyed) if touched else None
        found, rows, added, live = {"refused": keyless}, {}, {}, {}
        if isinstance(whole, Merge):
            found = {"archive": whole.archived, "refused": keyless.unionByName(whole.refused, allowMissingColumns=True)}
            whole = whole.live
        for part, df in found.items():
            target = _folder(f"{path}/{part}", base.number + 1)
            rows[part] = _counted(df, target)
            added[part] = [target] if rows[part] else []
        if whole is not None:
            target = _folder(path, base.number + 1)
            rows["live"] = _counted(commits.spread(whole, key, buckets, _BUCKET), target, _BUCKET)
            live = {**dict.fromkeys(touched), **_live_folders(spark, target)}
        if commits.publish(spark, path, base, buckets, live, added, rows):
            return touched
    raise RuntimeError(f"{path}: other loads changed the same buckets {attempts} times")


def compact(spark, path: str, keep: int = 1, grace_hours: float = 24.0) -> list[str]:
    """Bring archive and refused rows together into one folder each, and delete what the last ``keep`` commits do not name.

    Loads may go on meanwhile: what they add stays beside the new folders.
    """
    base = commits.snapshot(spark, path)
    many = {p: f for p, f in base.parts.items() if len(f) > 1}
    if many:
        added = {}
        for part, folders in many.items():
            target = _folder(f"{path}/{part}", base.number + 1)
            spark.read.option("mergeSchema", "true").parquet(*folders).write.parquet(target)
            added[part] = [target]
        commits.publish(spark, path, base, base.count, {}, added, dropped=tuple(f for folders in many.values() for f in folders))
    return commits.vacuum(spark, path, keep, grace_hours)


def _versions(spark, path: str) -> dict[int, str]:
    fs, folder = _hadoop_path(spark, path)
    if not fs.exists(folder):
        return {}
    found = {}
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        _, mark = _hadoop_path(spark, f"{path}/{name}/_SUCCESS")
        if name.startswith("v") and fs.exists(mark):
            found[int(name[1:9])] = f"{path}/{name}"
    return found


def read_version(spark, path: str) -> DataFrame | None:
    """The latest complete version of a table, or None before the first."""
    done = _versions(spark, path)
    return spark.read.parquet(done[max(done)]) if done else None


def write_csv_report(df: DataFrame, path: str, newline: str = "\n") -> None:
    """CSV part files in the order of the rows, and their header in a file that sorts before them; an existing report is an error.

    However long a report is, no single task writes or sorts all of it.
    """
    (df.write.mode("errorifexists").option("lineSep", newline).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))
    fs, header = _hadoop_path(df.sparkSession, f"{path}/header.csv")
    out = fs.create(header, False)
    out.write((",".join(df.columns) + newline).encode())
    out.close()


def write_text_report(df: DataFrame, path: str, newline: str = "\n") -> None:
    """The text of one row."""
    df.limit(1).write.mode("errorifexists").option("lineSep", newline).text(path)


def route(df: DataFrame, identifiable: Column, anon: str = "anon", ident: str = "ident") -> DataFrame:
    """Add the ``route`` a record is published under."""
    return df.withColumn("route", F.when(identifiable, ident).otherwise(anon))


def write_routed(df: DataFrame, path: str) -> None:
    df.write.partitionBy("route").mode("append").json(path)
