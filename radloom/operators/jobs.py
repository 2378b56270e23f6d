"""Extraction jobs: progress, completion and the reports they end in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions import paths
from radloom.functions.joins import join_side, unique_side
from radloom.functions.text import clock_duration
from radloom.operators.validate import parse_report
from radloom.schemas import CLASSIFICATIONS

PART_SEPARATOR = "###"


def statuses(file_status: DataFrame, verification: DataFrame) -> DataFrame:
    """Both kinds of finished file under one shape."""
    failed = file_status.select(
        "job_id", "file_path", "output_path", F.col("status").alias("extracted"),
        F.lit("NotVerified").alias("verified"), "message")
    screened = verification.select(
        "job_id", "file_path", "output_path", F.lit("Anonymised").alias("extracted"),
        F.col("status").alias("verified"), F.col("report").alias("message"))
    return failed.unionByName(screened)


def info_counts(infos: DataFrame) -> DataFrame:
    """Collection records and expected files per job; a key's parts count once."""
    return infos.groupBy("job_id").agg(
        F.count_if(F.col("part") == 0).alias("infos"), F.sum(F.size("files")).alias("expected"))


def job_counts(jobs: DataFrame, infos: DataFrame, done: DataFrame) -> DataFrame:
    """Progress per job.

    ``infos`` and ``done`` are reduced to a row per job before they meet the
    jobs, so a job with most of the events costs no more than any other.
    """
    finished = done.groupBy("job_id").agg(F.count("*").alias("statuses"))
    return jobs.join(infos, "job_id", "left").join(finished, "job_id", "left").select(
        *jobs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("infos", "expected", "statuses")])


def status_of(key_count: Column, infos: Column, expected: Column, done: Column, before: Column | None = None) -> Column:
    """State of a job from its counts; equality moves it on, not excess.

    ``before`` is the stored state: a job does not move back, a failed job stays.
    """
    before = before if before is not None else F.lit("WaitingForCollectionInfo")
    waiting = F.when(expected == done, "ReadyForChecks").otherwise("WaitingForStatuses")
    return (F.when(before.isin("Failed", "Completed", "ReadyForChecks"), before)
            .when(before == "WaitingForStatuses", waiting)
            .when(key_count == infos, waiting).otherwise("WaitingForCollectionInfo"))


def job_status(counts: DataFrame) -> DataFrame:
    before = F.col("status") if "status" in counts.columns else None
    return counts.withColumn("status", status_of(*map(F.col, ("key_count", "infos", "expected", "statuses")), before=before))


def complete_jobs(status: DataFrame) -> DataFrame:
    """Close jobs that are ready; one without records or statuses fails."""
    empty = (F.col("infos") == 0) | (F.col("statuses") == 0)
    ready = F.col("status") == "ReadyForChecks"
    return status.withColumn("status", F.when(ready & empty, "Failed").when(ready, "Completed").otherwise(F.col("status")))


def split_late(events: DataFrame, completed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events in time, and events of jobs already completed (errors)."""
    done = unique_side(completed, "job_id")
    return events.join(done, "job_id", "left_anti"), events.join(done, "job_id", "left_semi")


# --- reports ---------------------------------------------------------------------

def report_rejected(rejections: DataFrame, place: Callable[..., DataFrame] = DataFrame.orderBy) -> DataFrame:
    """Rejections in report order from ``(job_id, key_value, reason, n)`` rows.

    Keys with most rejections come first, then reasons by count.  ``place`` puts
    the rows in the order it is given; :func:`with_position` notes it as ``pos`` instead.
    """
    totals = rejections.groupBy("job_id", "key_value").agg(F.sum("n").alias("_total"))
    ordered = place(rejections.join(join_side(totals, "job_id", "key_value"), ["job_id", "key_value"]),
                    "job_id", F.col("_total").desc(), "key_value", F.col("n").desc(), "reason")
    noted = [c for c in ordered.columns if c == "pos"]
    return ordered.select(*noted, "job_id", F.col("key_value").alias("ExtractionKey"), F.col("n").alias("Count"),
                          F.col("reason").alias("Reason"))


def rejections_of(infos: DataFrame) -> DataFrame:
    """Rejection rows of collection records; keys without reasons have none."""
    return infos.select("job_id", "key_value", F.explode("reasons").alias("reason", "n"))


def report_errors(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Files that were missing, or could not be anonymised or screened.

    In an anonymised job a missing file is listed both as missing and as a
    failure.  A file whose screening failed is listed with its message.
    """
    known = done.join(join_side(jobs.select("job_id", "identifiable"), "job_id"), "job_id")
    # One pass: each status gives up to two report rows.
    missing = F.when(F.col("extracted") == "FileMissing", F.struct(F.lit(0).alias("_step"), F.lit("Missing").alias("Reason")))
    failed = F.when(~F.col("identifiable") & (
        ((F.col("verified") == "NotVerified") & (F.col("extracted") != "Copied")) | (F.col("verified") == "ErrorWontRetry")),
        F.struct(F.lit(1).alias("_step"), F.col("message").alias("Reason")))
    rows = known.select("job_id", F.col("file_path").alias("DicomFilePath"),
                        F.explode(F.array_compact(F.array(missing, failed))).alias("_e"))
    return rows.select("job_id", "_e._step", "DicomFilePath", "_e.Reason").withColumnRenamed("_step", "section")


def report_verification(jobs: DataFrame, done: DataFrame, separator: str = PART_SEPARATOR) -> DataFrame:
    """Personal data found in anonymised output, one row per failure."""
    names = F.array(*[F.lit(n) for n in CLASSIFICATIONS])
    # A number without a name stays a number; an absent word or class an empty text, so that the lists stay in step.
    named = lambda c: F.coalesce(F.when(c.rlike(r"^\d+$"), F.get(names, c.try_cast("int"))), c)
    anonymised = join_side(jobs.where(~F.col("identifiable")).select("job_id"), "job_id")
    failures = (done.where(F.col("verified") == "IsIdentifiable").join(anonymised, "job_id", "left_semi")
                .select("job_id", "output_path", F.explode(parse_report(F.col("message"))).alias("f")))
    parts = F.coalesce(F.col("f.Parts"), F.array().cast("array<struct<Classification:string,Offset:int,Word:string>>"))
    listed = lambda pick: F.array_join(F.transform(parts, lambda p: F.coalesce(pick(p), F.lit(""))), separator)
    return failures.select(
        "job_id", F.col("output_path").alias("Resource"), F.col("f.ResourcePrimaryKey").alias("ResourcePrimaryKey"),
        F.col("f.ProblemField").alias("ProblemField"), F.col("f.ProblemValue").alias("ProblemValue"),
        listed(lambda p: p["Word"]).alias("PartWords"),
        listed(lambda p: named(p["Classification"])).alias("PartClassifications"),
        listed(lambda p: p["Offset"].cast("string")).alias("PartOffsets"))


def report_readme(jobs: DataFrame, title: str = "Extraction validation report for", newline: str = "\n") -> DataFrame:
    """The summary text of each job: ``(job_id, readme)``."""
    moment = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    yes_no = lambda c: F.when(c, "Yes").otherwise("No")
    took = clock_duration(F.unix_timestamp("completed_at") - F.unix_timestamp("submitted_at"))
    facts = [
        ("Job submitted at:", moment("submitted_at")),
        ("Job completed at:", moment("completed_at")),
        ("Job duration:", took),
        ("Job extraction id:", F.col("job_id")),
        ("Extraction tag:", F.col("key_tag")),
        ("Extraction modality:", F.coalesce("modality", F.lit("Unspecified"))),
        ("Requested identifier count:", F.col("key_count").cast("string")),
        ("User name:", F.col("user_name")),
        ("Identifiable extraction:", yes_no(F.col("identifiable"))),
        ("Filtered extraction:", yes_no(~F.col("no_filters"))),
    ]
    heading = F.concat(F.lit(f"# {title} "), F.col("project"), F.lit(" "), paths.extraction_name(F.col("directory")))
    lines = [heading, F.lit(""), F.lit("Job info:"),
             *[F.concat(F.lit(f"-   {label:<30}"), value) for label, value in facts], F.lit("")]
    return jobs.select("job_id", F.concat_ws(newline, *lines).alias("readme"))


def reports_dir(root: str, directory: str) -> str:
    """Where the reports of an extraction directory go."""
    project, _, name = directory.rstrip("/\\").replace("\\", "/").rpartition("/")
    return "/".join(p for p in (root.rstrip("/"), project, "reports", name) if p)
