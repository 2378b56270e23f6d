"""Writing the reports of a completed job, at completion or again later."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from radloom.functions.joins import unique_side
from radloom.operators import jobs as J
from radloom.session import pin
from radloom.sources import sinks


@dataclass(frozen=True)
class CompletedJobs:
    """Stored records of completed jobs."""

    jobs: DataFrame
    infos: DataFrame
    statuses: DataFrame

    def only(self, job_id: str) -> "CompletedJobs":
        mine = lambda df: df.where(F.col("job_id") == job_id)
        return CompletedJobs(mine(self.jobs), mine(self.infos), mine(self.statuses))


def close_jobs(jobs: DataFrame, infos: DataFrame, statuses: DataFrame, now: Column) -> tuple[CompletedJobs, DataFrame]:
    """Jobs that are complete with their records, and jobs that failed.

    Jobs still waiting are in neither.  The states are pinned: they decide what
    happens to every other record.
    """
    counted = J.job_counts(jobs, J.info_counts(infos), statuses)
    states = pin(J.complete_jobs(J.job_status(counted)).where(F.col("status").isin("Completed", "Failed")))
    done = states.where(F.col("status") == "Completed")
    of_done = lambda df: df.join(unique_side(done, "job_id"), "job_id", "left_semi")
    completed = done.select(*[c for c in jobs.columns if c not in ("status", "completed_at")], "status", now.alias("completed_at"))
    return CompletedJobs(completed, of_done(infos), of_done(statuses)), states.where(F.col("status") == "Failed")


def write_reports(completed: CompletedJobs, job_id: str, root: str, newline: str = "\n") -> str:
    """README, rejected files, processing errors, verification failures.

    An unknown job and an existing reports folder are errors.  The reports are
    written aside and moved to their place together, so a failure in between leaves no
    folder that would block the next try.
    """
    one = completed.only(job_id)
    job = one.jobs.first()
    if job is None:
        raise ValueError(f"no completed document for job {job_id}")
    target = J.reports_dir(root, job["directory"])
    fs, folder = sinks._hadoop_path(one.jobs.sparkSession, target)
    if fs.exists(folder):
        raise ValueError(f"job reports directory already exists: {target}")
    final, target = target, f"{target}.{uuid.uuid4().hex[:8]}.partial"
    sinks.write_text_report(J.report_readme(one.jobs, newline=newline).select("readme"), f"{target}/README", newline)
    sinks.write_csv_report(J.report_rejected(J.rejections_of(one.infos)).drop("job_id"), f"{target}/rejected_files", newline)
    errors = J.report_errors(one.jobs, one.statuses).orderBy("section", "DicomFilePath")
    sinks.write_csv_report(errors.select("DicomFilePath", "Reason"), f"{target}/processing_errors", newline)
    if not job["identifiable"]:
        sinks.write_csv_report(J.report_verification(one.jobs, one.statuses).drop("job_id"),
                               f"{target}/verification_failures", newline)
    if not fs.rename(sinks._hadoop_path(one.jobs.sparkSession, target)[1], folder):
        raise ValueError(f"job reports directory already exists: {final}")
    return final
