"""The life of a project as transitions from one snapshot to the next: queued, indexing, ready, failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs as J

#: Codes of what a project's owner is told; the details stay with the job.
INTERRUPTED, FAILED = "indexing-interrupted", "indexing-failed"


def set_status(projects: DataFrame, chosen: Column, status: Column | str, error: Column | None = None) -> DataFrame:
    """Chosen projects get the status and the error, none where error isn't given."""
    status = F.lit(status) if isinstance(status, str) else status
    return projects.withColumn("__hit", F.coalesce(chosen, F.lit(False))).withColumns({
        "status": F.when(F.col("__hit"), status).otherwise(F.col("status")),
        "error_message": F.when(F.col("__hit"), F.lit(None).cast("string") if error is None else error).otherwise(F.col("error_message")),
    }).drop("__hit")


def create(requests: DataFrame, repository: Column, now: Column) -> DataFrame:
    """Queued projects of requests (id, owner_id, name, url); a missing name is the repository's, and the namespace is the id.

    Requests whose url names no repository are left out; refused() has them.
    """
    named = requests.withColumn("__r", repository).where("__r is not null")
    return named.select(
        "id", "owner_id", F.coalesce("name", "__r.name").alias("name"), "url", F.col("__r.owner").alias("repository_owner"), F.col("__r.name").alias("repository_name"),
        F.col("id").cast("string").alias("namespace"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error_message"), now.alias("created_at"),
    )


def refused(requests: DataFrame, repository: Column) -> DataFrame:
    """The requests that create() leaves out."""
    return requests.where(repository.isNull())


def newest(projects: DataFrame, owner_id) -> DataFrame:
    """An owner's projects, newest first, ties by id."""
    return projects.where(F.col("owner_id") == F.lit(owner_id)).orderBy(F.desc("created_at"), "id")


def request_reindex(projects: DataFrame, jobs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, verdicts): wanted projects (id) without an open job queue again, without their error; the others are busy or unknown."""
    asked = wanted.select("id").distinct()
    active = J.active(jobs).withColumnRenamed("project_id", "id").withColumn("busy", F.lit(True))
    known = projects.select("id", F.lit(True).alias("known"))
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("busy").isNotNull(), "busy").otherwise("queued")
    verdicts = asked.join(known, "id", "left").join(active, "id", "left").select("id", verdict.alias("verdict"))
    joined = projects.join(verdicts, "id", "left")
    return set_status(joined, F.col("verdict") == "queued", "queued").select(*projects.columns), verdicts


def delete(projects: DataFrame, owner_id, project_id) -> DataFrame:
    """The projects without an owner's project; its rows elsewhere go by cascade, its vectors by namespace."""
    return projects.where(~((F.col("id") == F.lit(project_id)) & (F.col("owner_id") == F.lit(owner_id))))


def after_reconcile(projects: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Projects of jobs that J.reconcile() revived are queued, those of jobs it gave up have failed.

    Of several jobs of a project one that was given up decides. A revived project keeps its error.
    """
    met = reconciled.where("outcome is not null").groupBy("project_id").agg(F.bool_or(F.col("outcome") == "failed").alias("__lost"))
    joined = projects.join(met.withColumnRenamed("project_id", "id"), "id", "left")
    lost = F.col("__lost")
    queued = joined.withColumn("status", F.when(~lost, "queued").otherwise(F.col("status")))
    return set_status(queued, lost, "failed", F.lit(INTERRUPTED)).select(*projects.columns)


def after_runs(projects: DataFrame, settled: DataFrame, results: DataFrame) -> DataFrame:
    """Projects after J.settle(): ready where the run succeeded, queued where it is tried again, else failed.

    results: (id, error) of the jobs that ended; a job whose project is gone changes nothing.
    """
    ended = settled.join(results.select("id"), "id", "left_semi").groupBy("project_id").agg(F.max_by("status", F.struct("run_after", "id")).alias("__job"))
    joined = projects.join(ended.withColumnRenamed("project_id", "id"), "id", "left")
    status = F.when(F.col("__job") == "succeeded", "ready").otherwise(F.col("__job"))
    return set_status(joined, F.col("__job").isNotNull(), status, F.when(F.col("__job") == "failed", F.lit(FAILED))).select(*projects.columns)
