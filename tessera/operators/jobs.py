"""The life of an indexing job as set-based transitions from one snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds and attempts.
STALE_S, BASE_S, CAP_S, ATTEMPTS, ERROR_CHARS = 120, 30, 900, 3, 2000
#: The error code of a job that nobody reports on and that has no attempts left.
ABANDONED = "worker-lost"


def stale(now: Column) -> Column:
    """Running without a heartbeat for two minutes."""
    return (F.col("status") == "running") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - F.expr(f"interval {STALE_S} seconds")))


def claimable(now: Column) -> Column:
    return (F.col("run_after") <= now) & ((F.col("status") == "queued") | stale(now))


def backoff_seconds(attempts: Column) -> Column:
    """30, 60, 120 ... seconds, at most 900."""
    return F.least(F.lit(BASE_S) * F.pow(F.lit(2), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20))), F.lit(CAP_S)).cast("long")


def claim(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """Claimable chosen jobs run from now, with one attempt more."""
    hit = chosen & claimable(now)
    return jobs.withColumn("__hit", hit).withColumns({
        "status": F.when(F.col("__hit"), "running").otherwise(F.col("status")),
        "attempts": F.when(F.col("__hit"), F.col("attempts") + 1).otherwise(F.col("attempts")),
        "started_at": F.when(F.col("__hit"), now).otherwise(F.col("started_at")),
        "heartbeat_at": F.when(F.col("__hit"), now).otherwise(F.col("heartbeat_at")),
        "finished_at": F.when(F.col("__hit"), F.lit(None)).otherwise(F.col("finished_at")),
    }).drop("__hit")


def heartbeat(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    return jobs.withColumn("heartbeat_at", F.when(chosen & (F.col("status") == "running"), now).otherwise(F.col("heartbeat_at")))


def succeed(jobs: DataFrame, chosen: Column, now: Column) -> DataFrame:
    return jobs.withColumns({
        "status": F.when(chosen, "succeeded").otherwise(F.col("status")), "finished_at": F.when(chosen, now).otherwise(F.col("finished_at")),
        "heartbeat_at": F.when(chosen, F.lit(None)).otherwise(F.col("heartbeat_at")), "last_error": F.when(chosen, F.lit(None)).otherwise(F.col("last_error")),
    })


def fail(jobs: DataFrame, chosen: Column, error: Column, now: Column) -> DataFrame:
    """Failed jobs queue again after their backoff while they have attempts left."""
    again = chosen & (F.col("attempts") < ATTEMPTS)
    done = chosen & (F.col("attempts") >= ATTEMPTS)
    later = now + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return jobs.withColumns({"__again": again, "__done": done, "__any": chosen}).withColumns({
        "run_after": F.when(F.col("__again"), later).otherwise(F.col("run_after")),
        "status": F.when(F.col("__again"), "queued").when(F.col("__done"), "failed").otherwise(F.col("status")),
        "finished_at": F.when(F.col("__done"), now).otherwise(F.col("finished_at")),
        "heartbeat_at": F.when(F.col("__any"), F.lit(None)).otherwise(F.col("heartbeat_at")),
        "last_error": F.when(F.col("__any"), F.substring(error, 1, ERROR_CHARS)).otherwise(F.col("last_error")),
    }).drop("__again", "__done", "__any")


def reconcile(jobs: DataFrame, now: Column) -> DataFrame:
    """Adds outcome to queued and stale jobs (failed if out of attempts, else queued: deliver again) and sets it as status.

    A job out of attempts ends now; both lose their heartbeat. Columns that jobs lacks are left out.
    """
    open_ = (F.col("status") == "queued") | stale(now)
    outcome = F.when(open_ & (F.col("attempts") >= ATTEMPTS), "failed").when(open_, "queued")
    failed, met = F.col("outcome").eqNullSafe(F.lit("failed")), F.col("outcome").isNotNull()
    rest = {
        "finished_at": F.when(failed, now).otherwise(F.col("finished_at")) if "finished_at" in jobs.columns else None,
        "last_error": F.when(failed, F.coalesce("last_error", F.lit(ABANDONED))).otherwise(F.col("last_error")) if "last_error" in jobs.columns else None,
        "heartbeat_at": F.when(~met, F.col("heartbeat_at")),
    }
    return jobs.withColumn("outcome", outcome).withColumns({"status": F.coalesce("outcome", "status"), **{k: v for k, v in rest.items() if v is not None}})


def redeliver(reconciled: DataFrame) -> DataFrame:
    """The ids of the jobs that reconcile() found open: their messages are sent again, and claiming refuses what runs."""
    return reconciled.where("outcome = 'queued'").select("id")


def latest(jobs: DataFrame) -> DataFrame:
    """The last job of each project, by run_after, then id."""
    return jobs.groupBy("project_id").agg(F.max_by(F.struct("id", "status", "attempts"), F.struct("run_after", "id")).alias("j")).select("project_id", "j.*")


def active(jobs: DataFrame) -> DataFrame:
    """Projects with a job that is queued or running."""
    return jobs.where(F.col("status").isin("queued", "running")).select("project_id").distinct()


def create(projects: DataFrame, ids: Column, now: Column) -> DataFrame:
    """A queued job, due now, for each project (column id); ids: the new jobs' ids."""
    none = F.lit(None)
    return projects.select(
        ids.alias("id"), F.col("id").alias("project_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), now.alias("run_after"),
        *(none.cast("timestamp_ntz").alias(c) for c in ("heartbeat_at", "started_at", "finished_at")), none.cast("string").alias("last_error"),
        *(F.lit(0).alias(c) for c in ("entities_total", "entities_done")),
    )


def record_progress(jobs: DataFrame, progress: DataFrame, now: Column) -> DataFrame:
    """Jobs with the counts of progress (id, done, total), whatever their status; progress is a heartbeat, too."""
    met = F.col("done").isNotNull()
    joined = jobs.join(progress.select("id", "done", "total"), "id", "left")
    return joined.withColumns({
        "entities_done": F.when(met, F.col("done")).otherwise(F.col("entities_done")), "entities_total": F.when(met, F.col("total")).otherwise(F.col("entities_total")),
        "heartbeat_at": F.when(met, now).otherwise(F.col("heartbeat_at")),
    }).select(*jobs.columns)


def settle(jobs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Jobs after runs ended: results (id, error) without an error succeed, the others fail or queue again."""
    joined = jobs.join(results.select("id", F.lit(True).alias("__ended"), F.col("error").alias("__error")), "id", "left")
    ended = F.coalesce("__ended", F.lit(False)) & (F.col("status") == "running")
    good = succeed(joined, ended & F.col("__error").isNull(), now)
    return fail(good, ended & F.col("__error").isNotNull() & (F.col("status") == "running"), F.col("__error"), now).select(*jobs.columns)


def for_projects(jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Jobs with their project's columns; a job whose project is gone has none."""
    return jobs.join(projects.select(F.col("id").alias("project_id"), F.col("status").alias("project_status"), "name"), "project_id", "left")
