"""Job messages as a stream: files of job ids, claimed in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs as J
from ..operators import projects as P

MESSAGE = "job_id long, sent_at timestamp"


def send(jobs: DataFrame, path: str) -> None:
    """Append a message for each job id."""
    jobs.select(F.col("id").alias("job_id"), F.current_timestamp().alias("sent_at")).write.mode("append").parquet(path)


def messages(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """The messages as they come; a job sent twice within the delay is delivered once."""
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 100).parquet(path)
    return stream.withWatermark("sent_at", delay).dropDuplicatesWithinWatermark(["job_id"])


def work(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Give each micro-batch of job ids to handle, which claims and runs what can be claimed.

    A batch may come again after a failure; claiming refuses a job that already runs.
    """
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def worker(load: Callable[[], tuple[DataFrame, DataFrame]], store: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], run: Callable[[DataFrame], DataFrame], now: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A handle for work(): claim the batch's jobs, run them, and settle jobs and projects.

    load: the snapshots of jobs and projects; store: keeps new ones and returns them read back;
    run: from claimed jobs (with their project's columns) to a written frame (id, error). What
    can't be claimed is skipped, so a message delivered twice does nothing; a job whose project is
    gone succeeds without a run.
    """

    def handle(batch: DataFrame, _: int) -> None:
        jobs, projects = load()
        ids = batch.select(F.col("job_id").alias("id"), F.lit(True).alias("__sent")).distinct()
        at = now()
        asked = jobs.join(ids, "id", "left").withColumn("__own", F.coalesce("__sent", F.lit(False)) & J.claimable(at))
        claimed = J.claim(asked, F.col("__own"), at).drop("__sent")
        mine = claimed.where("__own").select("id")
        if mine.isEmpty():
            return
        held, projects = store(claimed.select(*jobs.columns, "__own"), projects)
        own = J.for_projects(held.where("__own"), projects)
        gone = own.where("project_status is null").select("id", F.lit(None).cast("string").alias("error"))
        results = run(own.where("project_status is not null")).select("id", "error").unionByName(gone)
        jobs = held.drop("__own")
        settled = J.settle(jobs, results, at)
        store(settled, P.after_runs(projects, settled, results))

    return handle


def beat(spark: SparkSession, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], now: Callable[[], Column], checkpoint: str, every: str = "15 seconds") -> StreamingQuery:
    """Give all running jobs of this worker (what load() returns) a heartbeat at each tick, until the query is stopped.

    A tick that fails is only missed: the next one comes after the query restarts, and a sweep revives what nobody beats.
    """
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(_: DataFrame, __: int) -> None:
        store(J.heartbeat(load(), F.lit(True), now()))

    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def sweep(jobs: DataFrame, projects: DataFrame, path: str, now: Column, keep: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Reconcile jobs and projects, keep both, and send the messages of open jobs again."""
    reconciled = J.reconcile(jobs, now)
    jobs, projects = keep(reconciled, P.after_reconcile(projects, reconciled))
    send(J.redeliver(jobs), path)
    return jobs.drop("outcome"), projects
