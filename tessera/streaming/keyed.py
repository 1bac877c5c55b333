"""Jobs as keyed state of a stream: each job is one state, changed by its own events and timers alone.

Events of a job come to one task in the order of their times, so a claim is serial by key: of two
workers that get a job's message, one runs it. Timers stand for what nobody reports: a running job
without a heartbeat for two minutes is queued again or fails, a job that waits for its next attempt
is due when its backoff is over. The output says what happened, and a worker acts on it: rows
`run` are to be run, rows `due` are delivered again.

An event that belongs to an attempt which another worker has taken over since is ignored, so a
worker thought dead can't end its successor's run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators import jobs as J

#: kind: create, deliver (a worker asks for the job), beat, progress, succeed or fail.
EVENT = "job_id long, kind string, worker string, attempt int, error string, done int, total int, at timestamp"
STATE = "status string, attempts int, run_after timestamp, heartbeat_at timestamp, started_at timestamp, finished_at timestamp, last_error string, entities_done int, entities_total int, worker string"
#: what: queued, run, refused, ignored, beat, progress, succeeded, retry, failed, due or stale.
OUT = "job_id long, at timestamp, what string, worker string, attempt int, status string, run_after timestamp, last_error string, entities_done int, entities_total int"
FIELDS = [c.split(" ")[0] for c in STATE.split(", ")]
STALE, LOST = dt.timedelta(seconds=J.STALE_S), J.ABANDONED
#: The least step of a timer: a job is stale only after its two minutes.
TICK = dt.timedelta(milliseconds=1)


def backoff(attempts: int) -> dt.timedelta:
    return dt.timedelta(seconds=min(J.BASE_S * 2 ** min(max(attempts - 1, 0), 20), J.CAP_S))


def stale(job: dict, now: dt.datetime) -> bool:
    return job["status"] == "running" and (job["heartbeat_at"] is None or job["heartbeat_at"] < now - STALE)


def ended(job: dict, now: dt.datetime, error: str | None) -> tuple[dict, str]:
    """The job after a run ended: succeeded, queued for another attempt, or failed."""
    if error is None:
        return job | {"status": "succeeded", "finished_at": now, "heartbeat_at": None, "last_error": None}, "succeeded"
    again = job["attempts"] < J.ATTEMPTS
    after = {"run_after": now + backoff(job["attempts"]), "status": "queued"} if again else {"status": "failed", "finished_at": now}
    return job | after | {"heartbeat_at": None, "last_error": error[: J.ERROR_CHARS]}, "retry" if again else "failed"


def lost(job: dict, now: dt.datetime) -> tuple[dict, str]:
    """The job after nobody has reported on it: queued for now, or failed without attempts left."""
    if job["attempts"] >= J.ATTEMPTS:
        return job | {"status": "failed", "finished_at": now, "heartbeat_at": None, "last_error": job["last_error"] or LOST}, "failed"
    return job | {"status": "queued", "heartbeat_at": None}, "stale"


def step(job: dict | None, event: dict) -> tuple[dict | None, str]:
    """The job, which isn't stale, after an event, and what happened."""
    kind, now = event["kind"], event["at"]
    if job is None:
        if kind != "create":
            return None, "ignored"
        return dict.fromkeys(FIELDS) | {"status": "queued", "attempts": 0, "run_after": now, "entities_done": 0, "entities_total": 0}, "queued"
    if kind == "deliver":
        if job["run_after"] <= now and job["status"] == "queued":
            return job | {"status": "running", "attempts": job["attempts"] + 1, "started_at": now, "heartbeat_at": now, "finished_at": None, "worker": event["worker"]}, "run"
        return job, "refused"
    if kind in ("beat", "progress", "succeed", "fail"):
        if job["status"] != "running" or event["attempt"] != job["attempts"]:
            return job, "ignored"
        if kind == "beat":
            return job | {"heartbeat_at": now}, "beat"
        if kind == "progress":
            return job | {"heartbeat_at": now, "entities_done": event["done"], "entities_total": event["total"]}, "progress"
        return ended(job, now, None if kind == "succeed" else event["error"] or "")
    return job, "ignored"


def wakes(job: dict, last: dt.datetime) -> dt.datetime | None:
    """When a timer has to look at a job; last: when it changed."""
    if job["status"] == "running":
        return (job["heartbeat_at"] or last) + STALE + TICK
    return job["run_after"] if job["status"] == "queued" and job["run_after"] > last else None


def _ms(at: dt.datetime) -> int:
    """Milliseconds of a UTC time without zone."""
    return (at - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1)


def _plain(value):
    return None if value is None or value is pd.NaT or value != value else value.to_pydatetime().replace(tzinfo=None) if isinstance(value, pd.Timestamp) else value


class JobState(StatefulProcessor):
    """One job: its state, and at most one timer."""

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def load(self) -> dict | None:
        held = self.job.get()
        return None if held is None else {k: _plain(v) for k, v in zip(FIELDS, held)} | {"attempts": int(held[1])}

    def keep(self, key, job: dict | None, last: dt.datetime) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if job is not None:
            self.job.update(tuple(job[k] for k in FIELDS))
            if (at := wakes(job, last)) is not None:
                self.handle.registerTimer(_ms(at))

    @staticmethod
    def said(key, at, what: str, job: dict | None, worker=None) -> dict:
        job = job or dict.fromkeys(FIELDS)
        return {"job_id": key[0], "at": at, "what": what, "worker": worker or job["worker"], "attempt": job["attempts"], **{k: job[k] for k in ("status", "run_after", "last_error", "entities_done", "entities_total")}}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, out = self.load(), []
        events = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        for event in events.to_dict("records"):
            event = {k: _plain(v) for k, v in event.items()}
            if job is not None and stale(job, event["at"]):  # its timer would have gone off before, whatever batch the event is in
                over = (job["heartbeat_at"] or event["at"] - STALE - TICK) + STALE + TICK
                job, what = lost(job, over)
                out.append(self.said(key, over, what, job))
            job, what = step(job, event)
            out.append(self.said(key, event["at"], what, job, event["worker"]))
        self.keep(key, job, out[-1]["at"])
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = self.load()
        now = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        if job is None:
            return
        if stale(job, now):
            job, what = lost(job, now)
            self.keep(key, job, now)
            yield frame([self.said(key, now, what, job)])
        elif job["status"] == "queued" and job["run_after"] <= now:
            yield frame([self.said(key, now, "due", job)])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A job of a table; one that ran or waited when the table was written is looked at when its time is over."""
        held = {k: _plain(v) for k, v in initialState.iloc[0].to_dict().items() if k in FIELDS}
        job = dict.fromkeys(FIELDS) | held | {"attempts": int(held["attempts"])}
        self.keep(key, job, job["heartbeat_at"] or job["run_after"] - TICK)

    def close(self) -> None:
        pass


def frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUT.split(", ")])
    for name in ("attempt", "entities_done", "entities_total"):
        out[name] = out[name].astype("Int32")
    for name in ("at", "run_after"):
        out[name] = pd.to_datetime(out[name])
    return out


def job_stream(events: DataFrame, late: str = "10 minutes", jobs: DataFrame | None = None) -> DataFrame:
    """What happens to jobs (OUT), from a stream of EVENT rows; jobs: a table with id and the columns of STATE to begin with.

    Times are those of the events, and timers go off when the watermark passes them. The state needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass), which spills to disk.
    """
    keyed = events.withWatermark("at", late).groupBy("job_id")
    begin = None
    if jobs is not None:
        have = [F.col(c) if c in jobs.columns else F.lit(None).cast(kind).alias(c) for c, kind in (f.split(" ") for f in STATE.split(", "))]
        begin = jobs.select(F.col("id").alias("job_id"), *have).groupBy("job_id")
    return keyed.transformWithStateInPandas(JobState(), OUT, "Append", "EventTime", begin)


STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def work(happened: DataFrame, path: str, run: Callable[[DataFrame], DataFrame], checkpoint: str, worker: str, now: Callable[[], dt.datetime], once: bool = False) -> StreamingQuery:
    """Runs what the stream says is to run, and sends back events: results, and messages of jobs that are due.

    run: from (job_id, attempt) to (job_id, error). Events are appended below path, which the
    stream of events reads. A batch that comes again sends its events again: those of an ended
    attempt are ignored.
    """

    def handle(batch: DataFrame, _: int) -> None:
        batch.persist()
        at = F.lit(now()).cast("timestamp")
        again = batch.where(F.col("what").isin("due", "stale", "queued")).select("job_id", F.lit("deliver").alias("kind"))
        mine = batch.where((F.col("what") == "run") & (F.col("worker") == F.lit(worker))).select("job_id", "attempt")
        parts = [again]
        if not mine.isEmpty():
            done = run(mine).select("job_id", "error").join(mine, "job_id")
            parts.append(done.select("job_id", F.when(F.col("error").isNull(), "succeed").otherwise("fail").alias("kind"), "attempt", "error"))
        for part in parts:
            filled = part.withColumns({"worker": F.lit(worker), "at": at} | {c: F.lit(None).cast(k) for c, k in (f.split(" ") for f in EVENT.split(", ")) if c not in (*part.columns, "worker", "at")})
            filled.select(*[f.split(" ")[0] for f in EVENT.split(", ")]).write.mode("append").parquet(path)
        batch.unpersist()

    writer = happened.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
