"""Jobs as keyed state: a brute-force state machine, claims, timers and a worker's loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.shared import shared_dir
from tessera.streaming import keyed

BEGIN = dt.datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + dt.timedelta(seconds=seconds)


def event(job, kind, seconds, worker=None, attempt=None, error=None, done=None, total=None):
    return (job, kind, worker, attempt, error, done, total, at(seconds))


@pytest.fixture
def feed(spark):
    """Each list of events is a micro-batch; gives all that happened."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, v in keyed.STORE.items():
        spark.conf.set(k, v)

    def run(batches, late="0 seconds", jobs=None):
        path, out, checkpoint = (f"{shared_dir(spark)}/{x}" for x in ("events", "out", "checkpoint"))
        for rows in batches:
            spark.createDataFrame(rows, keyed.EVENT).coalesce(1).write.mode("append").parquet(path)
            stream = keyed.job_stream(spark.readStream.schema(keyed.EVENT).parquet(path), late, jobs)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(keyed.OUT).parquet(out).orderBy("at", "job_id").collect()

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_claims_timers_and_outdated_workers(feed):
    batches = [
        [event(1, "create", 0), event(2, "create", 0), event(3, "create", 0), event(9, "beat", 0, "a", 1)],
        # both workers get job 1's message; job 2's worker reports, job 3's falls silent
        [event(1, "deliver", 1, "a"), event(1, "deliver", 2, "b"), event(2, "deliver", 1, "a"), event(3, "deliver", 1, "b")],
        [event(1, "progress", 60, "a", 1, None, 5, 9), event(2, "fail", 60, "a", 1, "boom")],
        [event(1, "beat", 110, "a", 1), event(2, "deliver", 70, "b")],
        [event(1, "succeed", 125, "a", 1)],
        [event(3, "deliver", 126, "a"), event(4, "create", 130)],
        [event(3, "succeed", 131, "b", 1), event(3, "succeed", 132, "a", 2), event(4, "beat", 300, "a", 1)],
    ]
    happened = [(r.job_id, (r.at - BEGIN).total_seconds(), r.what, r.worker, r.attempt) for r in feed(batches)]
    assert [x[1:] for x in happened if x[0] == 1] == [(0, "queued", None, 0), (1, "run", "a", 1), (2, "refused", "b", 1), (60, "progress", "a", 1), (110, "beat", "a", 1), (125, "succeeded", "a", 1)]
    two = [x[1:] for x in happened if x[0] == 2]
    assert two == [(0, "queued", None, 0), (1, "run", "a", 1), (60, "retry", "a", 1), (70, "refused", "b", 1), (90, "due", "a", 1)]
    three = [x[1:] for x in happened if x[0] == 3]
    assert three == [(0, "queued", None, 0), (1, "run", "b", 1), (121.001, "stale", "b", 1), (126, "run", "a", 2), (131, "ignored", "b", 2), (132, "succeeded", "a", 2)]
    assert [x[2] for x in happened if x[0] == 9] == ["ignored"]


def test_jobs_of_a_table(spark, feed):
    """What ran or waited before goes on: silent ones are lost, and fail without attempts left."""
    rows = [(1, "running", 1, at(-500), at(0), None), (2, "running", 3, at(-500), at(0), "earlier"), (3, "queued", 1, at(50), None, None), (4, "succeeded", 1, at(0), None, None)]
    jobs = spark.createDataFrame(rows, "id long, status string, attempts int, run_after timestamp, heartbeat_at timestamp, last_error string")
    happened = {(r.job_id, (r.at - BEGIN).total_seconds(), r.what, r.last_error) for r in feed([[event(8, "create", 10)], [event(8, "beat", 400, "a", 1)], [event(8, "beat", 500, "a", 1)]], jobs=jobs)}
    assert {(1, 120.001, "stale", None), (2, 120.001, "failed", "earlier"), (3, 50, "due", None)} <= happened
    assert not any(x[0] == 4 for x in happened)


def brute(events):
    """{job: (status, attempts, progress, error)} after events in their order, by plain rules, and how often each ran."""
    jobs, runs = {}, {}
    for job, kind, worker, attempt, error, done, total, now in sorted(events, key=lambda e: e[-1]):
        j = jobs.get(job)
        if j is None:
            if kind == "create":
                jobs[job] = {"s": "queued", "n": 0, "after": now, "beat": None, "p": (0, 0), "e": None}
            continue
        silent = j["s"] == "running" and j["beat"] < now - dt.timedelta(seconds=120)
        if silent:  # a timer has gone off meanwhile
            j |= {"s": "failed", "e": j["e"] or keyed.LOST} if j["n"] >= 3 else {"s": "queued"}
        if kind == "deliver" and j["s"] == "queued" and j["after"] <= now:
            j |= {"s": "running", "n": j["n"] + 1, "beat": now}
            runs[job] = runs.get(job, 0) + 1
        elif kind in ("beat", "progress", "succeed", "fail") and j["s"] == "running" and attempt == j["n"]:
            j["beat"] = now
            if kind == "progress":
                j["p"] = (done, total)
            if kind == "succeed":
                j |= {"s": "succeeded", "e": None}
            if kind == "fail":
                j["e"] = error
                if j["n"] < 3:
                    j |= {"s": "queued", "after": now + dt.timedelta(seconds=min(30 * 2 ** (j["n"] - 1), 900))}
                else:
                    j["s"] = "failed"
    return {k: (j["s"], j["n"], j["p"], j["e"]) for k, j in jobs.items()}, runs


def test_like_brute_force(feed):
    r = random.Random(11)
    events, now = [event(j, "create", 0) for j in range(12)], 0
    batches = [events]
    for _ in range(6):
        batch = []
        for _ in range(30):
            now += r.choice((1, 5, 20))
            kind = r.choice(("deliver", "deliver", "beat", "progress", "succeed", "fail"))
            batch.append(event(r.randrange(13), kind, now, r.choice("ab"), r.randint(1, 3), "e" if kind == "fail" else None, now, 9))
        now += r.choice((0, 150))
        batches.append(batch)
    batches.append([event(99, "create", now + 10_000)])
    batches.append([event(99, "beat", now + 10_001, "a", 1)])
    got, last, runs = feed(batches), {}, {}
    order = {"stale": 0, "failed": 0, "due": 0}
    for x in sorted(got, key=lambda x: (x.at, order.get(x.what, 1))):
        if x.status and x.what != "due":
            last[x.job_id] = (x.status, x.attempt, (x.entities_done, x.entities_total), x.last_error)
        runs[x.job_id] = runs.get(x.job_id, 0) + (x.what == "run")
    want, ran = brute([e for b in batches for e in b])
    # what is silent at the end is lost by a timer; later events of others move the watermark
    end = {j: ("failed" if n >= 3 else "queued", n, p, e or keyed.LOST if n >= 3 else e) if s == "running" else (s, n, p, e) for j, (s, n, p, e) in want.items()}
    assert {j: n for j, n in runs.items() if n} == ran
    assert {j: v for j, v in last.items() if j != 99} == {j: v for j, v in end.items() if j != 99}


def test_a_worker_runs_and_sends(spark, feed, tmp_path):
    path, ran = f"{shared_dir(spark)}/events", []
    spark.createDataFrame([event(1, "create", 0), event(2, "create", 0)], keyed.EVENT).write.parquet(path)
    checkpoint, time = f"{shared_dir(spark)}/c", [0]

    def run(mine):
        ran.extend((r.job_id, r.attempt) for r in mine.collect())
        return mine.select("job_id", F.when(F.col("job_id") == 2, "boom").alias("error"))

    for _ in range(4):
        time[0] += 40
        stream = keyed.job_stream(spark.readStream.schema(keyed.EVENT).parquet(path), "0 seconds")
        keyed.work(stream, path, run, checkpoint, "a", lambda: at(time[0]), once=True).awaitTermination()
    events = [(r.job_id, r.kind, r.attempt) for r in spark.read.parquet(path).orderBy("at").collect()]
    assert ran[:2] in ([(1, 1), (2, 1)], [(2, 1), (1, 1)]) and (1, "succeed", 1) in events and (2, "fail", 1) in events
    assert sum(j == 1 for j, _ in ran) == 1
