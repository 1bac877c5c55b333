"""Search in a project, search vectors, labels, and the life of projects and jobs, on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entities as E
from tessera.operators import evaluation as V
from tessera.operators import jobs as J
from tessera.operators import latency as L
from tessera.operators import projects as P
from tessera.operators import retrieval as R
from tessera.sources import code, tables
from tessera.streaming import jobs as stream

NOW = dt.datetime(2024, 1, 1, 12)


def at():
    return F.lit(NOW).cast("timestamp_ntz")


def ago(seconds):
    return NOW - dt.timedelta(seconds=seconds)


def jobs(spark, rows):
    none = F.lit(None)
    df = spark.createDataFrame(rows, "id long, project_id long, status string, attempts int, run_after timestamp_ntz, heartbeat_at timestamp_ntz")
    return df.withColumns({"started_at": none.cast("timestamp_ntz"), "finished_at": none.cast("timestamp_ntz"), "last_error": none.cast("string"), "entities_total": F.lit(0), "entities_done": F.lit(0)})


def projects(spark, *rows):
    return spark.createDataFrame(rows, "id long, owner_id long, name string, status string, error_message string, created_at timestamp_ntz")


def test_stems():
    assert [T.stem_of(w) for w in ("retries", "retrying", "boxes", "this", "class", "waited", "used", "use", "thing", "need", "parses", "parsed")] == ["retry", "retry", "box", "this", "class", "wait", "us", "us", "thing", "need", "pars", "pars"]


def test_search_vectors(spark):
    rows = spark.createDataFrame([(1, "RetryPolicy", "how long we are waiting"), (2, None, "the waits of boxes"), (3, "", None)], "entity_id long, name string, about string")
    stored = R.with_search_vector(rows, {"A": "name", "B": "about"})
    got = {r.entity_id: [tuple(x) for x in r.search_vector] for r in stored.collect()}
    assert got == {1: [("retrypolicy", 0, "A"), ("long", 2, "B"), ("wait", 5, "B")], 2: [("wait", 1, "B"), ("box", 3, "B")], 3: []}
    find = lambda q: [r.entity_id for r in R.keyword_topk(stored, q).collect()]
    assert find("wait") == [1, 2] and find("waited box") == [2] and find('"long are waiting"') == [] and find('"long we are waiting"') == [1] and find("the of") == []
    assert find("waits -box") == [1] and find("box or retrypolicy") == [1, 2] and find("") == []
    for row in stored.collect():
        places = [(x.at, x.lexeme, T.WEIGHTS[x.letter]) for x in row.search_vector]
        for q, terms in (("wait", {"wait"}), ("wait box", {"wait", "box"}), ("long wait", {"long", "wait"})):
            rank = stored.where(F.col("entity_id") == row.entity_id).select(T.cover_rank(F.col("search_vector"), q)).first()[0]
            assert rank == pytest.approx(T.cover_density(places, terms))


def test_search(spark):
    seen = []
    embed = lambda q: seen.append(q) or [1.0, 0.0]
    entity = spark.createDataFrame([(1, "p", "a.py", "near"), (2, "p", "b.py", "word"), (3, "q", "c.py", "word"), (5, "p", None, "far")], "id long, project_id string, file_path string, qualname string")
    entity = entity.withColumns({c: F.lit(None).cast("string") for c in ("entity_type", "signature", "source_code", "description")} | {c: F.lit(None).cast("int") for c in ("start_line", "end_line")})
    entity = R.with_search_vector(entity, {"A": "qualname"})
    vectors = spark.createDataFrame([("p", 1, [1.0, 0.1]), ("p", 2, [0.5, 0.5]), ("q", 3, [1.0, 0.0]), ("p", 4, [1.0, 0.0]), ("p", 5, [0.0, 1.0])], "project_id string, entity_id long, embedding array<double>")
    known = spark.createDataFrame([("p", "ready"), ("q", "indexing")], "id string, status string")
    got = R.search(known, "p", entity, vectors, "words", embed).collect()
    # 2 is third by vector and first by word; 4 has no entity; 3 is another project's
    assert [r.entity_id for r in got] == [2, 1, 5] and got[0].score == 1.0
    assert got[2].file_path == "" and got[2].start_line == 0
    assert [r.entity_id for r in R.search(known, "p", entity, vectors, " ", embed, 2).collect()] == [1]
    assert R.search(known, "p", entity, vectors, "words", embed, 0).collect() == []
    before = len(seen)
    for project, error in (("q", ValueError), ("x", LookupError)):
        with pytest.raises(error):
            R.search(known, project, entity, vectors, "words", embed)
    with pytest.raises(ValueError):
        R.search(known, "p", entity, vectors, "words", embed, -1)
    assert len(seen) == before  # no paid call
    assert {r.entity_id for r in R.drop_namespace(vectors, "p").collect()} == {3}


def test_hydration_keeps_the_order(spark):
    top = spark.createDataFrame([(1, 0.5, 3), (2, 0.5, 1), (3, 1.0, 2), (9, 0.9, 1)], "entity_id long, score double, best_rank int")
    rows = spark.createDataFrame([(i, f"n{i}") for i in (1, 2, 3)], "entity_id long, name string")
    assert [r.n for r in R.hydrated(top, rows, {"n": F.col("name")}).collect()] == ["n3", "n2", "n1"]


def test_labels(spark):
    catalogue = spark.createDataFrame([(1, "backend/app/core/s.py", "login"), (2, "backend/app/api/s.py", "login"), (3, "core\\s.py", "A::b"), (4, "x.py", "go")], "entity_id long, file_path string, qualname string")
    labels = spark.createDataFrame([(1, "app/core/s.py::login"), (1, "deep/backend/app/api/s.py::login"), (2, "x.py::stop"), (3, "go")], "query_id long, label string")
    assert {(r.query_id, r.entity_id) for r in V.label_match(labels, catalogue).collect()} == {(1, 1), (1, 2), (3, 4)}
    ranking = spark.createDataFrame([(1, 99, 1), (1, 2, 2), (1, 4, 3), (2, 4, 1)], "query_id long, entity_id long, rank long")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.first_hit, r.found, r.wanted) for r in V.label_outcomes(queries, ranking, labels, catalogue).collect()}
    assert got == {1: (1, 1, 2), 2: (None, 0, 1), 3: (None, 0, 1)}  # 99 is unknown, so ranks close up
    assert {r.label for r in V.unknown_labels(labels, catalogue).collect()} == {"app/core/s.py::login", "deep/backend/app/api/s.py::login", "x.py::stop", "go"}
    missed = {r.query_id: (r.reason, r.top1) for r in V.misses(V.label_outcomes(queries, ranking, labels, catalogue), ranking).collect()}
    assert missed == {2: ("not in top 10", 4), 3: ("not in top 10", None)}


def test_strategies(spark):
    dense = spark.createDataFrame([(1, i, 1.0 / i) for i in range(1, 13)], "query_id long, entity_id long, score double")
    keyword = spark.createDataFrame([(1, 30, 2.0), (1, 2, 1.0)], "query_id long, entity_id long, score double")
    got = {name: [r.entity_id for r in df.orderBy("rank").collect()] for name, df in V.strategies(dense, keyword).items()}
    assert got["dense"] == list(range(1, 11)) and got["keyword"] == [30, 2] and got["hybrid"][:3] == [2, 1, 30] and len(got["hybrid"]) == 10


def test_jargon(spark):
    queries = spark.createDataFrame([(1, "rotate the 'flux' capacitor?", "jargon"), (2, "plain Words, here", "jargon"), (3, "of the", "jargon"), (4, "words", "natural")], "query_id long, query string, category string")
    sources = spark.createDataFrame([("Some WORDS", ), ("plainly here", ), (None, )], "source_code string")
    assert [r.query_id for r in V.plain_jargon(queries, sources).collect()] == [2]


def test_heartbeat_and_success(spark):
    rows = jobs(spark, [(1, 1, "running", 1, ago(9), ago(9)), (2, 1, "queued", 0, ago(9), None)])
    beaten = {r.id: r.heartbeat_at for r in J.heartbeat(rows, F.lit(True), at()).collect()}
    assert beaten == {1: NOW, 2: None}
    done = {r.id: r for r in J.succeed(rows.withColumn("last_error", F.lit("e")), F.col("id") == 1, at()).collect()}
    assert (done[1].status, done[1].finished_at, done[1].heartbeat_at, done[1].last_error) == ("succeeded", NOW, None, None) and done[2].status == "queued"


def test_a_second_worker_claims_nothing(spark):
    rows = jobs(spark, [(1, 1, "queued", 0, ago(1), None)])
    once = J.claim(rows, F.lit(True), at())
    again = J.claim(once, F.lit(True), at()).first()
    assert again.attempts == 1 and again.status == "running"
    later = J.claim(once, F.lit(True), at() + F.expr("interval 121 seconds")).first()
    assert later.attempts == 2


def test_progress(spark):
    rows = jobs(spark, [(1, 1, "running", 1, ago(9), None), (2, 1, "queued", 0, ago(9), None)])
    got = {r.id: (r.entities_done, r.entities_total, r.heartbeat_at) for r in J.record_progress(rows, spark.createDataFrame([(1, 5, 9)], "id long, done int, total int"), at()).collect()}
    assert got == {1: (5, 9, NOW), 2: (0, 0, None)}
    diffed = spark.createDataFrame([("f", str(i), "changed" if i < 450 else "moved") for i in range(500)], "file_path string, qualname string, bucket string")
    assert sorted((r.chunk, r.done, r.total) for r in E.progress(diffed, rows_a_bucket=70).collect()) == [(0, 250, 500), (1, 450, 500), (2, 500, 500)]


def test_reconcile(spark):
    rows = jobs(spark, [(1, 1, "queued", 3, ago(9), None), (2, 2, "running", 1, ago(999), ago(999)), (3, 3, "running", 1, ago(9), ago(9)), (4, 4, "running", 3, ago(9), None), (5, 4, "queued", 0, ago(9), None)])
    done = J.reconcile(rows, at())
    got = {r.id: (r.status, r.finished_at, r.last_error) for r in done.collect()}
    assert got == {1: ("failed", NOW, J.ABANDONED), 2: ("queued", None, None), 3: ("running", None, None), 4: ("failed", NOW, J.ABANDONED), 5: ("queued", None, None)}
    assert {r.id for r in J.redeliver(done).collect()} == {2, 5}
    owned = projects(spark, *((i, 1, "n", "indexing", "old", NOW) for i in range(1, 6)))
    got = {r.id: (r.status, r.error_message) for r in P.after_reconcile(owned, done).collect()}
    assert got == {1: ("failed", P.INTERRUPTED), 2: ("queued", "old"), 3: ("indexing", "old"), 4: ("failed", P.INTERRUPTED), 5: ("indexing", "old")}


def test_projects(spark):
    asked = spark.createDataFrame([(1, 7, None, "https://h/a/b.git"), (2, 7, "own", "https://h/a/c/"), (3, 7, None, "https://h/")], "id long, owner_id long, name string, url string")
    made = P.create(asked, code.repository(F.col("url")), at())
    assert {(r.id, r.name, r.namespace, r.status) for r in made.collect()} == {(1, "b", "1", "queued"), (2, "own", "2", "queued")}
    assert [r.id for r in P.refused(asked, code.repository(F.col("url"))).collect()] == [3]
    new = {r.project_id: (r.id, r.status, r.attempts, r.run_after) for r in J.create(made, F.col("id") + 100, at()).collect()}
    assert new == {1: (101, "queued", 0, NOW), 2: (102, "queued", 0, NOW)}
    held = projects(spark, (1, 7, "a", "failed", "e", ago(5)), (2, 7, "b", "ready", None, ago(1)), (3, 8, "c", "ready", None, NOW))
    assert [r.id for r in P.newest(held, 7).collect()] == [2, 1]
    running = jobs(spark, [(1, 2, "running", 1, ago(9), ago(9)), (2, 1, "failed", 3, ago(9), None)])
    after, verdicts = P.request_reindex(held, running, spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long"))
    assert {tuple(r) for r in verdicts.collect()} == {(1, "queued"), (2, "busy"), (9, "unknown")}
    assert {r.id: (r.status, r.error_message) for r in after.collect()} == {1: ("queued", None), 2: ("ready", None), 3: ("ready", None)}
    assert {r.id for r in P.delete(held, 7, 3).collect()} == {1, 2, 3} and {r.id for r in P.delete(held, 8, 3).collect()} == {1, 2}


def test_worker(spark, tmp_path):
    """Runs succeed, fail and are tried again, fail for good; duplicates are skipped; a job whose project is gone ends."""
    version = [0]

    def store(rows, owned):
        version[0] += 1
        paths = [str(tmp_path / f"{name}{version[0]}") for name in ("jobs", "projects")]
        rows.write.parquet(paths[0])
        owned.write.parquet(paths[1])
        return [spark.read.parquet(p) for p in paths]

    state = store(jobs(spark, [(1, 1, "queued", 0, ago(1), None), (2, 2, "queued", 0, ago(1), None), (3, 3, "queued", 2, ago(1), None), (4, 9, "queued", 0, ago(1), None), (5, 1, "queued", 0, ago(-60), None)]), projects(spark, *((i, 1, "n", "queued", "old", NOW) for i in (1, 2, 3))))
    ran = []

    def keep(rows, owned):
        state[:] = store(rows, owned)
        return state

    def run(claimed):
        ran.extend(r.id for r in claimed.collect())
        return claimed.select("id", F.when(F.col("id") > 1, "boom").alias("error"))

    handle = stream.worker(lambda: state, keep, run, at)
    for _ in range(2):  # delivered twice
        handle(spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "job_id long"), 0)
    assert sorted(ran) == [1, 2, 3]
    assert {r.id: (r.status, r.attempts) for r in state[0].collect()} == {1: ("succeeded", 1), 2: ("queued", 1), 3: ("failed", 3), 4: ("succeeded", 1), 5: ("queued", 0)}
    assert {r.id: (r.status, r.error_message) for r in state[1].collect()} == {1: ("ready", None), 2: ("queued", None), 3: ("failed", P.FAILED)}
    after, owned = stream.sweep(*state, str(tmp_path / "queue"), at(), store)
    assert sorted(r.job_id for r in spark.read.parquet(str(tmp_path / "queue")).collect()) == [2, 5] and owned.count() == 3 and "outcome" not in after.columns


def test_moved_rows_are_updated(spark):
    stored = spark.createDataFrame([(1, "f", "a", "h", 1, 2, None, ago(9)), (2, "f", "b", "h", 1, 2, None, ago(9))], "id long, file_path string, qualname string, content_hash string, start_line int, end_line int, last_seen_run string, updated_at timestamp_ntz")
    parsed = spark.createDataFrame([("f", "a", "h", 5, 6), ("f", "b", "h", 1, 2)], "file_path string, qualname string, content_hash string, start_line int, end_line int")
    got = {r.id: (r.last_seen_run, r.updated_at, r.start_line) for r in E.mark_seen(stored, E.diff(parsed, stored), "run", now=at()).collect()}
    assert got == {1: ("run", NOW, 5), 2: ("run", ago(9), 1)}


def test_pruned_directories(spark, tmp_path):
    for name in (*code.PRUNED, "x.egg-info", "build", "dist", "pkg"):
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "m.py").write_text("def f(): pass\n")
    assert {r.file_path for r in code.scan_files(spark, str(tmp_path / "r")).collect()} == {"build/m.py", "dist/m.py", "pkg/m.py"}


def test_json(spark, tmp_path):
    path = str(tmp_path / "golden.json")
    with open(path, "w") as f:
        json.dump({"corpus": "c", "categories": {"natural": "n"}, "queries": [{"id": 1, "query": "q", "category": "natural", "expected": ["a::b", "c::d"]}, {"id": 2, "query": "r", "category": "trap", "expected": [], "note": "n"}]}, f, indent=1)
    queries, labels = tables.golden_set(spark, path)
    assert {(r.query_id, r.note) for r in queries.collect()} == {(1, None), (2, "n")} and [r.label for r in labels.collect()] == ["a::b", "c::d"]
    tables.save_results(spark.createDataFrame([("dense", 0.5)], "strategy string, mrr double"), spark.createDataFrame([("dense", 2, None), ("dense", 1, 3)], "strategy string, query_id long, first_hit long"), str(tmp_path / "out"))
    saved = json.loads(next((tmp_path / "out").glob("part-*")).read_text())
    assert saved["mrr"] == 0.5 and [o["query_id"] for o in saved["outcomes"]] == [1, 2]
    assert tables.lookup(queries, query_id=2)["note"] == "n" and tables.lookup(queries, query_id=3) is None


def test_latency_report(spark):
    rows = spark.createDataFrame([(0, 99.0, 200, 1), (1, 5.0, 200, 4), (2, 6.0, 500, 0), (3, 7.0, 200, 6)], "nth long, ms double, status int, results int")
    got = L.report(rows, warmup=1).first()
    assert (got.n, got.failures, got.max_ms, got.mean_results) == (2, 1, 7.0, 5.0)
    with pytest.raises(ValueError):
        L.report(rows.where("status = 500"))
    pool = L.query_pool(*(spark.createDataFrame(p, "query string, place int") for p in ([("a", 0), ("b", 1)], [("b", 0), ("c", 1)])))
    assert [r["query"] for r in pool.orderBy("pool", "place").collect()] == ["a", "b", "c"]
    got = {r.nth: r["query"] for r in L.query_order(pool, 7, 3).collect()}
    assert set(got) == set(range(7)) and got[0] == got[3] == got[6] and {got[0], got[1], got[2]} == {"a", "b", "c"}
