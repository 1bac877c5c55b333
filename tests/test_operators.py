"""Edge cases of the retrieval, job and text operators on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import entities as E
from tessera.operators import jobs as J
from tessera.operators import latency as L
from tessera.operators import retrieval as R
from tessera.streaming import jobs as stream


def ranking(spark, name, ids):
    return spark.createDataFrame([(name, i, n + 1) for n, i in enumerate(ids)], "retriever string, entity_id long, rank long")


@pytest.mark.parametrize("lists, expected", [([[]], []), ([[], []], []), ([[3, 1, 2]], [3, 1, 2]), ([[7, 9], [8, 9]], [9, 7, 8]), ([[1, 2], [2, 1]], [1, 2])])
def test_fusion(spark, lists, expected):
    fused = R.rrf([ranking(spark, str(i), ids) for i, ids in enumerate(lists)])
    assert [r.entity_id for r in R.order(fused).collect()] == expected


def test_fusion_scores(spark):
    assert R.rrf([ranking(spark, "a", [4]), ranking(spark, "b", [4])]).first().score == pytest.approx(2 / 61)
    top = R.normalised(R.rrf([ranking(spark, "a", [5, 6])])).orderBy("entity_id").collect()
    assert top[0].score == 1.0 and top[1].score == pytest.approx(61 / 62)


def test_clean_matches(spark):
    raw = spark.createDataFrame([("7", 0.5), ("x", 0.4), (None, 0.3), ("8", None)], "id string, score double")
    assert {tuple(r) for r in R.clean_matches(raw).collect()} == {(7, 0.5), (8, 0.0)}


def test_keyword(spark):
    rows = spark.createDataFrame([(1, "backoff_delay", "how long to wait before retrying"), (2, "unrelated", "something else"), (3, None, None)], "entity_id long, name string, about string")
    find = lambda q: [r.entity_id for r in R.keyword_topk(rows, q, {"A": "name", "B": "about"}).collect()]
    assert find("backoff_delay") == [1] and find("retrying") == [1] and find('"wait before" -else') == [1]
    assert find("retrying or else") == [1, 2] and find("before wait") == [1] and find('"before wait"') == []
    assert find("") == find("  ") == find("zzzz") == find("!!!") == []
    with pytest.raises(ValueError):
        R.hybrid(rows, rows, -1)


def test_cover_density():
    # two covers of (a, b): next to each other, and with one word between
    assert T.cover_density([(0, "a", 1.0), (1, "b", 1.0)], {"a", "b"}) == pytest.approx(1.0)
    assert T.cover_density([(0, "a", 0.1), (2, "b", 0.1)], {"a", "b"}) == pytest.approx(0.1 / 2)
    assert T.cover_density([(0, "a", 1.0)], {"a", "b"}) == 0.0


def test_dedupe_keeps_the_last(spark):
    rows = spark.createDataFrame([("a", "x", 1, "old"), ("a", "x", 2, None), ("a", "y", 0, "one")], "file_path string, qualname string, ordinal long, v string")
    assert {tuple(r) for r in E.dedupe_last_wins(rows).collect()} == {("a", "x", 2, None), ("a", "y", 0, "one")}


def test_new_ids_follow_on(spark):
    rows = spark.createDataFrame([("f", str(i)) for i in range(500)], "file_path string, qualname string")
    got = E.new_ids(rows.repartition(3), F.lit(11)).collect()
    assert sorted(r.id for r in got) == list(range(11, 511))
    assert {r.qualname: r.id for r in got} == {r.qualname: r.id for r in E.new_ids(rows.repartition(7), F.lit(11)).collect()}


def test_backoff(spark):
    got = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 6, 99)], "n int").select(J.backoff_seconds(F.col("n"))).collect()
    assert [r[0] for r in got] == [30, 30, 60, 120, 900, 900]


def test_claim_and_fail(spark):
    now = dt.datetime(2024, 1, 1, 12)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [(1, 1, "queued", 0, ago(1), None), (2, 1, "queued", 0, ago(-9), None), (3, 1, "running", 1, ago(999), ago(10)), (4, 1, "running", 1, ago(999), ago(121)), (5, 1, "running", 2, ago(999), None), (6, 1, "succeeded", 1, ago(9), None)]
    schema = "id long, project_id long, status string, attempts int, run_after timestamp_ntz, heartbeat_at timestamp_ntz"
    none = F.lit(None)
    jobs = spark.createDataFrame(rows, schema).withColumns({"started_at": none.cast("timestamp_ntz"), "finished_at": none.cast("timestamp_ntz"), "last_error": none.cast("string")})
    claimed = J.claim(jobs, F.lit(True), F.lit(now).cast("timestamp_ntz"))
    assert {r.id: (r.status, r.attempts) for r in claimed.collect()} == {1: ("running", 1), 2: ("queued", 0), 3: ("running", 1), 4: ("running", 2), 5: ("running", 3), 6: ("succeeded", 1)}
    failed = {r.id: r for r in J.fail(claimed, F.col("status") == "running", F.lit("x" * 3000), F.lit(now).cast("timestamp_ntz")).collect()}
    assert failed[4].status == "queued" and failed[4].run_after == now + dt.timedelta(seconds=60)
    assert failed[5].status == "failed" and len(failed[5].last_error) == 2000 and failed[6].status == "succeeded"


def test_latency_of_one_and_of_none(spark):
    one = L.summary(spark.createDataFrame([(1, 5.0, 200)], "sample_id long, ms double, status int")).first()
    assert (one.n, one.p50_ms, one.p99_ms, one.stdev_ms) == (1, 5.0, 5.0, 0.0)
    none = L.summary(spark.createDataFrame([(1, 5.0, 500)], "sample_id long, ms double, status int")).first()
    assert none.n == 0 and none.failures == 1 and none.p50_ms is None


def test_messages_are_delivered_once(spark, tmp_path):
    path, seen = str(tmp_path / "queue"), []
    for _ in range(2):
        stream.send(spark.createDataFrame([(1,), (2,)], "id long"), path)
    done = stream.work(stream.messages(spark, path), lambda df, n: seen.extend(r.job_id for r in df.collect()), str(tmp_path / "checkpoint"), once=True)
    assert done.awaitTermination(120) and sorted(seen) == [1, 2]


def test_plans(spark, sf_dir):
    """Filters reach the scan, only needed columns are read, and a top-k needs no full sort."""
    from tessera.plans import registry

    plan = registry.QUERIES["job_claimable"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "props" not in plan
    assert "TakeOrderedAndProject" in registry.QUERIES["dense_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_search_answers_every_query(spark, sf_dir, tmp_path):
    from tessera.plans import registry

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = {r.vec_id: r.embedding for r in vectors.where("vec_id % 100 = 0").collect()}
    got = registry.QUERIES["hybrid_search"](spark, sf_dir).collect()
    assert len(asked) > 1 and {r.query_id for r in got} == set(asked)
    rows = vectors.select(F.col("vec_id").alias("entity_id"), "embedding")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (2, 2048):
        many = R.dense_topk_batch(rows, queries, 7, block).collect()
        for q, v in asked.items():
            one = R.dense_topk(rows, [float(x) for x in v], 7).collect()
            assert sorted((-r.score, r.entity_id) for r in many if r.query_id == q) == [(-r.score, r.entity_id) for r in one]
    # ties go by id over all tasks, vectors without a score come last
    odd = spark.createDataFrame([*((i, [1.0, 1.0]) for i in range(600, 0, -1)), (601, [0.0, 0.0]), (602, None), (603, [1.0])], "entity_id long, embedding array<float>").repartition(3)
    few = spark.createDataFrame([(9, [2.0, 2.0])], "query_id long, embedding array<float>")
    assert sorted(r.entity_id for r in R.dense_topk_batch(odd, few, 5).collect()) == [1, 2, 3, 4, 5]
    last = R.dense_topk_batch(odd.where("entity_id > 598"), few, 4).collect()
    assert sorted((r.entity_id, r.score) for r in last if r.score) == [(599, 1.0), (600, 1.0)] and {r.entity_id for r in last if r.score is None} == {601, 602}
    # a table without vec_id 0
    vectors.where("vec_id > 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["dense_topk"](spark, str(tmp_path)).count() == 0
    assert {r.query_id for r in registry.QUERIES["dense_topk_batch"](spark, str(tmp_path)).collect()} == set(asked) - {0}


def test_percentiles_are_nearest_ranks(spark):
    """A value that a third of the rows share, groups of one row and of none, more values than ranges."""
    groups = {"many": [7] * 500 + list(range(1000)), "one": [3], "none": [None], "ties": [1, 1, 2, 2]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "stage string, ms long")
    got = {r.stage: (r.p50_ms, r.p99_ms) for r in L.percentiles(df, (50, 99), ("stage",)).collect()}
    rank = lambda vs, p: sorted(vs)[-(-p * len(vs) // 100) - 1] if vs != [None] else None
    assert got == {g: (rank(vs, 50), rank(vs, 99)) for g, vs in groups.items()}
    assert [tuple(r) for r in L.percentiles(df.limit(0).select("ms"), (50,)).collect()] == [(None,)]
