"""An indexing run end to end: durable chunks, bounded calls, deadlines, snapshots that change together, and search."""

import asyncio
import glob
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.plans import chunks, indexing, postings, providers, snapshots
from tessera.plans.index import index, offline_provider
from tessera.schemas import ENTITY, SEARCHED
from tessera.sources import code
from tessera.sources.shared import shared_dir

NOW = "2024-01-01"


def now(day=NOW):
    return F.lit(day).cast("timestamp")


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def sources(n):
    return {f"pkg{i % 3}/m{i}.py": f"def retry_{i}(x):\n    return 'backoff {i}'\n" for i in range(n)}


def counted(folder, fail_at=None):
    """A provider that notes each chunk in a folder, as tasks run in other processes, and fails at one chunk."""

    def call(rows, folder=str(folder)):
        if len(glob.glob(f"{folder}/*")) == fail_at:
            raise RuntimeError("the provider is gone")
        with open(f"{folder}/{time.time_ns()}", "w") as f:
            f.write("\n".join(r[1] for r in rows))
        return offline_provider(rows)

    return call


def paid(folder):
    return [open(f).read().split("\n") for f in glob.glob(f"{folder}/*")]


def test_from_files_to_search(spark, tmp_path):
    root = tree(tmp_path / "src", {**sources(12), "bad.py": "def broken(:\n"})
    store = snapshots.created(spark, f"{shared_dir(spark)}/store", parts=8)
    seen = []
    first = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w1", now(), "c1", chunk=5, on_progress=lambda done, total: seen.append((done, total)))
    assert (first.indexed, first.described, first.reused, first.removed, first.commit) == (12, 12, 0, 0, "c1")
    assert seen[0] == (0, 12) and seen[-1] == (12, 12) and sorted(seen) == seen
    ids = {r.qualname: r.id for r in snapshots.entities(store, "p").collect()}
    assert sorted(ids.values()) == list(range(1, 13))
    known = spark.createDataFrame([("p", "ready")], "id string, status string")

    def found(query):
        embed = lambda q: offline_provider([("", "", "", q)])[0][1]
        return [r.qualname for r in R.search(known, "p", snapshots.entities(store, "p"), snapshots.vectors(store, "p"), query, embed, 3).collect()]

    assert found("retry_7 backoff")[0] == "retry_7"

    # nothing changed: no call, no folder
    paid_for = tmp_path / "calls"
    paid_for.mkdir()
    again = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w2", now(), "c2", calls=counted(paid_for))
    assert (again.described, again.reused, again.reuse_ratio, again.parts) == (0, 12, 1.0, []) and paid(paid_for) == []

    # one file changed: one part of each table is written, ids stay, the commit is the last one's
    folders = lambda name: set(glob.glob(f"{store.root.removeprefix('file:')}/{name}/project_id=p/part=*/run=*"))
    before = {name: folders(name) for name in ("entities", "vectors")}
    tree(tmp_path / "src", {"pkg1/m7.py": "\n\ndef retry_7(x):\n    return 'jitter 7'\n"})
    third = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w3", now("2024-01-02"), "c3", calls=counted(paid_for))
    assert (third.described, third.reused, len(third.parts)) == (1, 11, 1) and paid(paid_for) == [["retry_7"]]
    assert all(len(folders(name) - before[name]) == 1 for name in before)
    rows = {r.qualname: r for r in snapshots.entities(store, "p").collect()}
    assert {q: r.id for q, r in rows.items()} == ids and {r.last_seen_run for r in rows.values()} == {third.run}
    assert (rows["retry_7"].created_at.day, rows["retry_7"].updated_at.day, rows["retry_7"].start_line) == (1, 2, 3)
    assert snapshots.vectors(store, "p").count() == 12 and snapshots.last_runs(store).first()["commit"] == "c3"
    assert found("jitter")[0] == "retry_7"

    # a file is gone, and a second project has ids of its own
    os.remove(tmp_path / "src/pkg0/m0.py")
    fourth = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w4", now(), "c4")
    assert fourth.removed == 1 and fourth.described == 0
    assert {r.entity_id for r in snapshots.vectors(store, "p").collect()} == set(ids.values()) - {ids["retry_0"]}
    other = indexing.index_source(store, "q", root, f"{shared_dir(spark)}/w5", now())
    assert min(r.id for r in snapshots.entities(store, "q").collect()) == 13 and other.described == 11
    assert snapshots.opened(spark, store.root).parts == 8
    snapshots.delete_project(store, "p")
    assert snapshots.entities(store, "p").count() == snapshots.vectors(store, "p").count() == 0 and snapshots.entities(store).count() == 11

    # postings of what is stored answer as its search vectors do
    held = snapshots.entities(store, "q").withColumnRenamed("id", "entity_id")
    made = postings.build(held, SEARCHED, f"{shared_dir(spark)}/postings")
    for query in ("backoff", "retry or jitter", '"return backoff" -m7'):
        assert [tuple(r) for r in postings.keyword_topk(made, query, 5).collect()] == [tuple(r) for r in R.keyword_topk(held, query, None, 5).collect()]
    assert [r.file_path for r in code.unreadable(code.scan_files(spark, root)).collect()] == ["bad.py"]
    listing = spark.createDataFrame([("pkg1/m1.py",), ("gone.py",)], "value string")
    assert [r.file_path for r in code.tracked(code.scan_files(spark, root), listing).collect()] == ["pkg1/m1.py"]


def test_a_restart_pays_for_no_chunk_twice(spark, tmp_path):
    root = tree(tmp_path / "src", sources(23))
    store = snapshots.created(spark, f"{shared_dir(spark)}/store", parts=4)
    folder, work = tmp_path / "calls", f"{shared_dir(spark)}/work"
    folder.mkdir()
    with pytest.raises(Exception, match="provider is gone"):
        indexing.index_source(store, "p", root, work, now(), "c", calls=counted(folder, fail_at=3), chunk=4, parallel=1)
    assert len(paid(folder)) == 3 and snapshots.entities(store, "p").count() == 0 and snapshots.runs(store).count() == 0
    assert chunks.progress(spark, work).agg(F.sum("n")).first()[0] == 12
    done = indexing.index_source(store, "p", root, work, now(), "c", calls=counted(folder), chunk=4, parallel=1)
    names = [n for part in paid(folder) for n in part]
    assert done.described == 23 and len(names) == len(set(names)) == 23
    assert sorted(len(p) for p in paid(folder)) == [3, 4, 4, 4, 4, 4]
    assert snapshots.entities(store, "p").count() == snapshots.vectors(store, "p").count() == 23


def test_a_run_that_dies_between_its_tables_is_invisible(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "src", sources(6))
    store = snapshots.created(spark, f"{shared_dir(spark)}/store", parts=2)
    first = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w", now(), "c1")
    before = {(r.qualname, r.content_hash) for r in snapshots.entities(store, "p").collect()}
    tree(tmp_path / "src", {"pkg1/m1.py": "def retry_1():\n    return 2\n"})
    put = snapshots.put

    def dies(store, name, *rest):
        if name == "vectors":
            raise RuntimeError("lost")
        put(store, name, *rest)

    monkeypatch.setattr(snapshots, "put", dies)
    with pytest.raises(RuntimeError):
        indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w2", now(), "c2")
    assert {(r.qualname, r.content_hash) for r in snapshots.entities(store, "p").collect()} == before
    assert snapshots.last_runs(store).first()["run"] == first.run
    monkeypatch.undo()
    last = indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w3", now(), "c2")
    assert last.described == 1 and snapshots.entities(store, "p").count() == snapshots.vectors(store, "p").count() == 6


def test_calls_are_bounded_and_in_order():
    running, most, tries = [0], [0], {}

    async def describe(row):
        tries[row[1]] = tries.get(row[1], 0) + 1
        if row[1] == "3" and tries["3"] < 3:
            raise ConnectionError("once more")
        running[0] += 1
        most[0] = max(most[0], running[0])
        await asyncio.sleep(0.03 / (1 + int(row[1]) % 5))
        running[0] -= 1
        return None if row[1] == "4" else f"d{row[1]}"

    async def embed(texts):
        return [[float(len(t))] for t in texts]

    rows = [("function", str(i), "", "") for i in range(230)]
    got = providers.provided(rows, providers.Calls(describe, embed, pause_s=0.001), in_flight=7)
    assert [d for d, _ in got] == ["" if i == 4 else f"d{i}" for i in range(230)] and most[0] == 7 and tries["3"] == 3
    assert [v for _, v in got] == [[float(len(d))] for d, _ in got] and providers.provided([], None) == []

    async def hangs(row):
        await asyncio.sleep(60)

    began = time.time()
    with pytest.raises(TimeoutError):
        providers.provided(rows[:3], providers.Calls(hangs, embed, attempts=1, timeout_s=0.1))
    with pytest.raises(ValueError):
        providers.provided(rows[:3], providers.Calls(describe, lambda t: asyncio.sleep(0, [[1.0]])))
    assert time.time() - began < 10


def test_a_run_over_its_deadline_is_ended(spark, tmp_path):
    def hangs(rows):
        time.sleep(120)
        return offline_provider(rows)

    root = tree(tmp_path / "src", sources(3))
    store = snapshots.created(spark, f"{shared_dir(spark)}/store")
    began = time.time()
    with pytest.raises(TimeoutError):
        indexing.index_source(store, "p", root, f"{shared_dir(spark)}/w", now(), seconds=12, calls=hangs)
    assert time.time() - began < 60 and snapshots.runs(store).count() == 0
    with providers.deadline(spark, 60):
        assert spark.range(3).count() == 3
    assert threading.active_count() < 60


def test_an_index_run_keeps_the_search_vector(spark, tmp_path):
    """index() takes a table that search() can read."""
    stored = R.with_search_vector(spark.createDataFrame([], ENTITY), SEARCHED)
    none = spark.createDataFrame([], "entity_id long, embedding array<float>, entity_type string")
    count = [0]

    def write(df):
        count[0] += 1
        df.write.parquet(str(tmp_path / f"t{count[0]}"))
        return spark.read.parquet(str(tmp_path / f"t{count[0]}"))

    parsed = code.parse_files(code.scan_files(spark, tree(tmp_path / "src", sources(2))))
    rows, _, _ = index(parsed, stored, none, "p", "r", now(), write)
    assert [r.entity_id for r in R.keyword_topk(rows.withColumnRenamed("id", "entity_id"), "backoff").collect()] == [1, 2]
