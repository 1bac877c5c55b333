"""Entities and vectors of projects as partitioned snapshots that change together.

Both tables lie in folders by project, part (a hash of the file) and run. A run writes new folders
for the parts that it changed, entities first, then vectors, and last one row of `runs` with its
commit and the parts it wrote. Readers join that row: of each part they see the last run that has
one, so a run that ends before it leaves nothing to see, and the parts it didn't touch stay where they
are. Runs of a store go one after the other.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import ENTITY

VECTOR = "entity_id long, embedding array<float>, entity_type string"
RUN = "project_id string, run string, commit string, parts array<int>, top long, at timestamp"
FOLDER = ["project_id", "part", "run"]


class Store(NamedTuple):
    spark: SparkSession
    root: str
    parts: int = 16


def part_of(path: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


def created(spark: SparkSession, root: str, parts: int = 16) -> Store:
    """A new, empty store; the number of parts is fixed."""
    store = Store(spark, root, parts)
    spark.createDataFrame([(parts,)], "parts int").coalesce(1).write.parquet(f"{root}/shape")
    spark.createDataFrame([], RUN).write.parquet(f"{root}/runs")
    for name, columns in (("entities", f"{ENTITY}, search_vector {T.VECTOR}, part int, run string"), ("vectors", f"{VECTOR}, project_id string, part int, run string")):
        spark.createDataFrame([], columns).write.partitionBy(*FOLDER).parquet(f"{root}/{name}")
    return store


def opened(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, spark.read.parquet(f"{root}/shape").first()["parts"])


def runs(store: Store) -> DataFrame:
    return store.spark.read.schema(RUN).parquet(f"{store.root}/runs")


def last_runs(store: Store) -> DataFrame:
    """The last run of each project: project_id, run, commit and at."""
    return runs(store).groupBy("project_id").agg(F.max_by(F.struct("run", "commit", "at"), "run").alias("r")).select("project_id", "r.*")


def _current(store: Store, name: str, columns: str, project_id: str | None) -> DataFrame:
    rows = store.spark.read.schema(f"{columns}, project_id string, part int, run string").parquet(f"{store.root}/{name}")
    seen = runs(store)
    if project_id is not None:
        rows, seen = (x.where(F.col("project_id") == F.lit(project_id)) for x in (rows, seen))
    now = seen.select("project_id", "run", F.explode("parts").alias("part")).groupBy("project_id", "part").agg(F.max("run").alias("run"))
    return rows.join(now, FOLDER)  # folders of other runs are pruned by this join


def entities(store: Store, project_id: str | None = None) -> DataFrame:
    """The entities of a project, or of all, with search_vector; all were seen by its last run."""
    columns = ", ".join([c for c in ENTITY.split(", ") if not c.startswith("project_id ")] + [f"search_vector {T.VECTOR}"])
    rows = _current(store, "entities", columns, project_id).drop("last_seen_run", "part", "run")
    last = last_runs(store).select("project_id", F.col("run").alias("last_seen_run"))
    return rows.join(last, "project_id").select(*[c.split(" ")[0] for c in ENTITY.split(", ")], "search_vector")


def vectors(store: Store, project_id: str | None = None) -> DataFrame:
    """project_id, entity_id, embedding and entity_type of a project's vectors, or of all."""
    return _current(store, "vectors", VECTOR, project_id).select("project_id", "entity_id", "embedding", "entity_type")


def next_run(store: Store) -> tuple[str, int]:
    """A name for the next run, which sorts after all before it, and the greatest id given so far."""
    last = runs(store).agg(F.coalesce(F.max("run"), F.lit("0")).alias("run"), F.coalesce(F.max("top"), F.lit(0)).alias("top")).first()
    return f"{int(last['run'].split('-')[0]) + 1:012d}-{uuid.uuid4().hex}", last["top"]


def put(store: Store, name: str, rows: DataFrame, project_id: str, run: str) -> None:
    """Writes rows (with part) into the run's own folders: nobody sees them before publish()."""
    dealt = rows.withColumns({"project_id": F.lit(project_id), "run": F.lit(run)})
    dealt.repartition("part").write.mode("append").partitionBy(*FOLDER).parquet(f"{store.root}/{name}")


def publish(store: Store, project_id: str, run: str, commit: str | None, parts: list[int], top: int) -> None:
    """The run's row: from now on readers see what it wrote."""
    row = store.spark.createDataFrame([(project_id, run, commit, parts, top)], RUN.rsplit(", ", 1)[0]).withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{store.root}/runs")


def delete_project(store: Store, project_id: str) -> None:
    """A run that leaves a project without rows, vectors and entities in one step."""
    run, top = next_run(store)
    publish(store, project_id, run, None, list(range(store.parts)), top)
