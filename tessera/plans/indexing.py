"""An indexing run from source files to a searchable project: scan, parse, diff, enrich in durable chunks, publish."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..schemas import ENTITY, KEYS, SEARCHED
from ..sources import code
from ..sources.shared import written
from . import chunks, snapshots
from .index import offline_provider
from .providers import DEADLINE_S, IN_FLIGHT, deadline


class Result(NamedTuple):
    indexed: int
    removed: int
    described: int
    reused: int
    run: str
    commit: str | None
    parts: list[int]

    @property
    def reuse_ratio(self) -> float:
        both = self.described + self.reused
        return self.reused / both if both else 0.0


def index_parsed(store: snapshots.Store, project_id: str, parsed: DataFrame, work: str, now: Column, commit: str | None = None, calls=offline_provider, chunk: int = chunks.CHUNK, parallel: int = chunks.PARALLEL, in_flight: int = IN_FLIGHT, on_progress=None) -> Result:
    """Brings a project to what was parsed, and publishes the run with its commit at the end.

    Only definitions whose source changed are described and embedded, chunk by chunk below work, a
    folder for this job and commit: a restart with it goes on where it was. Rows keep their id
    and created_at; only the parts (hashes of files) with a changed, moved or vanished row are
    written again. on_progress(done, total) counts reused rows from the start. A failure before
    the end leaves the project as it was.
    """
    stored = snapshots.entities(store, project_id)
    part = snapshots.part_of(F.col("file_path"), store.parts)
    diffed = written(E.diff(E.dedupe_last_wins(parsed), stored).withColumn("part", part), "diffed")
    gone = written(E.vanished(stored, diffed).select("id", *KEYS).withColumn("part", part), "gone")
    counts = diffed.agg(F.count("*").alias("total"), F.count_if(F.col("bucket") == "changed").alias("changed")).first()
    total, described = counts["total"], counts["changed"]
    reused = total - described
    if on_progress:
        on_progress(reused, total)
    changed = diffed.where("bucket = 'changed'").drop("bucket", "stored_id", "part")
    fresh = chunks.enriched(changed, work, calls, chunk, parallel, in_flight, on_progress and (lambda done: on_progress(reused + done, total)))

    touched = diffed.where("bucket <> 'unchanged'").select("part").union(gone.select("part")).distinct()
    parts = sorted(r["part"] for r in touched.collect())  # store.parts at most
    run, top = snapshots.next_run(store)
    here = F.col("part").isin(parts) if parts else F.lit(False)
    old = stored.withColumn("part", part).where(here).drop("part", "search_vector")
    rows = fresh.withColumns({"project_id": F.lit(project_id), "last_seen_run": F.lit(run), "updated_at": now}).select(*[c for c in old.columns if c not in ("id", "created_at")])
    seen = E.mark_seen(old, diffed.where(here), run, now=now)
    kept, _ = E.delete_missing(E.upsert(seen, rows, after=top), run)
    new = kept.withColumn("search_vector", T.search_vector({k: F.col(c) for k, c in SEARCHED.items()})).withColumn("part", part)
    new = written(new.select(*[c.split(" ")[0] for c in ENTITY.split(", ") if not c.startswith("project_id ")], "search_vector", "part"), "new")
    snapshots.put(store, "entities", new, project_id, run)
    made = fresh.join(new.select("id", "part", *KEYS), KEYS).select(F.col("id").alias("entity_id"), "embedding", "entity_type", "part")
    held = snapshots.vectors(store, project_id).drop("project_id").join(new.select(F.col("id").alias("entity_id"), "part"), "entity_id").join(made.select("entity_id"), "entity_id", "left_anti")
    snapshots.put(store, "vectors", held.unionByName(made), project_id, run)
    greatest = new.agg(F.max("id").alias("top")).first()["top"] or 0
    snapshots.publish(store, project_id, run, commit, parts, max(top, greatest))
    return Result(total, gone.count(), described, reused, run, commit, parts)


def index_source(store: snapshots.Store, project_id: str, root: str, work: str, now: Column, commit: str | None = None, seconds: float = DEADLINE_S, **how) -> Result:
    """index_parsed() of the source files below root, within a deadline; files that can't be read are left out (code.unreadable() has them)."""
    spark = store.spark
    with deadline(spark, seconds):
        return index_parsed(store, project_id, code.parse_files(code.scan_files(spark, root)), work, now, commit, **how)
