"""Indexing a source tree: parse, dedupe, diff, describe and embed what changed, and the next snapshot."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..schemas import SEARCHED

#: Describes and embeds a list of (entity_type, qualname, signature, source): [(description, vector)].
Provider = Callable[[list[tuple[str, str, str, str]]], list[tuple[str, list[float]]]]


def offline_provider(rows, dimensions: int = 64):
    """Deterministic stand-in for a language model and an embedder: a sentence, and hashed counts of its words."""
    import hashlib
    import re

    out = []
    for kind, name, sign, source in rows:
        text = f"{kind} {name} {sign}"
        vector = [0.0] * dimensions
        for w in re.findall("[a-z0-9]+", f"{text} {source}".lower()):
            vector[int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "little") % dimensions] += 1.0
        size = sum(v * v for v in vector) ** 0.5 or 1.0
        out.append((text, [v / size for v in vector]))
    return out


def enriched(changed: DataFrame, provider: Provider = offline_provider, chunk: int = 200) -> DataFrame:
    """Adds description and embedding, a chunk of rows for each call of the provider.

    Calls may cost money: write the result before using it twice.
    """
    names, schema = changed.columns, changed.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                rows = list(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("entity_type", "qualname", "signature", "source_code"))))
                made = provider(rows)
                extra = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*names, "description", "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return changed.mapInArrow(run, f"{fields}, description string, embedding array<float>")


def index(parsed: DataFrame, stored: DataFrame, vectors: DataFrame, project_id: str, run_id: str, now, write: Callable[[DataFrame], DataFrame], provider: Provider = offline_provider):
    """(entities, vectors, diff): the snapshot after a run, its vectors, and how each parsed row differed.

    stored: the project's entities; vectors: (entity_id, embedding, entity_type). write: stores a
    frame and reads it back, used where a plan forks after a call that costs money. Entities
    and vectors come from one enrichment, so neither can be there without the other. Where stored
    has a search_vector, changed rows get a new one. plans.indexing keeps snapshots and durable chunks itself.
    """
    diffed = write(E.diff(E.dedupe_last_wins(parsed), stored))
    fresh = write(enriched(diffed.where("bucket = 'changed'").drop("bucket", "stored_id"), provider))
    made = {"search_vector": T.search_vector({k: F.col(c) for k, c in SEARCHED.items()})} if "search_vector" in stored.columns else {}
    rows = fresh.withColumns({"project_id": F.lit(project_id), "last_seen_run": F.lit(run_id), "updated_at": now, **made}).select(*[c for c in stored.columns if c not in ("id", "created_at")])
    seen, gone = E.delete_missing(write(E.upsert(E.mark_seen(stored, diffed, run_id, now=now), rows)), run_id)
    made = fresh.join(seen.select("id", *E.KEYS), E.KEYS).select(F.col("id").alias("entity_id"), "embedding", "entity_type")
    dropped = gone.select(F.col("id").alias("entity_id")).unionByName(made.select("entity_id"))
    return seen, vectors.join(dropped, "entity_id", "left_anti").unionByName(made), diffed
