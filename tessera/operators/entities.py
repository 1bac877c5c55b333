"""Incremental indexing: dedupe, content diff, and snapshots in place of updates.

Tables are immutable, so every change is a function from the old snapshot and a delta to the new
one. All joins are on (file_path, qualname) within a project; both sides shuffle on those keys once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEYS


def content_hash(source: Column) -> Column:
    """SHA-256 of a definition's source alone: its place doesn't count."""
    return F.sha2(source.cast("binary"), 256)


def entity_key(path: Column, name: Column) -> Column:
    return F.concat_ws("::", F.replace(path, F.lit("\\"), F.lit("/")), name)


def dedupe_last_wins(parsed: DataFrame, keys: list[str] = KEYS, ordinal: str = "ordinal") -> DataFrame:
    """One row for each key, the one of the greatest ordinal.

    max_by combines on the map side, so a key that most rows share costs one row a task.
    """
    rest = [c for c in parsed.columns if c not in keys]
    last = parsed.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordinal).alias("last"))
    return last.select(*keys, "last.*").select(*parsed.columns)


def diff(parsed: DataFrame, stored: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds bucket (changed, moved or unchanged) and stored_id to each parsed row.

    A row is changed if it is new or its hash differs, moved if only its lines differ. Of stored
    only the keys, id, hash and lines are read.
    """
    old = stored.select(*keys, F.col("id").alias("stored_id"), F.col("content_hash").alias("old_hash"), F.col("start_line").alias("old_start"), F.col("end_line").alias("old_end"))
    same_place = F.col("start_line").eqNullSafe(F.col("old_start")) & F.col("end_line").eqNullSafe(F.col("old_end"))
    bucket = F.when(F.col("stored_id").isNull() | ~F.col("content_hash").eqNullSafe(F.col("old_hash")), "changed").when(same_place, "unchanged").otherwise("moved")
    return parsed.join(old, keys, "left").withColumn("bucket", bucket).drop("old_hash", "old_start", "old_end")


def vanished(stored: DataFrame, parsed: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Stored rows that the run didn't see."""
    return stored.join(parsed.select(*keys), keys, "left_anti")


def diff_summary(diffed: DataFrame) -> DataFrame:
    """Counts by bucket and the share of rows that need no new description."""
    count = lambda b: F.count_if(F.col("bucket") == b)
    reused = count("moved") + count("unchanged")
    return diffed.agg(
        count("changed").alias("changed"), count("moved").alias("moved"), count("unchanged").alias("unchanged"), reused.alias("reused"),
        F.coalesce(F.try_divide(reused, F.count("*")), F.lit(0.0)).alias("reuse_ratio"),
    )


def new_ids(rows: DataFrame, first: Column, keys: list[str] = KEYS, rows_a_bucket: int = 100_000) -> DataFrame:
    """Adds id: first, first + 1, ... in an order that depends on the keys alone.

    Keys are dealt into buckets by hash, as many as a count of the rows needs; a bucket numbers
    its own rows after those before it.
    """
    buckets = rows.count() // rows_a_bucket + 1
    dealt = rows.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over the buckets' counts only
    offset = dealt.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__b").orderBy(*keys)) - 1
    return dealt.withColumn("__nth", nth).join(F.broadcast(offset), "__b").withColumn("id", first + F.col("__before") + F.col("__nth")).drop("__b", "__nth", "__before")


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str] = KEYS, after: int | None = None) -> DataFrame:
    """The snapshot after rows replace or join the stored ones by key: ids and created_at stay.

    rows: at most one for each key, with the columns of stored but id and created_at; these get
    ids after the greatest stored one, or after the one given, and their updated_at as created_at.
    """
    kept = stored.select(*keys, F.col("id").alias("__id"), F.col("created_at").alias("__created"))
    matched = rows.join(kept, keys, "left").withColumn("created_at", F.coalesce("__created", "updated_at"))
    columns = stored.columns
    known = matched.where("__id is not null").withColumn("id", F.col("__id")).select(*columns)
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    unknown = matched.where("__id is null").drop("__id")
    fresh = unknown.crossJoin(F.broadcast(top)) if after is None else unknown.withColumn("__top", F.lit(after))  # one row
    added = new_ids(fresh, F.col("__top") + 1, keys).select(*columns)
    return vanished(stored, rows, keys).select(*columns).unionByName(known).unionByName(added)


def mark_seen(stored: DataFrame, diffed: DataFrame, run_id: str, keys: list[str] = KEYS, now: Column | None = None) -> DataFrame:
    """Stamps rows that the run found unchanged or moved; moved rows get their new lines and, where now is given, updated_at.

    Stamped rows that didn't move keep their updated_at.
    """
    seen = diffed.where("bucket <> 'changed'").select(*keys, "bucket", F.col("start_line").alias("__start"), F.col("end_line").alias("__end"))
    joined = stored.join(seen, keys, "left")
    moved = F.col("bucket") == "moved"
    return joined.withColumns({
        "last_seen_run": F.when(F.col("bucket").isNotNull(), F.lit(run_id)).otherwise(F.col("last_seen_run")),
        "start_line": F.when(moved, F.col("__start")).otherwise(F.col("start_line")),
        "end_line": F.when(moved, F.col("__end")).otherwise(F.col("end_line")),
        **({"updated_at": F.when(moved, now).otherwise(F.col("updated_at"))} if now is not None else {}),
    }).select(*stored.columns)


def delete_missing(stored: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """The rows the run saw, and the ids of the others."""
    unseen = ~F.col("last_seen_run").eqNullSafe(F.lit(run_id))
    return stored.where(~unseen), stored.where(unseen).select("id")


def cascade_delete(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def count_for_project(entities: DataFrame) -> DataFrame:
    """How many entities each project has."""
    return entities.groupBy("project_id").agg(F.count("*").alias("n"))


def corpus_counts(entities: DataFrame) -> DataFrame:
    """How many entities there are, and how many of them stand in tests."""
    key = entity_key(F.col("file_path"), F.col("qualname"))
    return entities.agg(F.count("*").alias("entities"), F.count_if(F.contains(key, F.lit("/tests/"))).alias("test_distractors"))


def progress(diffed: DataFrame, chunk: int = 200, keys: list[str] = KEYS, rows_a_bucket: int = 100_000) -> DataFrame:
    """(chunk, done, total) after each chunk of changed rows is described; reused rows count as done from the start.

    Only the numbers of rows in buckets of keys are summed in one place.
    """
    changed = diffed.where("bucket = 'changed'")
    numbered = new_ids(changed.select(*keys), F.lit(0), keys, rows_a_bucket).groupBy(F.floor(F.col("id") / chunk).alias("chunk")).agg(F.count("*").alias("n"))
    total = diffed.agg(F.count("*").alias("total"), F.count_if(F.col("bucket") != "changed").alias("reused"))
    # all chunks before are full
    return numbered.crossJoin(F.broadcast(total)).select("chunk", (F.col("reused") + F.col("chunk") * chunk + F.col("n")).alias("done"), "total")
