"""Operator 11: sharding over fixed virtual slots.

A record's key is hashed into one of thousands of virtual slots, for good. Bytes and rows are
aggregated by slot, and a small map says which shard holds each slot. The map is a table with
versions: the first is made from the slots' bytes, the largest slot to the emptiest shard; a later
one is the last one edited, so only the slots that have to move change their shard.

A slot far above its share (one key with a third of all rows, or none at all) is cut into parts by
a salt of each row, and parts are dealt like slots. Maps have three entries a slot at most,
whatever the number of rows, so they pass the driver.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, text_of, written

SLOTS, SALTS, ROW_BYTES = 8192, 4096, 8
#: (virtual slot, its part), the shard, and the place in the shard of the part's first row.
MAP = "virtual_slot long, part long, parts long, shard int, n_rows long, n_bytes long, first long"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: the key alone decides, and rows without one share a slot."""
    return F.pmod(F.xxhash64(key), F.lit(slots))


def keyed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and salt, as a table; the salt is a row's own, so that equal rows can part.

    It is stored, as salts made anew for another job could differ.
    """
    text = text_of()
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("virtual_slot"))
    return written(rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))), "keyed")


def slot_stats(rows: DataFrame, slots: int = SLOTS) -> list:
    """Rows and bytes of each slot, or of its parts where it has more than four fair shares of bytes: at most three a slot."""
    count = [F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes")]
    plain = rows.groupBy("virtual_slot").agg(*count).collect()
    fair = sum(x.n_bytes for x in plain) / slots
    hot = [(x.virtual_slot, min(SALTS, int(x.n_bytes / fair))) for x in plain if x.n_bytes > 4 * fair and x.n_rows > 1]
    if not hot:
        return [(x.virtual_slot, 0, 1, x.n_rows, x.n_bytes) for x in plain]
    parts = rows.join(F.broadcast(rows.sparkSession.createDataFrame(hot, "virtual_slot long, parts long")), "virtual_slot")  # at most a quarter of the slots
    split = parts.groupBy("virtual_slot", "parts", (F.col("salt") % F.col("parts")).alias("part")).agg(*count).collect()
    known = dict(hot)
    return [(x.virtual_slot, 0, 1, x.n_rows, x.n_bytes) for x in plain if x.virtual_slot not in known] + [(x.virtual_slot, x.part, x.parts, x.n_rows, x.n_bytes) for x in split]


def dealt(stats: list, shards: int) -> dict:
    """{(slot, part): shard}: in order of falling bytes, each to the shard with the fewest bytes so far; ties go to the smaller number."""
    if shards < 1:
        raise ValueError("there must be a shard")
    load, out = [(0, s) for s in range(shards)], {}
    for slot, part, _, _, size in sorted(stats, key=lambda x: (-x[4], x[0], x[1])):
        held, shard = heapq.heappop(load)
        out[slot, part] = shard
        heapq.heappush(load, (held + size, shard))
    return out


def rebalanced(old: dict, stats: list, shards: int) -> dict:
    """A map edited for new stats or more shards: slots leave shards above the mean for those below it, as long as that evens them out.

    What old doesn't know (a new slot or part) goes to the emptiest shard. With one shard more and
    the same stats, slots move to the new shard alone.
    """
    sizes = {(slot, part): size for slot, part, _, _, size in stats}
    out = {k: old[k] for k in sizes if old.get(k, shards) < shards}
    load, held = [0] * shards, defaultdict(list)
    for k, shard in out.items():
        load[shard] += sizes[k]
        held[shard].append((sizes[k], k))
    for k in sorted(sizes.keys() - out.keys(), key=lambda k: (-sizes[k], k)):
        out[k] = shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += sizes[k]
        held[shard].append((sizes[k], k))
    mean = sum(load) / shards
    grown = {s for s in range(shards) if s > max(old.values(), default=-1)} or set(range(shards))
    for giver in sorted(range(shards), key=lambda s: (-load[s], s)):
        for size, k in sorted(held[giver], key=lambda x: (-x[0], x[1])):
            taker = min(grown, key=lambda s: (load[s], s))
            if taker != giver and load[giver] - size >= mean and load[taker] + size <= mean:
                out[k] = taker
                load[giver], load[taker] = load[giver] - size, load[taker] + size
    return out


def map_rows(assigned: dict, stats: list) -> list:
    """The rows of MAP: slots of a shard stand one after the other, so a row's place is gapless in its shard."""
    at, out = defaultdict(int), []
    for slot, part, parts, n_rows, n_bytes in sorted(stats):
        shard = assigned[slot, part]
        out.append((slot, part, parts, shard, n_rows, n_bytes, at[shard]))
        at[shard] += n_rows
    return out


def write_map(spark: SparkSession, assigned: dict, stats: list, path: str, version: int) -> DataFrame:
    """Stores a version of the map below path; a version that is there is never changed."""
    spark.createDataFrame(map_rows(assigned, stats), MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the last one by default, with its number."""
    every = spark.read.schema(f"{MAP}, version int").parquet(path)
    version = every.agg(F.max("version")).first()[0] if version is None else version
    return every.where(F.col("version") == F.lit(version))


def sharded(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """Adds shard, slot (the place in the shard, gapless from 0) and version to keyed() rows.

    Within a part of a slot rows stand in the order of their ids, sizes and checksums; the order of
    rows equal in all of these doesn't show. One shuffle, of rows without texts.
    """
    parts = F.broadcast(slots.select("virtual_slot", "parts").distinct())  # both broadcasts: three rows a slot at most
    cut = rows.join(parts, "virtual_slot").withColumn("part", F.col("salt") % F.col("parts"))
    placed = cut.join(F.broadcast(slots.select("virtual_slot", "part", "shard", "first", "version")), ["virtual_slot", "part"])
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32"))
    return placed.withColumn("slot", F.col("first") + nth - 1)


def shards(docs: DataFrame, n: int = 24, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and version of every row: shards of near equal bytes.

    path: the folder of the map's versions, a new one by default; where it has a version, the last
    one is edited for n shards and the rows at hand, and stored as the next. A null text has size 8
    and the checksum of the empty text. Rows without a doc_id, and those that repeat one, count row
    by row. No rows give no rows.
    """
    rows = keyed(docs, slots)
    stats = slot_stats(rows, slots)
    spark, version = docs.sparkSession, 1
    if path is None:
        assigned = dealt(stats, n)
    else:
        old = read_map(spark, path).collect()
        version, assigned = old[0].version + 1, rebalanced({(x.virtual_slot, x.part): x.shard for x in old}, stats, n)
    chosen = write_map(spark, assigned, stats, path or shared_dir(spark), version)
    out = sharded(rows, chosen)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shards() of all documents, 24 of them."""
    return shards(table(spark, sf_dir, "documents"))


#: Spark's hash of a key isn't SQL's, so there is no SQL: tests recompute shards from the rows and the map.
QUERIES = {"op11_sharding": op11_sharding}
