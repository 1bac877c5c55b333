"""Exact top-k by cosine for many queries at once: a join of blocks by shuffle, with bounds that skip blocks.

Vectors are dealt into blocks of a bounded size around pivots (some of the vectors). A block's
radius is the smallest cosine of its vectors with its pivot; the angle between a query and any
vector of a block is at least the angle to the pivot less the radius, which bounds the block's scores.
Each query first meets one block near it, which gives a k-th score; then it meets only the blocks
whose bound reaches that score. Vectors that have no place around a pivot (none, of another
length, without a direction) form blocks that nothing skips.

Blocks and queries meet by shuffle, (block, part of the queries) by (block, part). Through the driver
pass the pivots and a line for each block; the number of scans does not depend on the number of
queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.shared import written

MOST_PIVOTS, BLOCK_ROWS, PART_ROWS = 256, 50_000, 50_000
#: Scores are rounded to six digits; a bound within this of the k-th score isn't skipped.
SLACK = 3e-6


def matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors padded to one width, and their lengths; nan where there is none, no direction or a null element."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(sizes.cumsum() - sizes, sizes)] = values
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        return out / np.sqrt((out * out).sum(1, keepdims=True)), sizes


def best(columns: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of columns (query, score, id, ...) the k best rows of each query, in order, and their ranks from 0."""
    order = np.lexsort((columns[2], -columns[1], columns[0]))
    query = columns[0][order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return [c[order[rank < k]] for c in columns], rank[rank < k]


def met(vectors: pa.Table, queries: pa.Table, schema: pa.Schema, k: int, rows: int = 512, part: int = 2048) -> pa.Table:
    """The k best of some vectors for each of some queries; unscored vectors come last, without a score."""
    ids = vectors.column("entity_id").to_numpy()
    unit, lengths = matrix(vectors.column("embedding"))
    out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin in range(0, queries.num_rows, part):
        asked, sizes = matrix(queries.column("embedding").slice(begin, part))
        held, floor, last = None, np.full(len(asked), -np.inf), np.full(len(asked), np.iinfo("int64").max)
        width = min(asked.shape[1], unit.shape[1])
        for at in range(0, len(ids), rows):
            entity = ids[at : at + rows]
            score = np.round(asked[:, :width] @ unit[at : at + rows, :width].T, 6)
            score[np.isnan(score) | (sizes[:, None] != lengths[at : at + rows])] = -np.inf
            q, r = np.nonzero((score > floor[:, None]) | ((score == floor[:, None]) & (entity < last[:, None])))
            if len(q):
                new = [q, score[q, r], entity[r], at + r]
                held, rank = best(new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)], k)
                full = rank == k - 1
                floor[held[0][full]], last[held[0][full]] = held[1][full], held[2][full]
        if held is not None:
            out.append((begin + held[0], *held[1:]))
    q, score, entity, row = (np.concatenate(x) for x in zip(*out))
    made = {"query_id": queries.column("query_id").take(pa.array(q)), "entity_id": pa.array(entity), "score": pa.array(score, mask=score == -np.inf)}
    return pa.table([made[f.name] if f.name in made else vectors.column(f.name).take(pa.array(row)) for f in schema], names=schema.names).cast(schema)


class Pivots:
    """The pivots as unit rows of one width, and the blocks: pivot, rows and radius of each."""

    def __init__(self, unit: np.ndarray):
        self.unit, self.width = unit, unit.shape[1] if len(unit) else -1
        self.block, self.pivot, self.rows, self.radius = (np.zeros(0, np.int64) for _ in range(4))

    def near(self, embeddings) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the nearest pivot and its cosine; pivot -1 for one without a place."""
        unit, sizes = matrix(embeddings)
        pivot, cosine = np.full(len(sizes), -1), np.full(len(sizes), -1.0)
        fits = np.flatnonzero((sizes == self.width) & np.isfinite(unit).all(1)) if self.width > 0 else np.zeros(0, int)
        if len(fits):
            all_ = unit[fits, : self.width] @ self.unit.T
            pivot[fits], cosine[fits] = all_.argmax(1), all_.max(1)
        return pivot, cosine

    def bounds(self, embeddings) -> np.ndarray:
        """(query, block): the most that a score can be; 1 and more where nothing is known."""
        unit, sizes = matrix(embeddings)
        out = np.full((len(sizes), len(self.block)), 2.0)
        fits = np.flatnonzero((sizes == self.width) & np.isfinite(unit).all(1)) if self.width > 0 else np.zeros(0, int)
        known = np.flatnonzero(self.pivot >= 0)
        if len(fits) and len(known):
            angle = np.arccos(np.clip(unit[fits, : self.width] @ self.unit.T, -1, 1))[:, self.pivot[known]]
            out[np.ix_(fits, known)] = np.cos(np.maximum(0, angle - np.arccos(np.clip(self.radius[known], -1, 1))))
        return out


def pivots_of(vectors: DataFrame, n: int) -> Pivots:
    """Of the vectors with a direction, n of the least id hashes: those of the most frequent length among them."""
    rows = vectors.select("embedding", F.xxhash64("entity_id").alias("h")).orderBy("h", "embedding").limit(4 * n).select("embedding").toArrow()
    unit, sizes = matrix(rows.column("embedding"))
    right = (sizes > 0) & np.isfinite(unit).all(1)
    if not right.any():
        return Pivots(np.zeros((0, 0)))
    width = int(np.bincount(sizes[right]).argmax())
    return Pivots(unit[right & (sizes == width)][:n, :width])


def in_blocks(vectors: DataFrame, pivots: Pivots, block_rows: int) -> DataFrame:
    """vectors with block and their cosine with its pivot, as a table: a pivot's vectors are dealt by id into blocks of about block_rows."""

    def place(batches):
        for batch in batches:
            pivot, cosine = pivots.near(batch.column(batch.schema.get_field_index("embedding")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot, pa.int32()), pa.array(cosine)], names=[*batch.schema.names, "__pivot", "__cosine"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    placed = written(vectors.mapInArrow(place, f"{fields}, __pivot int, __cosine double"), "placed")
    parts = placed.groupBy("__pivot").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__parts"))
    dealt = placed.join(F.broadcast(parts), "__pivot")  # a row for each pivot
    return dealt.withColumn("__block", F.col("__pivot").cast("long") * 2**32 + F.pmod(F.xxhash64("entity_id", F.lit(3)), F.col("__parts"))).drop("__parts")


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """query_id, entity_id, score and the other columns of vectors: the k vectors of greatest cosine for each query, ties by id.

    queries: query_id, a key, and embedding. pivots: how many, by default two for each block_rows
    of the vectors. Vectors and queries without an id are left out. A
    vector that can't be compared with a query comes after all that can, without a score.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    names = [c for c in vectors.columns if c not in ("entity_id", "embedding")]
    out = StructType([StructField("query_id", queries.schema["query_id"].dataType), vectors.schema["entity_id"], StructField("score", DoubleType()), *(vectors.schema[n] for n in names)])
    spark, schema = vectors.sparkSession, to_arrow_schema(out)
    if k == 0:
        return spark.createDataFrame([], out)
    vectors = vectors.where("entity_id is not null")
    asked = queries.where("query_id is not null").select("query_id", "embedding")
    known = pivots_of(vectors, pivots or min(MOST_PIVOTS, vectors.count() // (block_rows // 2) + 1))
    dealt = in_blocks(vectors, known, block_rows)
    lines = dealt.groupBy("__block", "__pivot").agg(F.count("*").alias("n"), F.min("__cosine").alias("radius")).orderBy("__block").collect()  # a line for each block
    known.block, known.pivot, known.rows, known.radius = (np.array([r[c] for r in lines], t) for c, t in (("__block", np.int64), ("__pivot", np.int64), ("n", np.int64), ("radius", np.float64)))
    parts = F.pmod(F.xxhash64("query_id"), F.lit(asked.count() // part_rows + 1)).cast("int")

    def meet(pairs: DataFrame) -> DataFrame:
        """pairs: query_id, embedding, part, block. A block is moved once for each part of the queries that needs it."""
        needed = pairs.select(F.col("block").alias("__block"), F.col("part").alias("__part")).distinct()  # blocks times parts, which are few
        blocks = dealt.join(F.broadcast(needed), "__block").select(F.col("__block").alias("block"), F.col("__part").alias("part"), "entity_id", "embedding", *names)
        return pairs.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(lambda q, v: met(v, q, schema, k), out)

    def first(batches):
        for batch in batches:
            bound = known.bounds(batch.column(1)) if len(known.block) else np.zeros((batch.num_rows, 0))
            if bound.shape[1]:
                chosen = np.where(known.rows >= k, bound, -2).argmax(1)  # one that gives a k-th score
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.block[chosen])], names=["query_id", "embedding", "part", "block"])

    def rest(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bound = known.bounds(part.column(1))
                floor = pc.fill_null(part.column(4), -np.inf).to_numpy(zero_copy_only=False)
                q, b = np.nonzero((bound + SLACK >= floor[:, None]) & (known.block[None] != part.column(3).to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q)) for c in part.columns[:3]), pa.array(known.block[b])], names=["query_id", "embedding", "part", "block"])

    fields = f"query_id {out['query_id'].dataType.simpleString()}, embedding {queries.schema['embedding'].dataType.simpleString()}, part int, block long"
    began = written(asked.withColumn("part", parts).mapInArrow(first, fields), "began")
    near = written(meet(began), "near")
    floor = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"), F.count_if(F.col("score").isNull()).alias("unscored"))
    floored = began.join(floor.select("query_id", F.when(F.col("unscored") == 0, F.col("floor")).alias("floor")), "query_id", "left").select("query_id", "embedding", "part", "block", "floor")
    both = reduce(DataFrame.unionAll, [near, meet(floored.mapInArrow(rest, fields))])
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return both.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= k).drop("__rank")
