"""Operator 12: centroid clustering by annulus search.

Components become integers, so distances, sums and means are exact. Centroids are sorted by their
norms. For a vector, the distance to the centroid whose norm is nearest to its own is an upper
bound; a centroid at most that far away has a norm within that distance of the vector's, as norms
differ by no more than distances do. Two binary searches find this annulus in the sorted norms
(widened a little, for the roots' rounding), and only its centroids are compared, boundary ties
included.

A round is one pass: tasks emit a count and a sum for each of the centroids, which are few, and
the sums' sums make the next centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, WIDTH, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Integers beyond this count as this, so that a squared distance fits a long.
LIMIT = 2**27
ROWS = 2048


def quantised(embeddings: pa.Array, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have exactly width finite components, and these as rows of integers floor(scale * x)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(embeddings), width), False)
    whole = right.to_numpy(zero_copy_only=False).astype(bool)
    values = pc.list_flatten(embeddings.filter(right)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    finite = np.isfinite(values).all(1)  # a null is nan here
    whole[whole] = finite
    with np.errstate(over="ignore"):
        return whole, np.clip(np.floor(scale * values[finite]), -LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x the number of its nearest centroid, ties to the smaller, its squared distance, and how many were compared."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
    order = np.argsort(norms, kind="stable")
    ring, sorted_norms = centroids[order], norms[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    right = np.clip(np.searchsorted(sorted_norms, own), 1, len(ring) - 1) if len(ring) > 1 else np.zeros(len(x), int)
    left = np.maximum(right - 1, 0)
    guess = np.where(own - sorted_norms[left] <= sorted_norms[right] - own, left, right)
    bound = np.sqrt(((x - ring[guess]) ** 2).sum(1).astype(np.float64))
    bound += 1e-9 * (bound + own) + 1e-9
    low, high = np.searchsorted(sorted_norms, own - bound, "left"), np.searchsorted(sorted_norms, own + bound, "right")
    sizes = high - low  # one at least, the guess
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(x)), sizes)
    at = np.arange(len(row)) - starts[row] + low[row]
    distance = ((x[row] - ring[at]) ** 2).sum(1)
    best = np.minimum.reduceat(distance, starts)
    number = np.minimum.reduceat(np.where(distance == best[row], order[at], len(ring)), starts)
    return number, best, sizes


def blocks(batches, width: int, scale: int):
    """(ids, integer rows) of the vectors that are kept, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            kept, x = quantised(part.column(1), width, scale)
            if len(x):
                yield part.column(0).filter(pa.array(kept)), x


def first_centroids(vectors: DataFrame, k: int, seed: int, width: int, scale: int) -> np.ndarray:
    """The kept vectors with the smallest sha256 of seed:vec_id, in this order; those without an id come last, ties by their components."""

    def run(batches):
        for ids, x in blocks(batches, width, scale):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    kept = vectors.mapInArrow(run, "vec_id string, x array<long>")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id")).cast("binary"), 256)
    top = kept.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()  # a heap of k rows a task
    return np.array([r.x for r in top], np.int64).reshape(-1, width)


def moved(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: componentwise floors of the means, empty ones as they were."""
    k, width = centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, x in blocks(batches, width, scale):
            number, _, _ = nearest(x, centroids)
            member = np.zeros((k, len(x)))
            member[number, np.arange(len(x))] = 1
            sums += (member @ x.astype(np.float64)).astype(np.int64)  # exact: a block's sums stay below 2**53
            n += np.bincount(number, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():  # a row for each centroid
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors with exactly width components, none null or not finite. Rows that repeat a
    vec_id, or have none, count row by row. With fewer than k kept vectors there are as many
    centroids; with none, no rows. An integer beyond 2**27 counts as 2**27, with its sign; an
    inertia beyond a long is null.
    """
    rows = vectors.select("vec_id", "embedding")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed, width, scale)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, scale)

    def run(batches):
        for ids, x in blocks(batches, width, scale) if len(centroids) else ():
            number, best, compared = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(best), pa.array(compared, pa.int32())], names=["vec_id", "cluster", "distance", "n_compared"])

    found = written(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, n_compared int"), "assigned")
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row for each centroid
    total, digest = sum(int(r.own) for r in inertia), lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    fit = lambda v: v if v < 2**63 else None
    made = vectors.sparkSession.createDataFrame([(r.cluster, fit(int(r.own)), fit(total), digest(r.cluster)) for r in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(made), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")  # a row for each centroid


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clusters() of all embeddings; without how many centroids were compared."""
    return clusters(table(spark, sf_dir, "embeddings")).drop("n_compared")


def assigned_sql(nth: int) -> str:
    """The nearest centroid of each vector among those of round nth."""
    return f"""a{nth} as (select vec_id, x, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance from (
    select v.vec_id, v.x, c.cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from v, c{nth} c) group by vec_id, x)"""


def moved_sql(nth: int) -> str:
    """The centroids of round nth + 1."""
    return f"""s{nth} as (select cluster, i, sum(y) as s, count(*) as n from (select cluster, unnest(x) as y, generate_subscripts(x, 1) as i from a{nth}) group by cluster, i),
m{nth} as (select cluster, list(floor_div order by i) as x from (select cluster, i, ((s - ((s % n) + n) % n) // n)::bigint as floor_div from s{nth}) group by cluster),
c{nth + 1} as (select cluster, coalesce(m{nth}.x, c{nth}.x) as x from c{nth} left join m{nth} using (cluster))"""


#: vec_id is a key of the given tables, so SQL may group by it.
ORACLES = {
    "op12_clusters": f"""with v as materialized (select vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::double)::bigint) as x from embeddings
    where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
c0 as (select row_number() over (order by h) - 1 as cluster, x from (select sha256('{SEED}:' || vec_id::varchar) as h, x from v order by h limit {CENTROIDS})),
{", ".join(f"{assigned_sql(i)}, {moved_sql(i)}" for i in range(ROUNDS))}, {assigned_sql(ROUNDS)}
select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia, sum(distance) over ()::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} c using (cluster)"""
}
QUERIES = {"op12_clusters": op12_clusters}
