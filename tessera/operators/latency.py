"""Latency statistics: nearest-rank percentiles and failures, and the queries that are timed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import small

#: How many ranges of values the percentiles' counts are dealt into at least, and how many values one may hold about.
RANGES, VALUES_A_RANGE = 64, 100_000


def percentiles(samples: DataFrame, percents: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """The by columns and p50_ms, ...: nearest-rank percentiles of ms, exact, null where a group has no ms.

    Equal values are one row with their number beforehand. The values of a group fall into ranges
    between approximate quantiles; numbers are summed up within each range, and over the few
    ranges before it, so no task holds all values of a group.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    counts = samples.select(key.alias("key"), "ms").groupBy("key", "ms").agg(F.count("ms").alias("n"))
    ranges = max(RANGES, counts.count() // VALUES_A_RANGE)
    cuts = counts.groupBy("key").agg(F.percentile_approx("ms", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("cuts"))
    few = small(cuts) if by else F.broadcast(cuts)  # without groups one row
    dealt = counts.join(few, "key").select("key", "ms", "n", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("ms"))), F.lit(0)).alias("range"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over ranges only
    totals = dealt.groupBy("key", "range").agg(F.sum("n").alias("held")).select(
        "key", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy("key")).alias("total"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("key", "range").orderBy("ms"))
    placed = dealt.join(totals, ["key", "range"]).withColumn("upto", upto)
    rank = lambda p: F.floor((F.col("total") * p + 99) / 100)
    at = [F.max(F.when((F.col("upto") - F.col("n") < rank(p)) & (rank(p) <= F.col("upto")), F.col("ms"))).alias(f"p{p}_ms") for p in percents]
    return placed.groupBy("key").agg(*at).select("key.*", *(f"p{p}_ms" for p in percents)) if by else placed.agg(*at)


def summary(samples: DataFrame) -> DataFrame:
    """Count, failures and, over samples (ms, status) of status 200, the statistics; sample deviation 0 for one sample."""
    good = F.when(F.col("status") == 200, F.col("ms"))
    ranks = percentiles(samples.select(good.alias("ms")), (50, 90, 95, 99))
    plain = samples.agg(
        F.count(good).alias("n"), F.count_if(~F.col("status").eqNullSafe(F.lit(200))).alias("failures"), F.min(good).alias("min_ms"),
        F.max(good).alias("max_ms"), F.round(F.avg(good), 6).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp(good), F.lit(0.0)), 6).alias("stdev_ms"),
    )
    return plain.crossJoin(F.broadcast(ranks)).select("n", "failures", "min_ms", *ranks.columns, "max_ms", "mean_ms", "stdev_ms")  # one row


def failures_by_status(samples: DataFrame) -> DataFrame:
    return samples.where("status <> 200").groupBy("status").agg(F.count("*").alias("n"))


def slowest(samples: DataFrame, k: int = 3) -> DataFrame:
    return samples.where("status = 200").orderBy(F.desc("ms"), "sample_id").limit(k)


def stage_share(stages: DataFrame) -> DataFrame:
    """Each stage's median and its share of the sum of medians; stages: (stage, ms)."""
    medians = percentiles(stages, (50,), ("stage",))
    total = medians.agg(F.sum("p50_ms").alias("total"))
    return medians.crossJoin(F.broadcast(total)).select("stage", "p50_ms", F.round(F.col("p50_ms") / F.col("total"), 9).alias("share"))


def report(samples: DataFrame, warmup: int = 0) -> DataFrame:
    """summary() of samples (nth, ms, status, results) after the warm-up's, with the mean number of results; raises if all failed."""
    timed = samples.where(F.col("nth") >= warmup)
    row = summary(timed).crossJoin(F.broadcast(timed.where("status = 200").agg(F.round(F.avg("results"), 6).alias("mean_results"))))  # one row
    if row.select("n").first()["n"] == 0:
        raise ValueError("every request failed; there is nothing to sum up")
    return row


def query_pool(*pools: DataFrame) -> DataFrame:
    """(query, place): the different queries of the pools (query, place), in the order they first appear, pool after pool."""
    every = [p.select("query", F.struct(F.lit(i).alias("pool"), F.col("place")).alias("at")) for i, p in enumerate(pools)]
    union = every[0]
    for more in every[1:]:
        union = union.unionByName(more)
    return union.groupBy("query").agg(F.min("at").alias("at")).select("query", "at.pool", "at.place")


def query_order(pool: DataFrame, n: int, seed: int, rows_a_range: int = 10_000) -> DataFrame:
    """(nth, query): n queries in an order that depends on the seed alone, from the first again where the pool is smaller.

    The order is that of a digest. Its first digits deal the queries into ranges, as many as the
    pool needs; a query's place is its rank in its range after the counts of the ranges before.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("query")).cast("binary"), 256)
    size = pool.count()
    digits = 1
    while 16**digits * rows_a_range < size and digits < 5:
        digits += 1
    dealt = pool.select("query", digest.alias("digest")).withColumn("range", F.substring("digest", 1, digits))
    before, at = [], 0
    for r in dealt.groupBy("range").count().orderBy("range").collect():  # a line for each range
        before.append((r["range"], at))
        at += r["count"]
    ranges = pool.sparkSession.createDataFrame(before, "range string, before long")
    nth = F.row_number().over(Window.partitionBy("range").orderBy("digest", "query")) - 1
    placed = dealt.withColumn("nth", nth).join(F.broadcast(ranges), "range").withColumn("start", F.col("before") + F.col("nth")).where(F.col("start") < n)
    return placed.select(F.explode(F.sequence("start", F.lit(n - 1).cast("long"), F.lit(max(size, 1)).cast("long"))).alias("nth"), "query")
