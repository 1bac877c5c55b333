"""Enriching in durable chunks: what has been described and embedded is stored before more is paid for.

Changed rows are numbered and staged, 200 to a chunk. A stream takes some chunks at a time; each
is one call of the provider, and a micro-batch overwrites the folders of its own chunks, so one that
comes again does no harm. A restart goes on after the last micro-batch that was stored and repeats
at most the chunks of the one in flight.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import entities as E
from ..schemas import KEYS
from .providers import IN_FLIGHT, as_provider

CHUNK, PARALLEL = 200, 2


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stage(changed: DataFrame, path: str, chunk: int = CHUNK, keys: list[str] = KEYS) -> DataFrame:
    """The changed rows with chunk (0, 1, ...) and place in it, stored below path; where they are stored already, those.

    The numbers depend on the keys alone. Every chunk but the last is full.
    """
    spark = changed.sparkSession
    if not exists(spark, f"{path}/staged/_SUCCESS"):
        numbered = E.new_ids(changed, F.lit(0), keys).withColumns({"chunk": F.floor(F.col("id") / chunk).cast("long"), "place": (F.col("id") % chunk).cast("int")}).drop("id")
        numbered.repartition("chunk").sortWithinPartitions("chunk", "place").write.mode("overwrite").partitionBy("chunk").parquet(f"{path}/staged")
    kinds = [*(f for f in changed.schema), StructField("place", IntegerType()), StructField("chunk", LongType())]
    return spark.read.schema(StructType(kinds)).parquet(f"{path}/staged")


def called(rows: DataFrame, calls, in_flight: int) -> DataFrame:
    """Adds description and embedding: one call for each chunk, its rows in their places' order."""
    provider = as_provider(calls, in_flight)
    out = StructType([*rows.schema, StructField("description", StringType()), StructField("embedding", ArrayType(FloatType()))])
    schema = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        asked = list(zip(*(table.column(c).to_pylist() for c in ("entity_type", "qualname", "signature", "source_code"))))
        made = provider(asked)
        extra = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
        return pa.table([*table.columns, *extra], names=[*table.column_names, "description", "embedding"]).select(schema.names).cast(schema)

    return rows.groupBy("chunk").applyInArrow(run, out)


def enriched(changed: DataFrame, path: str, calls, chunk: int = CHUNK, parallel: int = PARALLEL, in_flight: int = IN_FLIGHT, on_progress=None) -> DataFrame:
    """The changed rows with description and embedding, from the chunks stored below path.

    calls: Calls, or a function from rows to (description, vector). parallel chunks are taken at a
    time, and in_flight calls are made over all of them. on_progress gets the number of rows
    stored so far after each micro-batch. The path belongs to one set of rows: a restart with it
    finds what was paid for.
    """
    spark = changed.sparkSession
    parallel = max(1, min(parallel, in_flight))
    staged = stage(changed, path, chunk)
    if staged.isEmpty():
        extra = {"description": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")}
        return changed.limit(0).withColumns(extra)

    def keep(batch: DataFrame, _: int) -> None:
        out = called(batch, calls, in_flight // parallel)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(f"{path}/enriched")
        if on_progress:
            on_progress(spark.read.parquet(f"{path}/enriched").count())

    stream = spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", parallel).parquet(f"{path}/staged")
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    stored = spark.read.parquet(f"{path}/enriched") if exists(spark, f"{path}/enriched") else None
    if stored is None or stored.count() < staged.count():
        raise RuntimeError("the chunks were stopped before their end")
    return stored.drop("chunk", "place")


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, n): the chunks stored so far and their rows."""
    return spark.read.parquet(f"{path}/enriched").groupBy("chunk").agg(F.count("*").alias("n"))
