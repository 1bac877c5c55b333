"""JSON sources and sinks of labelled queries and results, and point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = "categories map<string,string>, queries array<struct<id:long,query:string,category:string,expected:array<string>,note:string>>"


def golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, labels) of a file of labelled queries: (query_id, query, category, note) and (query_id, label)."""
    each = spark.read.schema(GOLDEN).option("multiLine", True).json(path).select(F.explode("queries").alias("q"))
    return each.select(F.col("q.id").alias("query_id"), "q.query", "q.category", "q.note"), each.select(F.col("q.id").alias("query_id"), F.explode("q.expected").alias("label"))


def save_results(report: DataFrame, outcomes: DataFrame, path: str) -> None:
    """One JSON object: each strategy's metrics with its outcomes nested in the order of their queries.

    report: strategy and metrics; outcomes: strategy and a row for each labelled query. Both are
    as small as the set of labelled queries.
    """
    rest = [c for c in outcomes.columns if c not in ("strategy", "query_id")]
    nested = outcomes.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("query_id", *rest))).alias("outcomes"))
    report.join(nested, "strategy").coalesce(1).write.mode("overwrite").json(path)


def lookup(rows: DataFrame, **keys) -> dict | None:
    """The row of some key values, or None; the filter reaches the scan."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    found = rows.first()
    return found.asDict() if found else None
