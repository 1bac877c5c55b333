"""Dense, keyword and hybrid retrieval, and hydration of ranked ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .nearest import BLOCK_ROWS, topk_batch

DEPTH, RRF_K = 30, 60


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays, in doubles; null where one has no length."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_topk(vectors: DataFrame, query: list[float], k: int = DEPTH) -> DataFrame:
    """The k vectors of greatest cosine with the query: an exact scan, a top-k heap in each task."""
    if k < 0:
        raise ValueError("k must not be negative")
    score = F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 6)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), "entity_id").limit(k)


def dense_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = DEPTH, block: int = BLOCK_ROWS) -> DataFrame:
    """query_id, entity_id, score and the other columns of vectors: the k vectors of greatest cosine for each query (query_id, embedding).

    block: about how many vectors, and how many queries, meet in a task.
    """
    return topk_batch(vectors, queries, k, None, block, block)


def with_search_vector(entities: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds search_vector, to be stored with the rows; fields: column by weight letter."""
    return entities.withColumn("search_vector", T.search_vector({letter: F.col(c) for letter, c in fields.items()}))


def keyword_topk(entities: DataFrame, query: str, fields: dict[str, str] | None = None, k: int = 10, id_col: str = "entity_id") -> DataFrame:
    """The k entities that answer a web-search query, by cover density, ties by id. A blank query has none.

    Rows with a stored search_vector need no fields; else the vector is made from them, for
    rows that hold the beginnings of a query's words.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    rows = entities
    if fields:
        columns = {letter: F.col(c) for letter, c in fields.items()}
        rows = entities.where(T.may_answer(list(columns.values()), query)).withColumn("search_vector", T.search_vector(columns, query))
    # in one expression, and without a filter that would make the vector twice: rows that don't answer have no score and come last
    score = F.transform(F.array("search_vector"), lambda v: F.when(T.answers(v, query), F.round(T.cover_rank(v, query), 9)))
    top = rows.select(id_col, F.get(score, F.lit(0)).alias("score")).orderBy(F.desc_nulls_last("score"), id_col).limit(k)
    return top.where("score is not null")


def ranked(hits: DataFrame, by: list[Column], retriever: str, query: list[str] | None = None) -> DataFrame:
    """(query columns, retriever, entity_id, rank) with ranks from 1."""
    window = Window.partitionBy(*(query or [F.lit(0)])).orderBy(*by)
    return hits.select(*(query or []), F.lit(retriever).alias("retriever"), "entity_id", F.row_number().over(window).cast("long").alias("rank"))


def rrf(rankings: list[DataFrame], query: list[str] | None = None, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: (query columns, entity_id, score, best_rank), an aggregate over the union."""
    every = reduce(DataFrame.unionByName, rankings)
    return every.groupBy(*(query or []), "entity_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best_rank"))


def normalised(fused: DataFrame, query: list[str] | None = None) -> DataFrame:
    """Scores over the greatest one; at most two retrievers' depth of rows for a query."""
    top = F.max("score").over(Window.partitionBy(*(query or [F.lit(0)])))
    return fused.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def order(fused: DataFrame) -> DataFrame:
    return fused.orderBy(F.desc("score"), "best_rank", "entity_id")


def hydrated(top: DataFrame, entities: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Ranked ids with columns of their entities, in the ranking's order; ids without an entity are left out. top: a page of results.

    The order is that of place where top has it, else of score, best_rank (where there is one) and id.
    """
    by = [F.col("place")] if "place" in top.columns else [F.desc("score"), *(F.col(c) for c in ("best_rank",) if c in top.columns), F.col("entity_id")]
    return F.broadcast(top).join(entities, "entity_id").orderBy(*by).select("entity_id", "score", *(c.alias(n) for n, c in columns.items()))


def hybrid(dense: DataFrame, keyword: DataFrame, top_k: int = 10) -> DataFrame:
    """Two ranked lists fused, normalised to the best and cut to top_k (cut after normalising, before hydration)."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    rankings = [ranked(dense, [F.desc("score"), F.col("entity_id")], "dense"), ranked(keyword, [F.desc("score"), F.col("entity_id")], "keyword")]
    return order(normalised(rrf(rankings))).limit(top_k)


def hybrid_batch(dense: DataFrame, keyword: DataFrame, top_k: int = 10) -> DataFrame:
    """hybrid() for each query_id of two ranked lists: query_id, entity_id, score and place, from 1."""
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    by, best = ["query_id"], [F.desc("score"), F.col("entity_id")]
    fused = normalised(rrf([ranked(dense, best, "dense", by), ranked(keyword, best, "keyword", by)], by), by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "best_rank", "entity_id"))
    return fused.withColumn("place", place).where(F.col("place") <= top_k).select("query_id", "entity_id", "score", "place")


def clean_matches(raw: DataFrame) -> DataFrame:
    """Raw vector matches (id string, score) with integer ids; others are dropped, a missing score is 0."""
    return raw.select(F.col("id").try_cast("bigint").alias("entity_id"), F.coalesce("score", F.lit(0.0)).alias("score")).where("entity_id is not null")


#: What a result shows of its entity; missing texts are empty, missing lines 0.
RESULT = ("file_path", "qualname", "entity_type", "signature", "source_code", "description", "start_line", "end_line")


def search(projects: DataFrame, project_id, entities: DataFrame, vectors: DataFrame, query: str, embed, top_k: int = 10) -> DataFrame:
    """The top_k entities of a project for a query: dense and keyword rankings fused, hydrated in order.

    projects: (id, status); entities: project_id, search_vector and the result's columns; vectors:
    (project_id, entity_id, embedding). A project that isn't ready raises before embed(query),
    which may cost money, is called. A blank query has no keyword hits. Ids of vectors without an
    entity in the project are left out after the cut, so a page may be shorter than top_k.
    """
    if top_k < 0:
        raise ValueError("top_k must not be negative")
    project = projects.where(F.col("id") == F.lit(project_id)).select("status").first()
    if project is None:
        raise LookupError("no such project")
    if project["status"] != "ready":
        raise ValueError(f"the project is {project['status']}, not ready")
    own, near = scoped(entities, project_id), scoped(vectors, project_id)
    dense = dense_topk(near, [float(x) for x in embed(query)], DEPTH).select("entity_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    keyword = keyword_topk(own.withColumnRenamed("id", "entity_id"), query, k=DEPTH)
    top = hybrid(dense, keyword, top_k)
    shown = {c: F.coalesce(F.col(c), F.lit(0 if c.endswith("line") else "")) for c in RESULT}
    return hydrated(top, own.withColumnRenamed("id", "entity_id"), shown)


def scoped(rows: DataFrame, project_id) -> DataFrame:
    """The rows of one project: the filter reaches the scan."""
    return rows.where(F.col("project_id") == F.lit(project_id))


def drop_namespace(vectors: DataFrame, project_id) -> DataFrame:
    """The vectors without those of a project."""
    return vectors.where(~F.col("project_id").eqNullSafe(F.lit(project_id)))
