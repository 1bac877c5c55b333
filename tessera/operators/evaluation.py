"""Retrieval metrics over (query_id, entity_id, rank) and expected (query_id, entity_id), and checks of labelled queries.

A label is `path::qualname`. Labelled queries and page-long rankings are small beside the corpus,
so they are broadcast where a count finds them so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcomes(queries: DataFrame, ranking: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Adds to each query: first_hit (null for a miss), found (expected ones within k) and wanted."""
    hits = expected.join(ranking, ["query_id", "entity_id"], "left")
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first_hit"), F.count_distinct(F.when(F.col("rank") <= k, F.col("entity_id"))).alias("found"), F.count_distinct("entity_id").alias("wanted"))
    return queries.join(per, "query_id", "left").withColumns({"found": F.coalesce("found", F.lit(0)), "wanted": F.coalesce("wanted", F.lit(0))})


def hit_within(k: int) -> Column:
    return F.coalesce((F.col("first_hit") <= k).cast("double"), F.lit(0.0))


def metrics() -> list[Column]:
    reciprocal = F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)))
    recall = F.avg(F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("wanted").cast("double")), F.lit(0.0)))
    return [F.count("*").alias("n"), *(F.round(F.avg(hit_within(k)), 9).alias(f"success_{k}") for k in (1, 5, 10)), F.round(recall, 9).alias("strict_recall_5"), F.round(reciprocal, 9).alias("mrr")]


def report(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.groupBy(*by).agg(*metrics()) if by else found.agg(*metrics())


def head_to_head(base: DataFrame, other: DataFrame, k: int = 5) -> DataFrame:
    """How many queries the other strategy gains, loses, or finds at another rank within k."""
    a, b = base.select("query_id", F.col("first_hit").alias("a")), other.select("query_id", F.col("first_hit").alias("b"))
    in_a, in_b = (F.coalesce(F.col(x) <= k, F.lit(False)) for x in "ab")
    return a.join(b, "query_id").agg(
        F.count_if(~in_a & in_b).alias("gained"), F.count_if(in_a & ~in_b).alias("lost"),
        F.count_if((in_a == in_b) & ~F.col("a").eqNullSafe(F.col("b"))).alias("reordered"),
    )


SUMMARY = ("success_1", "success_5", "success_10", "strict_recall_5", "mrr")
#: Up to so many rows a table of labels is broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count finds few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def split_label(label: Column) -> tuple[Column, Column]:
    """Path and name of a label, cut at the last `::`; without one, all of it is the name."""
    name = F.substring_index(label, "::", -1)
    path = F.substring(label, F.lit(1), F.greatest(F.lit(0), F.length(label) - F.length(name) - 2))
    return path, name


def resolved(ranking: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The ranking with file_path and qualname of its ids; unknown ids are dropped, and ranks close up.

    catalogue: (entity_id, file_path, qualname). Ranks close within a query's page of results.
    """
    known = small(ranking).join(catalogue.select("entity_id", "file_path", "qualname"), "entity_id")
    return known.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "entity_id")).cast("long"))


def _suffix(text: Column, length: Column) -> Column:
    return F.substring(text, F.length(text) - length + 1, length)


def label_match(labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query_id, label, entity_id): a label means the entities of its name whose path it ends with, or that ends with its path.

    The longer path is cut to each length that the other side has for the name, so paths meet by
    equality: a name that most entities share compares no pair that doesn't match.
    """
    path, name = split_label(F.replace("label", F.lit("\\"), F.lit("/")))
    wanted = labels.select("query_id", "label", path.alias("want"), name.alias("qualname"))
    names = small(wanted.select("qualname").distinct())
    stored = catalogue.select("entity_id", F.replace("file_path", F.lit("\\"), F.lit("/")).alias("path"), "qualname").join(names, "qualname", "left_semi")
    lengths = lambda rows, column: rows.groupBy("qualname").agg(F.collect_set(F.length(column)).alias("lengths"))
    cut = stored.join(small(lengths(wanted, "want")), "qualname").withColumn("length", F.explode("lengths")).where(F.length("path") >= F.col("length"))
    within = cut.select("qualname", "entity_id", _suffix(F.col("path"), F.col("length")).alias("want")).join(small(wanted), ["qualname", "want"])
    longer = wanted.join(lengths(stored, "path"), "qualname").withColumn("length", F.explode("lengths")).where(F.length("want") > F.col("length"))
    beyond = stored.join(small(longer.select("query_id", "label", "qualname", _suffix(F.col("want"), F.col("length")).alias("path"))), ["qualname", "path"])
    both = ["query_id", "label", "entity_id"]
    return within.select(*both).unionAll(beyond.select(*both))


def label_outcomes(queries: DataFrame, ranking: DataFrame, labels: DataFrame, catalogue: DataFrame, k: int = 5) -> DataFrame:
    """outcomes() where several entities may satisfy a label: found and wanted count labels."""
    hits = label_match(labels, catalogue).join(small(resolved(ranking, catalogue).select("query_id", "entity_id", "rank")), ["query_id", "entity_id"])
    per = hits.groupBy("query_id").agg(F.min("rank").alias("first_hit"), F.count_distinct(F.when(F.col("rank") <= k, F.col("label"))).alias("found"))
    wanted = labels.groupBy("query_id").agg(F.count("*").alias("wanted"))
    return queries.join(per, "query_id", "left").join(wanted, "query_id", "left").withColumns({"found": F.coalesce("found", F.lit(0)), "wanted": F.coalesce("wanted", F.lit(0))})


def misses(found: DataFrame, ranking: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """The queries without a hit within k: why (found at a later rank, or not in the top depth) and the first id of their ranking."""
    top = ranking.where("rank = 1").select("query_id", F.col("entity_id").alias("top1"))
    missed = found.where(F.col("first_hit").isNull() | (F.col("first_hit") > k))
    reason = F.when(F.col("first_hit").isNotNull(), F.concat(F.lit("found at "), F.col("first_hit").cast("string"))).otherwise(f"not in top {depth}")
    return missed.join(top, "query_id", "left").withColumn("reason", reason)


def strategy_deltas(reports: DataFrame, base: str) -> DataFrame:
    """Each strategy's metrics less the base strategy's; reports: strategy and the metrics, a row for each."""
    first = reports.where(F.col("strategy") == base).select(*(F.col(m).alias(f"base_{m}") for m in SUMMARY))
    return reports.crossJoin(F.broadcast(first)).select("strategy", *(F.round(F.col(m) - F.col(f"base_{m}"), 9).alias(f"delta_{m}") for m in SUMMARY))  # one row


def unknown_labels(labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The labels that are no entity's key."""
    known = catalogue.select(F.concat_ws("::", F.replace("file_path", F.lit("\\"), F.lit("/")), "qualname").alias("label"))
    return labels.join(known, "label", "left_anti")


def frequent_anchors(labels: DataFrame, most: int = 2) -> DataFrame:
    """The labels that more than `most` queries expect."""
    return labels.groupBy("label").agg(F.count("*").alias("queries")).where(F.col("queries") > most)


def category_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("category").agg(F.count("*").alias("queries"))


def anchor_count(labels: DataFrame) -> DataFrame:
    """How many different answers there are."""
    return labels.agg(F.count_distinct("label").alias("distinct_answers"))


#: Words that tell nothing about a query.
PLAIN = [
    "a", "an", "the", "of", "to", "and", "or", "with", "for", "in", "on", "at", "by", "that", "this", "is",
    "are", "be", "we", "it", "its", "one", "under", "every", "when", "into", "out", "up", "so", "not",
]


def distinctive_terms(query: Column) -> Column:
    """The lower-cased words of a query, without punctuation at their ends, of more than three letters and not plain."""
    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: F.regexp_replace(w, r"^[,.?'\"]+|[,.?'\"]+$", ""))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(PLAIN))


def grams(text: Column, n: int = 4) -> Column:
    """The different runs of n characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def terms_within(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """The terms (term) that stand in some text (text) or other, as substrings.

    A term has no white space and four characters at least, so it stands in one of the different
    words of the texts. Terms and words meet by one four-character run of the term, and candidates
    are verified. Neither terms nor texts pass the driver.
    """
    words = texts.select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).where(F.length("word") >= 4).distinct()
    key = F.array_min(F.transform(grams(F.col("term")), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("gram"))))["gram"]
    wanted = terms.select("term").distinct().withColumn("gram", key)
    met = words.select("word", F.explode(grams(F.col("word"))).alias("gram")).join(small(wanted), "gram")
    return met.where(F.contains("word", F.col("term"))).select("term").distinct()


def plain_jargon(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """The jargon queries (query_id, category, query) all of whose distinctive terms stand in some source (source_code) or other."""
    terms = queries.where("category = 'jargon'").select("query_id", "query", distinctive_terms(F.col("query")).alias("terms"))
    each = terms.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    found = terms_within(each.select("term"), sources.select(F.lower("source_code").alias("text")))
    lacking = each.join(found, "term", "left_anti").select("query_id").distinct()
    return terms.where(F.size("terms") > 0).join(lacking, "query_id", "left_anti")


def strategies(dense: DataFrame, keyword: DataFrame, depth: int = 10) -> dict[str, DataFrame]:
    """The rankings (query_id, entity_id, rank) of each strategy, from two scored lists of candidates."""
    from . import retrieval as R

    best = [F.desc("score"), F.col("entity_id")]
    lists = {"dense": R.ranked(dense, best, "dense", ["query_id"]), "keyword": R.ranked(keyword, best, "keyword", ["query_id"])}
    out = {name: x.where(F.col("rank") <= depth).select("query_id", "entity_id", "rank") for name, x in lists.items()}
    return out | {"hybrid": R.hybrid_batch(dense, keyword, depth).select("query_id", "entity_id", F.col("place").cast("long").alias("rank"))}
