"""The inverted index behind keyword search: Parquet postings, and top-k over the postings of a query's lexemes alone.

A posting is a lexeme of an entity with its places and their letters, as whole numbers. Below
`postings`, rows lie in folders by segment (the entities of some tasks of the run that wrote them) and
bucket (a hash of the lexeme), sorted by lexeme and tier; a query's filters on bucket, lexeme and
tier reach the scan. Bucket -1 has a row for every entity. An entity's tier is the logarithm of its
number of tokens. `impacts` has, for lexemes and tiers, how many entities hold one and the most
it can add to a score. A tier that can't reach the k-th best score of the tiers before it is not read.

Postings are written by the tasks that read the texts: nothing is shuffled. An index may be of some
lexemes alone, those of the queries it is made for: it reads all texts, and holds what a whole index
has of these lexemes; a query with others is an error. An update by entity id
takes the ids out of the segments that have them, which alone are written again with Spark's
dynamic partition overwrite, and puts what is new into segments of its own; files of other segments
stay. A folder that is left without postings gets a row without a lexeme, as Spark overwrites only
folders that have rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written

POSTING = "entity_id long, tier int, lexeme string, places array<int>"
IMPACT = "segment int, bucket int, lexeme string, tier int, n int, worth double, top double, docs long"
#: A place is stored as its number times four and the number of its letter here.
LETTERS = "ABCD"
#: The bytes of tokens.
IN_TOKEN = np.array([48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
#: Rows and bytes of an Arrow batch that are turned into postings at once; a longer text is alone.
ROWS, BYTES = 512, 4 << 20
#: Segments that a run makes at most, and the bucket of the entities themselves.
MOST_SEGMENTS, ENTITIES = 1024, -1
#: Up to so many ids are broadcast as candidates; their number is known from the impacts.
BROADCAST_IDS = 1_000_000
#: Rows whose covers are counted at once.
RANKED = 2048
#: Up to so many different queries are broadcast; beyond, they are joined by shuffles.
BROADCAST_QUERIES = 200_000


class Index(NamedTuple):
    spark: SparkSession
    path: str
    buckets: int
    stemmer: str
    only: frozenset[str] | None = None  # the lexemes that it has; None: all

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each token, tokens): the runs of a-z and 0-9 of lower-cased texts, all at once."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letter = IN_TOKEN[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = ends[:-1][ends[:-1] < ends[1:]]
    first[starts] = letter[starts]  # a text's first token doesn't go on the last one's
    begin = np.flatnonzero(first)
    before = np.append(0, letter.cumsum())
    offsets = np.append(before[begin], before[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[letter].tobytes()))
    return np.searchsorted(ends, begin, "right") - 1, words


def _parts(batch: pa.RecordBatch):
    """A batch in slices of ROWS rows and some BYTES at most."""
    ends = np.sum([pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[1:]], axis=0).cumsum()
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, "right"))
        to = min(max(at + 1, to), at + ROWS)
        yield batch.slice(at, to - at)
        at = to


def _made(letters: str, stemmer: str, only: frozenset[str] | None = None):
    """A function for mapInArrow: the postings of (entity_id, a lower-cased text for each letter), and a row without a lexeme for each entity."""
    codes, stem = np.array([LETTERS.index(x) for x in letters]), T.STEMMERS[stemmer]

    def lexeme_of(word: str) -> str | None:
        made = None if word in T.STOP else stem(word)
        return made if only is None or made in only else None

    def run(batches):
        stems: dict[str, str | None] = {}
        for batch in batches:
            for part in _parts(batch):
                found = [_tokens(c) for c in part.columns[1:]]
                sizes = [np.bincount(row, minlength=part.num_rows) for row, _ in found]
                before = np.cumsum([np.zeros(part.num_rows, np.int64), *sizes[:-1]], axis=0)
                row = np.concatenate([r for r, _ in found])
                place = np.concatenate([np.arange(len(r)) - (s.cumsum() - s - b)[r] for (r, _), s, b in zip(found, sizes, before)])
                letter = np.repeat(np.arange(len(letters)), [len(r) for r, _ in found])
                words = pa.chunked_array([w for _, w in found], pa.large_string()).combine_chunks().dictionary_encode()
                known: dict[str, int] = {}
                of = np.zeros(len(words.dictionary), np.int64)
                for i, w in enumerate(words.dictionary.to_pylist()):  # a stem is made once for each different word
                    s = stems[w] if w in stems else stems.setdefault(w, lexeme_of(w))
                    of[i] = -1 if s is None else known.setdefault(s, len(known))
                if len(stems) > 200_000:
                    stems.clear()
                lexeme = of[words.indices.to_numpy()] if len(row) else np.zeros(0, np.int64)
                kept = np.flatnonzero(lexeme >= 0)
                order = kept[np.argsort(row[kept] * (len(known) + 1) + lexeme[kept], kind="stable")]  # places rise already
                row, place, letter, lexeme = row[order], place[order], letter[order], lexeme[order]
                begin = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lexeme[1:] != lexeme[:-1]))) if len(row) else np.zeros(0, np.int64)
                tier = np.floor(np.log2(np.bincount(row, minlength=part.num_rows) + 1)).astype(np.int32)
                places = pa.array((place * len(LETTERS) + codes[letter]).astype(np.int32))
                ends = np.append(begin, len(row))
                lists = pa.ListArray.from_arrays(pa.array(np.append(ends, np.full(part.num_rows, len(row))), pa.int32()), places)  # an entity's own row has none
                names = pa.array(list(known), pa.string()).take(pa.array(np.append(lexeme[begin], np.zeros(part.num_rows, np.int64)), pa.int64(), mask=np.append(np.zeros(len(begin), bool), np.ones(part.num_rows, bool))))
                of_row = np.append(row[begin], np.arange(part.num_rows)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of_row)).cast(pa.int64()), pa.array(tier[of_row], pa.int32()), names, lists], names=["entity_id", "tier", "lexeme", "places"])
        pa.default_memory_pool().release_unused()  # the worker's next task starts without this one's memory

    return run


def decoded(places: Column, lexeme: Column) -> Column:
    """A posting's places as structs of at, lexeme and letter."""
    letters = F.array(*map(F.lit, LETTERS))
    return F.transform(places, lambda p: F.struct((p / len(LETTERS)).cast("int").alias("at"), lexeme.alias("lexeme"), F.get(letters, p % len(LETTERS)).alias("letter")))


def vector_of(held: Column) -> Column:
    """The search vector of an entity's postings (lexeme, places)."""
    return F.array_sort(F.flatten(F.transform(held, lambda h: decoded(h["places"], h["lexeme"]))))


def postings_of(entities: DataFrame, fields: dict[str, str], id_col: str = "entity_id", stemmer: str = "rules", only: frozenset[str] | None = None) -> DataFrame:
    """The postings of entities (only: of some lexemes) and their own rows; fields: column by weight letter. Null texts have no tokens, rows without an id are left out."""
    rows = entities.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("entity_id"), *(F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"f{letter}") for letter, c in fields.items()))
    return rows.mapInArrow(_made("".join(fields), stemmer, only), POSTING)


def bucket_of(lexeme: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def _impacts(batches):
    """For mapInArrow over (segment, bucket, lexeme, tier, places): a row for each lexeme and tier of a batch."""
    weights = np.array([T.WEIGHTS[x] for x in LETTERS])
    for batch in batches:
        rows = batch.filter(pc.is_valid(batch.column(2)))
        if not rows.num_rows:
            continue
        lists = rows.column(4)
        n = pc.list_value_length(lists).to_numpy()
        w = weights[pc.list_flatten(lists).to_numpy() % len(LETTERS)]
        begin = n.cumsum() - n
        table = pa.table([*rows.columns[:4], pa.array(n, pa.int32()), pa.array(np.add.reduceat(w, begin)), pa.array(np.maximum.reduceat(w, begin))], names=["segment", "bucket", "lexeme", "tier", "n", "worth", "top"])
        most = table.group_by(["segment", "bucket", "lexeme", "tier"]).aggregate([("n", "max"), ("worth", "max"), ("top", "max"), ("n", "count")])
        most = most.select(["segment", "bucket", "lexeme", "tier", "n_max", "worth_max", "top_max", "n_count"]).rename_columns(["segment", "bucket", "lexeme", "tier", "n", "worth", "top", "docs"])
        yield from most.to_batches()


def _put(index: Index, rows: DataFrame, name: str) -> None:
    """Writes rows into their folders, sorted; folders that have rows here are written again."""
    by = ["segment", "bucket"]
    rows.sortWithinPartitions(*by, "lexeme", "tier").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(f"{index.path}/{name}")


def _put_impacts(index: Index, segments: list[int] | None = None) -> None:
    rows = index.read("postings").select("segment", "bucket", "lexeme", "tier", "places")
    if segments is not None:
        rows = rows.where(F.col("segment").isin(segments))
    made = rows.mapInArrow(_impacts, IMPACT)
    if segments is not None:
        made = made.unionByName(_folders(index, segments), allowMissingColumns=True)
    _put(index, made, "impacts")


def _folders(index: Index, segments: list[int]) -> DataFrame:
    """A row without a lexeme for each folder of some segments."""
    each = index.spark.createDataFrame([(s,) for s in segments], "segment int")
    return each.select("segment", F.explode(F.sequence(F.lit(ENTITIES), F.lit(index.buckets - 1))).alias("bucket")).coalesce(1)


def _in_folders(index: Index, postings: DataFrame, first: int) -> DataFrame:
    """Postings with segment, by the task that makes them, and bucket."""
    bucket = F.when(F.col("lexeme").isNull(), ENTITIES).otherwise(bucket_of(F.col("lexeme"), index.buckets))
    return postings.withColumns({"segment": (F.lit(first) + F.spark_partition_id() % MOST_SEGMENTS).cast("int"), "bucket": bucket})


def build(entities: DataFrame, fields: dict[str, str], path: str, id_col: str = "entity_id", buckets: int = 16, stemmer: str = "rules", only: frozenset[str] | None = None) -> Index:
    """A new index below path. Ids are keys: rows that repeat one are one entity's places twice. stemmer: a name in T.STEMMERS. only: the lexemes it is to have (None: all)."""
    spark = entities.sparkSession
    held = None if only is None else sorted(only)
    spark.createDataFrame([(buckets, stemmer, held)], "buckets int, stemmer string, only array<string>").coalesce(1).write.parquet(f"{path}/shape")
    index = Index(spark, path, buckets, stemmer, only)
    for name, columns in (("postings", f"{POSTING}, segment int, bucket int"), ("impacts", IMPACT)):  # an empty table has a schema, too
        spark.createDataFrame([(0, ENTITIES)], "segment int, bucket int").select(*(F.lit(None).cast(kind).alias(c) if c not in ("segment", "bucket") else F.col(c) for c, kind in (x.split(" ", 1) for x in columns.split(", ")))).write.partitionBy("segment", "bucket").parquet(f"{path}/{name}")
    _put(index, _in_folders(index, postings_of(entities, fields, id_col, stemmer, only), 1), "postings")
    _put_impacts(index)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    shape = spark.read.parquet(f"{path}/shape").first()
    return Index(spark, path, shape["buckets"], shape["stemmer"], None if shape["only"] is None else frozenset(shape["only"]))


def update(index: Index, changed: DataFrame, fields: dict[str, str], gone: DataFrame | None = None, id_col: str = "entity_id") -> None:
    """Replaces or adds the postings of changed entities and drops those of gone (id_col): only the segments that have these ids are written again.

    Their new content is stored apart before it takes the old one's place, as that is read for it.
    """
    ids = changed.select(F.col(id_col).cast("long").alias("entity_id"))
    out = written((ids if gone is None else ids.unionByName(gone.select(F.col(id_col).cast("long").alias("entity_id")))).where("entity_id is not null").distinct(), "out")
    held = index.read("postings")
    few = F.broadcast(out) if out.count() <= BROADCAST_IDS else out
    own = held.where(F.col("bucket") == ENTITIES)
    segments = sorted(r["segment"] for r in own.join(few, "entity_id", "left_semi").select("segment").distinct().collect())  # MOST_SEGMENTS for each run
    first = (own.agg(F.max("segment").alias("s")).first()["s"] or 0) + 1
    columns = [*(c.split(" ")[0] for c in POSTING.split(", ")), "segment", "bucket"]
    kept = held.where(F.col("segment").isin(segments)).where("entity_id is not null").join(few, "entity_id", "left_anti").select(*columns)
    kept = written(kept, "kept")
    new = written(_in_folders(index, postings_of(changed, fields, id_col, index.stemmer, index.only), first).select(*columns), "new")
    added = sorted(r["segment"] for r in new.select("segment").distinct().collect())
    _put(index, kept.unionByName(new).unionByName(_folders(index, segments), allowMissingColumns=True), "postings")
    _put_impacts(index, segments + added)


def lexemes_of(query: str, stemmer: str = "rules") -> frozenset[str]:
    """The different lexemes of a query, for an index of these alone."""
    return frozenset(w for alt in T.lexemes(query, stemmer) for _, phrase in alt for _, w in phrase)


# --- one query ---------------------------------------------------------------------------------


def _of_lexemes(index: Index, name: str, words: list[str]) -> DataFrame:
    """The rows of some lexemes: filters on the folder and on the sorted column."""
    return index.read(name).where(F.col("bucket").isin(*(bucket_of(F.lit(w), index.buckets) for w in words)) & F.col("lexeme").isin(words))


def bounds(index: Index, query: str) -> dict[int, tuple[float, int]]:
    """For each tier that holds a lexeme of a query: the most that an entity's score can be, and an estimate of how many answer.

    A cover ends at a place of its own, and is worth no more than the greatest weight; the first
    places, one less than there are terms, end none. With one term the score is the sum of its weights.
    """
    parsed = T.lexemes(query, index.stemmer)
    terms = sorted({w for alt in parsed for negated, phrase in alt if not negated for _, w in phrase})
    if not terms:
        return {}
    most = _of_lexemes(index, "impacts", terms).groupBy("lexeme", "tier").agg(F.max("n").alias("n"), F.max("worth").alias("worth"), F.max("top").alias("top"), F.sum("docs").alias("docs"))
    tiers: dict[int, dict] = {}
    for r in most.collect():  # terms times tiers, of which there are some 30
        tiers.setdefault(r["tier"], {})[r["lexeme"]] = r
    out = {}
    for tier, held in tiers.items():
        if len(terms) == 1:
            bound = held[terms[0]]["worth"]
        else:
            bound = (sum(r["n"] for r in held.values()) - len(terms) + 1) * max(r["top"] for r in held.values()) if len(held) == len(terms) else 0.0
        out[tier] = (bound, min(held[t]["docs"] if t in held else 0 for t in terms))
    return out


def _scored(index: Index, query: str, tiers: list[int] | None, k: int) -> DataFrame:
    """The k best entities among some tiers (all if None): postings meet by entity, the rarest lexeme's first."""
    parsed = T.lexemes(query, index.stemmer)
    words = sorted({w for alt in parsed for _, phrase in alt for _, w in phrase})
    rows = _of_lexemes(index, "postings", words)
    if tiers is not None:
        rows = rows.where(F.col("tier").isin(tiers))
    met = rows.groupBy("entity_id").agg(F.collect_list(F.struct("lexeme", "places")).alias("held"))  # an entity has a row for each lexeme of the query
    if any(all(negated for negated, _ in alt) for alt in parsed):  # entities without any of the words answer
        met = index.read("postings").where((F.col("bucket") == ENTITIES) & F.col("entity_id").isNotNull()).select("entity_id").distinct().join(met, "entity_id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<lexeme:string,places:array<int>>>")))
    terms = sorted({w for alt in parsed for negated, phrase in alt if not negated for _, w in phrase})
    rank = lambda v: T.cover_rank_of(v, F.array(*map(F.lit, terms))) if terms else F.lit(0.0)
    score = F.transform(F.array(vector_of(F.col("held"))), lambda v: F.when(T.answers(v, query, index.stemmer), F.round(rank(v), 9)))
    return met.select("entity_id", F.get(score, F.lit(0)).alias("score")).where("score is not null").orderBy(F.desc("score"), "entity_id").limit(k)


def keyword_topk(index: Index, query: str, k: int = 10) -> DataFrame:
    """entity_id and score of the k entities that answer a web-search query, by cover density, ties by id. A blank query has none.

    Tiers of the highest bounds are scored first; the others are read only if their bound reaches
    the k-th score found. Only the folders of the query's lexemes are read.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    parsed = T.lexemes(query, index.stemmer)
    if index.only is not None and not lexemes_of(query, index.stemmer) <= index.only:
        raise ValueError("the index has only other lexemes than those of the query")
    if not parsed or k == 0:
        return index.spark.createDataFrame([], "entity_id long, score double")
    if any(all(negated for negated, _ in alt) for alt in parsed):
        return _scored(index, query, None, k)
    tiers = sorted(((bound, docs, tier) for tier, (bound, docs) in bounds(index, query).items()), reverse=True)
    chosen, enough = [], 0
    for _, docs, tier in tiers:
        if enough < 4 * k:
            chosen.append(tier)
            enough += docs
    first = _scored(index, query, chosen, k)
    if len(chosen) == len(tiers):
        return first
    page = first.collect()  # k rows
    floor = page[-1]["score"] if len(page) == k else float("-inf")
    more = [tier for bound, _, tier in tiers if tier not in chosen and bound + 1e-8 >= floor]
    return _scored(index, query, chosen + more, k) if more else index.spark.createDataFrame([tuple(r) for r in page], "entity_id long, score double")


def _ranks(batches):
    """For mapInArrow over (query, entity_id, terms, held): the cover density of each row's terms in its postings, all rows at once."""
    weights = np.array([T.WEIGHTS[x] for x in LETTERS])
    for batch in batches:
        for at in range(0, batch.num_rows, RANKED):
            part = batch.slice(at, RANKED)
            n = part.num_rows
            terms, held = part.column(2), part.column(3)
            many = pc.list_value_length(terms).to_numpy()
            names = pc.list_flatten(terms).dictionary_encode()
            post = pc.list_flatten(held)
            lexeme = pc.fill_null(pc.index_in(post.field("lexeme"), names.dictionary), -1).to_numpy()
            asked = names.indices.to_numpy() + np.repeat(np.arange(n), many) * (len(names.dictionary) + 1)
            row = pc.list_parent_indices(held).to_numpy()
            mine = lexeme + row * (len(names.dictionary) + 1)
            order = np.argsort(asked)
            found = np.minimum(np.searchsorted(asked[order], mine), max(0, len(asked) - 1))
            is_term = (lexeme >= 0) & (asked[order][found] == mine) if len(asked) else np.zeros(len(mine), bool)
            term = (np.arange(len(asked)) - np.repeat(many.cumsum() - many, many))[order][found] if len(asked) else np.zeros(len(mine), np.int64)
            lists = post.field("places")
            length = pc.list_value_length(lists).to_numpy()
            places = pc.list_flatten(lists).to_numpy().astype(np.int64)
            row, term, kept = np.repeat(row, length), np.repeat(term, length), np.repeat(is_term, length)
            row, term, places = row[kept], term[kept], places[kept]
            order = np.lexsort((places % len(LETTERS), term, places // len(LETTERS), row))  # as vector_of() has them
            row, term, place, weight = row[order], term[order], places[order] // len(LETTERS), weights[places[order] % len(LETTERS)]
            begin = np.searchsorted(row, np.arange(n))[row]
            low, inverse, whole, index = np.full(len(row), np.iinfo(np.int64).max), np.zeros(len(row)), np.ones(len(row), bool), np.arange(len(row))
            for t in range(int(many.max(initial=0))):
                last = np.maximum.accumulate(np.where(term == t, index, -1)) if len(row) else index
                there, used = last >= begin, many[row] > t
                whole &= there | ~used
                use = there & used
                low[use] = np.minimum(low[use], place[last[use]])
                inverse[use] += 1 / weight[last[use]]
            at_end = np.flatnonzero(whole)  # a cover that starts where the last one did isn't minimal
            fresh = at_end[np.append(True, (row[at_end][1:] != row[at_end][:-1]) | (low[at_end][1:] > low[at_end][:-1]))] if len(at_end) else at_end
            size = many[row[fresh]]
            total = np.bincount(row[fresh], size / inverse[fresh] / (place[fresh] - low[fresh] + 2 - size), minlength=n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total, pa.float64())], names=["query", "entity_id", "score"])


# --- many queries ------------------------------------------------------------------------------


def keyword_batch(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, entity_id and score: keyword_topk() for each row of queries (query_id, query).

    The postings of the lexemes asked meet by entity, each once, whatever the number of queries. An
    entity's queries are those of its lexemes that are the rarest of an alternative whose other lexemes
    it holds, too: a word that every entity holds is no hot key, and no pair of a query and an entity
    is shuffled before it has a score. Queries of one text are answered once. An
    alternative of negated terms alone has no candidates here. query_id is a key; a null or blank
    query has no rows. An index of some lexemes alone must have those of all queries.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    alike = queries.where("query_id is not null and query is not null").select("query_id", "query")
    asked = alike.select("query").distinct().select("query", T.parsed_queries(F.col("query"), index.stemmer).alias("parsed")).where("size(parsed) > 0")
    asked = written(asked, "asked")
    alt = asked.select("query", F.posexplode("parsed").alias("alt", "terms"))
    word = alt.select("query", "alt", F.explode("terms").alias("t")).select("query", "alt", "t.negated", F.explode("t.phrase.lexeme").alias("lexeme")).distinct()
    word = word.withColumn("bucket", bucket_of(F.col("lexeme"), index.buckets))
    wanted = word.select("bucket", "lexeme").distinct()
    df = index.read("impacts").join(wanted, ["bucket", "lexeme"], "left_semi").groupBy("lexeme").agg(F.sum("docs").alias("docs"))
    few = F.broadcast if asked.count() <= BROADCAST_QUERIES else lambda rows: rows
    need = word.where("not negated").join(df, "lexeme", "left").groupBy("query", "alt").agg(F.min_by("lexeme", F.struct(F.coalesce("docs", F.lit(0)), F.col("lexeme"))).alias("lexeme"), F.collect_set("lexeme").alias("needed"))
    need = written(need.select("query", "lexeme", "needed"), "need")
    postings = index.read("postings").where((F.col("bucket") != ENTITIES) & F.col("lexeme").isNotNull())
    held = postings.join(few(wanted), ["bucket", "lexeme"], "left_semi").groupBy("entity_id").agg(F.collect_list(F.struct("lexeme", "places")).alias("held"))
    names = F.array_distinct(F.col("held")["lexeme"])  # of an entity, so that its queries are found where its postings are
    met = held.select("entity_id", names.alias("names")).select("entity_id", "names", F.explode("names").alias("lexeme")).join(few(need), "lexeme")
    met = met.where(F.forall("needed", lambda w: F.array_contains("names", w))).select("entity_id", "query").distinct()
    words = few(asked.join(word.groupBy("query").agg(F.collect_set("lexeme").alias("words")), "query"))
    each = met.join(held, "entity_id").join(words, "query").select("query", "entity_id", "parsed", F.filter("held", lambda h: F.array_contains("words", h["lexeme"])).alias("held"))
    # one alternative of words alone is answered where all are there
    plain = (F.size("parsed") == 1) & F.forall(F.flatten("parsed"), lambda t: ~t["negated"] & (F.size(t["phrase"]) == 1))
    answering = each.where(plain | F.get(F.transform(F.array(vector_of(F.col("held"))), lambda v: T.answers_parsed(v, F.col("parsed"))), F.lit(0)))
    ranks = answering.select("query", "entity_id", T.positive(F.col("parsed")).alias("terms"), "held").mapInArrow(_ranks, "query string, entity_id long, score double")
    scored = ranks.withColumn("score", F.round("score", 9))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entity_id")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return alike.join(top, "query").select("query_id", "entity_id", "score")
