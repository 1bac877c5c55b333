"""Postings and block joins of vectors against plain versions."""

import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import english
from tessera.functions import text as T
from tessera.operators import nearest
from tessera.operators import retrieval as R
from tessera.plans import postings, registry
from tessera.sources.shared import shared_dir

WORDS = ["wait", "waits", "waiting", "box", "boxes", "retry", "policy", "the", "of", "rare", "é", "x1"]
FIELDS = {"A": "name", "D": "text"}
QUERIES = ["wait", "wait box", '"wait box"', "box or rare", "retry -box", "-box", '-"wait box" policy', '"retry policy" or "wait the box"', "rare x1 wait", "zzz", "zzz or box", "wait zzz", "the of", "", '"box box" wait', "-wait or rare"]


def entities(spark, n, seed=1):
    r = random.Random(seed)
    text = lambda most: " ".join(r.choices(WORDS, [9, 3, 1, 9, 2, 5, 4, 9, 9, 0.2, 1, 0.3], k=r.randint(0, most)))
    rows = [(i, text(2), text(120 if i % 17 == 0 else 8)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, None), (n + 1, "", "wait")], "entity_id long, name string, text string")


def plain(df, query, k):
    return [(r.entity_id, pytest.approx(r.score)) for r in R.keyword_topk(df, query, FIELDS, k).collect()] if "-" not in query else [
        (r.entity_id, pytest.approx(r.score)) for r in R.keyword_topk(R.with_search_vector(df, FIELDS), query, None, k).collect()]


@pytest.fixture(scope="module")
def built(spark):
    df = entities(spark, 300).cache()
    return df, postings.build(df, FIELDS, f"{shared_dir(spark)}/index", buckets=4)


@pytest.mark.parametrize("query", QUERIES)
def test_postings_answer_like_a_scan(built, query):
    df, index = built
    for k in (1, 7):
        assert [(r.entity_id, r.score) for r in postings.keyword_topk(index, query, k).collect()] == plain(df, query, k)


def test_a_batch_of_queries(spark, built):
    df, index = built
    asked = [(i, q) for i, q in enumerate(QUERIES) if q not in ("-box", "-wait or rare")] + [(99, None)]
    got = postings.keyword_batch(index, spark.createDataFrame(asked, "query_id long, query string"), 5).orderBy("query_id", F.desc("score"), "entity_id").collect()
    assert [(r.query_id, r.entity_id, r.score) for r in got] == [(i, *hit) for i, q in asked if q for hit in plain(df, q, 5)]


def test_plans_read_only_a_lexemes_folder(spark, built, capsys):
    _, index = built
    rows = postings._of_lexemes(index, "postings", ["box"])
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(lexeme,box)" in plan
    read = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in read}) == 1


def test_tiers_that_cannot_reach_are_skipped(spark):
    """Long entities that hold a word often win, and short ones are not read."""
    rows = [(i, "", "wait " * 40 + "pad " * 100) for i in range(50)] + [(100 + i, "", "wait pad") for i in range(500)]
    df = spark.createDataFrame(rows, "entity_id long, name string, text string")
    index = postings.build(df, FIELDS, f"{shared_dir(spark)}/index", buckets=2)
    seen = []
    scored = postings._scored
    try:
        postings._scored = lambda i, q, tiers, k: seen.append(tiers) or scored(i, q, tiers, k)
        got = [r.entity_id for r in postings.keyword_topk(index, "wait", 10).collect()]
    finally:
        postings._scored = scored
    assert got == list(range(10)) and len(seen) == 1 and len(seen[0]) == 1
    bound = postings.bounds(index, "wait pad")
    assert max(b for b, _ in bound.values()) >= max(r.score for r in R.keyword_topk(df, "wait pad", FIELDS, 1).collect())


def test_update_by_entity(spark):
    df = entities(spark, 300).repartition(8)
    path = f"{shared_dir(spark)}/index"
    index = postings.build(df, FIELDS, path, buckets=4)
    changed = spark.createDataFrame([(5, "rare", "rare wait box"), (1000, "new", "rare"), (6, None, None)], "entity_id long, name string, text string")
    gone = spark.createDataFrame([(7,), (8,)], "entity_id long")
    local = path.removeprefix("file:")
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(f"{local}/postings") for f in names if f.endswith(".parquet")}
    before = files()
    own = index.read("postings").where("bucket = -1")
    touched = {r.segment for r in own.where("entity_id in (5, 6, 7, 8, 1000)").collect()}
    most = own.agg(F.max("segment")).first()[0]
    postings.update(index, changed, FIELDS, gone)
    after = files()
    segment = lambda f: int(f.split("segment=")[1].split("/")[0])
    assert {f for f in before if segment(f) not in touched} == {f for f in after if segment(f) not in touched and segment(f) <= most}
    assert not {f for f in before if segment(f) in touched} & set(after) and len(touched) < most == max(map(segment, before)) < max(map(segment, after))
    now = df.join(gone, "entity_id", "left_anti").join(changed.select("entity_id"), "entity_id", "left_anti").unionByName(changed).cache()
    again = postings.opened(spark, path)
    for query in ("rare", "wait box", "-box", "box or rare", "retry policy"):
        assert [(r.entity_id, r.score) for r in postings.keyword_topk(again, query, 8).collect()] == plain(now, query, 8)
    # all of a segment's entities gone: its folders stay empty
    postings.update(again, now.limit(0), FIELDS, now.select("entity_id"))
    assert postings.keyword_topk(again, "wait or -wait", 5).collect() == []


def test_an_empty_table(spark):
    index = postings.build(entities(spark, 3).where("entity_id > 99"), FIELDS, f"{shared_dir(spark)}/index")
    assert postings.keyword_topk(index, "wait or -box", 5).collect() == []
    assert postings.keyword_batch(index, spark.createDataFrame([(1, "wait")], "query_id long, query string"), 5).collect() == []


#: Words with their stems, as the algorithm's description lists them.
STEMS = """
consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolations consol consolatory consolatori console consol consolidating consolid
consolingly consol consols consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knavish knavish
kneaded knead kneeling kneel knif knif knightly knight knitted knit knives knive knocker knocker knopp knopp generates generat generically generic communism communism arsenal arsenal ties tie
cries cri gas gas gaps gap kiwis kiwi hopping hop hoping hope luxuriated luxuri by by say say relational relat conditional condit adoption adopt skies sky inning inning agreed agre feed feed
dying die news news singly singl youth youth boyish boyish
""".split()


def test_english_stems():
    assert [english.stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert [english.stem(w) for w in ("", "a", "ab", "yyy", "s", "ss", "eed", "x1", "12345")] == ["", "a", "ab", "yyy", "s", "ss", "eed", "x1", "12345"]


def test_an_index_of_english_stems(spark, sf_dir):
    """The same as plain Python over all documents: cover density by hand."""
    from tessera.plans import registry

    words = T.STEMMERS["english"](registry.SEARCH_WORDS.split()[0]), T.STEMMERS["english"](registry.SEARCH_WORDS.split()[1])
    want = []
    for r in registry.keyword_docs(spark, sf_dir).collect():
        tokens = [(w, "A") for w in T.re.findall("[a-z0-9]+", (r.source or "").lower())] + [(w, "D") for w in T.re.findall("[a-z0-9]+", (r.text or "").lower())]
        places = [(i, english.stem(w), T.WEIGHTS[x]) for i, (w, x) in enumerate(tokens) if w not in T.STOP]
        if {w for _, w, _ in places} >= set(words):
            want.append((r.entity_id, T.cover_density(places, set(words))))
    want = sorted(want, key=lambda x: (-round(x[1], 9), x[0]))[: R.DEPTH]
    got = registry.QUERIES["keyword_english"](spark, sf_dir).collect()
    assert [(r.entity_id, r.score) for r in got] == [(i, pytest.approx(s, abs=1e-8)) for i, s in want] and want
    df = spark.createDataFrame([(1, "", "the generators waited"), (2, "", "generic waits")], "entity_id long, name string, text string")
    index = postings.build(df, FIELDS, f"{shared_dir(spark)}/index", stemmer="english")
    assert [r.entity_id for r in postings.keyword_topk(postings.opened(spark, index.path), "waiting generate", 5).collect()] == [1]
    asked = spark.createDataFrame([(1, '"generator wait"'), (2, "wait -generation")], "query_id long, query string")
    assert {(r.query_id, r.entity_id) for r in postings.keyword_batch(index, asked, 5).collect()} == {(1, 1), (2, 2)}


# --- vectors -----------------------------------------------------------------------------------


def brute(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = []
        for e, b, label in vectors:
            ok = a is not None and b is not None and len(a) == len(b) and None not in a and None not in b
            na, nb = (math.sqrt(sum(x * x for x in v)) if ok else 0 for v in (a, b))
            scored.append((round(sum(x * y for x, y in zip(a, b)) / (na * nb), 6) if na and nb else None, e, label))
        scored.sort(key=lambda s: (s[0] is None, -(s[0] or 0), s[1]))
        out += [(q, e, s, label) for s, e, label in scored[:k]]
    return out


VECTOR = "entity_id long, embedding array<double>, label string"


def clustered(n, seed=3):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    return [(i, [r.gauss(m, 0.05) for m in middles[i % 8]], f"l{i}") for i in range(n)]


@pytest.mark.parametrize("sizes", [(1, 1000, 1000), (8, 20, 7), (40, 9, 3)])
def test_blocks_like_brute_force(spark, sizes):
    """Clustered vectors, with ties, and some that can't be compared."""
    pivots, block_rows, part_rows = sizes
    rows = clustered(200) + [(1000 + i, clustered(3)[0][1], "tie") for i in range(6)]
    rows += [(2000, None, "n"), (2001, [], "e"), (2002, [0.0] * 6, "z"), (2003, [1.0, 2.0], "w"), (2004, [None] + [1.0] * 5, "h"), (2005, [1.0, 2.0], "w")]
    asked = [(i, v) for i, v, _ in rows if i % 10 == 0 or i >= 2000]
    got = nearest.topk_batch(spark.createDataFrame(rows, VECTOR), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, pivots, block_rows, part_rows)
    want = {(q, e, s, label) for q, e, s, label in brute(rows, asked, 5)}
    assert {(r.query_id, r.entity_id, r.score, r.label) for r in got.collect()} == want
    assert got.count() == len(want)


def test_more_than_there_are(spark):
    rows = clustered(7)
    asked = [(1, rows[0][1])]
    df, qs = spark.createDataFrame(rows, VECTOR), spark.createDataFrame(asked, "query_id long, embedding array<double>")
    assert {(r.query_id, r.entity_id) for r in nearest.topk_batch(df, qs, 30, 3, 2).collect()} == {(1, i) for i in range(7)}
    for some, others in ((df.limit(0), qs), (df, qs.limit(0))):
        assert nearest.topk_batch(some, others, 3).collect() == []
    with pytest.raises(ValueError):
        nearest.topk_batch(df, qs, -1)


def test_blocks_are_skipped(spark, monkeypatch):
    """With tight clusters a query meets few blocks, and the plan has as many scans for any number of queries."""
    rows, plans = clustered(400), []
    df = spark.createDataFrame(rows, VECTOR)
    for n in (5, 200):
        qs = spark.createDataFrame([(i, v) for i, v, _ in rows[:n]], "query_id long, embedding array<double>")
        out = nearest.topk_batch(df, qs, 3, 24, 50)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        plans.append((plan.count("Relation"), plan.count("MapInArrow"), plan.count("FlatMapCoGroupsInArrow")))
    assert plans[0] == plans[1]
    known = nearest.pivots_of(df, 24)
    lines = nearest.in_blocks(df, known, 50).groupBy("__block", "__pivot").agg(F.min("__cosine").alias("radius")).collect()
    known.block, known.pivot, known.radius = (__import__("numpy").array([r[c] for r in lines]) for c in ("__block", "__pivot", "radius"))
    bound = known.bounds(df.select("embedding").toArrow().column(0))
    assert (bound + nearest.SLACK >= 0.95).mean() < 0.5


def test_index_of_the_lexemes_asked(spark):
    """An index of a query's lexemes answers it as the whole index does, holds no other postings, and refuses other queries."""
    df = entities(spark, 5)
    whole = postings.build(df, FIELDS, f"{shared_dir(spark)}/index", buckets=4)
    for query in ("wait box", "wait or box", "wait -box", '"wait box"', "wait or -box"):
        part = postings.build(df, FIELDS, f"{shared_dir(spark)}/index", buckets=4, only=postings.lexemes_of(query))
        assert {r.lexeme for r in part.read("postings").collect()} - {None} <= {"wait", "box"}
        for index in (part, postings.opened(spark, part.path)):
            assert postings.keyword_topk(index, query, 8).collect() == postings.keyword_topk(whole, query, 8).collect()
    with pytest.raises(ValueError):
        postings.keyword_topk(part, "other", 8)


def test_one_query_builds_no_whole_index(spark, sf_dir):
    """keyword_rank and its like write the postings of their own lexemes alone."""
    before = dict(registry.INDEXES)
    registry.INDEXES.clear()
    try:
        registry.QUERIES["keyword_or"](spark, sf_dir)
        (index,) = registry.INDEXES.values()
        assert {r.lexeme for r in index.read("postings").collect()} - {None} <= {"attion", "anea"}
    finally:
        registry.INDEXES.clear()
        registry.INDEXES.update(before)


def test_long_texts_are_turned_into_postings_in_small_parts():
    """The bytes that a task turns into postings at once are bounded, not only the rows."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["a b " * 250_000] * 40)], names=["entity_id", "fD"])
    parts = [p.num_rows for p in postings._parts(batch)]
    assert sum(parts) == 40 and max(parts) <= 4


def test_batch_ranks_as_one_query_does(spark):
    """Covers counted for many rows at once are those of keyword_topk(), also for three terms, phrases, negated words and other alternatives."""
    df = entities(spark, 60)
    index = postings.build(df, FIELDS, f"{shared_dir(spark)}/index", buckets=4)
    asked = ["wait", "wait box", "retry policy box", '"wait box" retry', "box or rare policy", "wait -box"]
    got = postings.keyword_batch(index, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), 9).orderBy("query_id", F.desc("score"), "entity_id").collect()
    for i, query in enumerate(asked):
        assert [(r.entity_id, r.score) for r in got if r.query_id == i] == [tuple(r) for r in postings.keyword_topk(index, query, 9).collect()]


def test_batch_builds_the_lexemes_asked(spark, sf_dir):
    """keyword_topk_batch writes the postings of its queries' lexemes; where more are asked than may be sent to tasks, of all."""
    before = dict(registry.INDEXES)
    registry.INDEXES.clear()
    try:
        asked = registry.own_queries(spark, sf_dir)
        part = registry.batch_index(spark, sf_dir, asked)
        lexemes = {w for r in asked.collect() for w in postings.lexemes_of(r.query)}
        assert part.only == lexemes and {r.lexeme for r in part.read("postings").collect()} - {None} == lexemes
        assert registry.batch_index(spark, sf_dir, asked, most=1).only is None
    finally:
        registry.INDEXES.clear()
        registry.INDEXES.update(before)
