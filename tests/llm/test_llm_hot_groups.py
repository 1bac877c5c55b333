"""The Jaccard join in groups of many blocks: the same components as pair by pair, and members that move once."""

import random

import numpy as np
from brute import components
from pyspark.sql import functions as F
from tessera.llm import ngram_join


def merged(pairs, known):
    """The classes of items that equal known values and pairs connect."""
    root = list(known)
    for a, b in pairs:
        old, new = root[a], root[b]
        root = [new if r == old else r for r in root]
    return {frozenset(i for i in range(len(root)) if root[i] == r) for r in root}


def test_meet_joins_what_pairs_of_asking_items_join():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 14)
        known, asks = [r.randint(0, 6) for _ in range(n)], [r.random() < 0.5 for _ in range(n)]
        links = {(i, j) for i in range(n) for j in range(i) if r.random() < 0.15}
        links |= {(j, i) for i, j in links}
        found = ngram_join.meet(np.array(known), np.array(asks), lambda x, items: np.array([(x, int(i)) in links for i in items], bool))
        assert set(found) <= links and len(found) < max(2, len(set(known)))
        assert merged(found, known) == merged([(i, j) for i, j in links if asks[i] or asks[j]], known)


def members(spark, n, blocks):
    each = F.lit(n).cast("long").alias("m"), F.lit(blocks).cast("long").alias("blocks"), F.lit(blocks / n).alias("weight")
    return spark.range(n).select(F.lit(7).cast("long").alias("key"), "id", *each)


def test_members_of_a_connected_group_move_once(spark):
    n, blocks = 20_000, 200
    group = members(spark, n, blocks)
    first = ngram_join.first_units(group)
    moved = first.select("id", F.explode("units").alias("unit"))
    assert n <= moved.count() <= n + 3 * ngram_join.EVERYWHERE * blocks
    assert moved.groupBy("unit").count().agg(F.max("count")).first()[0] < 3 * n / blocks
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert ngram_join.second_units(group, star)[0].isEmpty()


def test_each_member_apart_meets_all_others(spark):
    """30 of 2,000 members are not connected with the rest: each shares a unit with every other member, the rest moves once."""
    n = 2000
    star = spark.range(1, n - 30).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    rows = ngram_join.second_units(members(spark, n, 20), star)[0].collect()
    units = {r.id: set(r.units) for r in rows}
    assert len(units) == n and {r.id for r in rows if r.asks} == set(range(n - 30, n))
    assert all(units[a] & units[b] for a in range(n - 30, n) for b in range(n))
    assert all(len(units[i]) == 1 for i in range(n - 30))


def test_nothing_connected_meets_pair_by_pair(spark):
    none = spark.createDataFrame([], "a long, b long")
    rows = ngram_join.second_units(members(spark, 60, 6), none)[0].collect()
    units = {r.id: set(r.units) for r in rows}
    assert len(units) == 60 and sum(r.asks for r in rows) == 59
    assert all(units[a] & units[b] for a in units for b in units if a != b)


def test_chains_and_bridges_over_blocks(spark, monkeypatch):
    """Texts that drift word by word, so that links are chains over many blocks, beside two groups that one text joins."""
    for name, most in (("candidate_clusters", {"most_sets": 9, "rows_a_bucket": 60}), ("links_in_clusters", {"most_sets": 6})):
        f = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, f=f, most=most: f(*a, **most))
    r, rows = random.Random(3), []
    w = [f"a{i}" for i in range(60)]
    for i in range(40):
        rows.append((r.randrange(10**6), " ".join(w)))
        w = [*w[2:], f"n{i}", f"m{i}"]
    base = [f"b{i}" for i in range(60)]
    other = [*base[:-8], *(f"c{i}" for i in range(8))]
    bridge = [*base[:-4], *(f"c{i}" for i in range(4, 8))]
    for i in range(25):
        for words in (base, other):
            rows.append((r.randrange(10**6), " ".join([f"x{i % 3}", *words])))
    rows.append((r.randrange(10**6), " ".join(bridge)))
    got = {tuple(x) for x in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == components(rows, 5, 80)
