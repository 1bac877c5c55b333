"""Sharding, centroid clustering and fill-in-middle against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import views
from pyspark.sql import functions as F

from tessera.llm import clustering, fim, pii, sharding
from tessera.llm.common import shared_dir

SCHEMA = "doc_id long, text string, label string, shard int, slot string, n int"


def documents(spark, rows):
    """With columns named like those that operators make."""
    return spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "é" * 70_000), (None, "no id"), (None, "no id"), (4, "one\ntwo\n\n"), (4, "one\ntwo\n\n"), (4, "another"), (5, "\n"), (6, "tail"), (7, "a <P> b\nc")]


# --- sharding ----------------------------------------------------------------------------------


def check_shards(got, rows, n):
    """Every row once, sizes and checksums right, places gapless in each shard."""
    data = [(d, (t or "").encode()) for d, t in rows]
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((d, len(b) + 8, zlib.crc32(b)) for d, b in data)
    places = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < n and r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return [sum(r.size for r in got if r.shard == s) for s in range(n)]


def test_shards_of_odd_rows(spark):
    check_shards(sharding.shards(documents(spark, ODD), 24).collect(), ODD, 24)
    assert sharding.shards(documents(spark, ODD).where("doc_id > 99")).collect() == []


def test_shards_of_the_table(spark, sf_dir):
    rows = views(sf_dir).sql("select doc_id, text from documents").fetchall()
    got = sharding.op11_sharding(spark, sf_dir).collect()
    loads = check_shards(got, rows, 24)
    largest = collections.Counter()
    for r in got:
        largest[r.virtual_slot] += r.size
    assert max(loads) - min(loads) <= max(largest.values())  # the emptiest shard gets the next slot
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in sharding.op11_sharding(spark, sf_dir).collect()}


def test_a_hot_key_is_split(spark):
    """One id, and no id, with a third of all rows each: shards are near equal all the same."""
    r = random.Random(1)
    rows = [(7, "the same text") for _ in range(4000)] + [(None, "x" * r.randint(0, 90)) for _ in range(4000)] + [(i, "y" * r.randint(0, 90)) for i in range(100, 4100)]
    loads = check_shards(sharding.shards(documents(spark, rows).repartition(5), 8, slots=256).collect(), rows, 8)
    assert max(loads) <= 1.02 * sum(loads) / 8


def test_map_like_brute_force(spark):
    """A row's shard is what a plain greedy deal of its slot's bytes gives."""
    rows = [(i, "z" * (i * i % 211)) for i in range(3000)]
    got = sharding.shards(documents(spark, rows), 6, slots=512).collect()
    slots = collections.Counter()
    for r in got:
        slots[r.virtual_slot] += r.size
    load, want = [0] * 6, {}
    assert max(slots.values()) <= 4 * sum(slots.values()) / 512  # no slot is split
    for slot, size in sorted(slots.items(), key=lambda x: (-x[1], x[0])):
        want[slot] = load.index(min(load))
        load[want[slot]] += size
    assert {r.virtual_slot: r.shard for r in got} == want


def test_versions_of_a_map(spark):
    """One shard more takes slots only into itself; older versions stay readable; drift moves few slots."""
    rows = [(i, "z" * (i * i % 211)) for i in range(4000)]
    path = shared_dir(spark)
    docs = documents(spark, rows)
    stats = sharding.slot_stats(sharding.keyed(docs, 512), 512)
    first = sharding.write_map(spark, sharding.dealt(stats, 6), stats, path, 1)
    before = {(r.virtual_slot, r.part): r.shard for r in first.collect()}
    grown = sharding.shards(docs, 7, 512, path).collect()
    loads = check_shards(grown, rows, 7)
    assert {r.version for r in grown} == {2} and max(loads) < 1.05 * sum(loads) / 7
    moved = {r.virtual_slot for r in grown if r.shard != before[r.virtual_slot, 0]}
    assert moved and {r.shard for r in grown if r.virtual_slot in moved} == {6}
    assert {(r.virtual_slot, r.part): r.shard for r in sharding.read_map(spark, path, 1).collect()} == before
    more = docs.union(documents(spark, [(i, "w" * 200) for i in range(4000, 4400)]))
    again = {r.virtual_slot: r.shard for r in sharding.shards(more, 7, 512, path).collect()}
    assert sum(again[r.virtual_slot] != r.shard for r in grown) < 0.2 * len(grown)
    assert sharding.read_map(spark, path).first().version == 3
    with pytest.raises(ValueError):
        sharding.dealt(stats, 0)


# --- clustering --------------------------------------------------------------------------------


def brute_clusters(rows, k=16, rounds=3):
    """{vec_id: (cluster, distance, cluster inertia, inertia, digest)} in plain integers."""
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for (_, v), c in zip(kept, assign()):
            members[c].append(v)
        cents = [tuple(sum(x) // len(members[c]) for x in zip(*members[c])) if members[c] else cents[c] for c in range(len(cents))]
    last = assign()
    own = collections.Counter()
    for (_, v), c in zip(kept, last):
        own[c] += far(v, cents[c])
    return {i: (c, far(v, cents[c]), own[c], sum(own.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (i, v), c in zip(kept, last)}


def clusters_of(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clustering.clusters(df).collect()}


def test_clusters_with_ties(spark):
    """Few different values, so that centroids are equal and distances tie; and rows that aren't kept."""
    r = random.Random(3)
    rows = [(i, [r.choice((-1.0, 0.0, 1.0, 0.5)) if j < 3 else 0.0 for j in range(64)]) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [math.nan] + [1.0] * 63), (1006, [math.inf] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)
    few = rows[:5]
    assert clusters_of(spark, few) == brute_clusters(few)
    assert clusters_of(spark, rows[300:]) == {}


def test_clusters_of_wide_values(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(i % 7, 1 + i % 3) for _ in range(64)]) for i in range(200)]
    assert clusters_of(spark, rows) == brute_clusters(rows)
    df = spark.createDataFrame([(1, [1e300] * 64), (1, [1e300] * 64), (None, [-1e300] * 64)], "vec_id long, embedding array<double>")
    got = clustering.clusters(df).collect()  # repeated ids and none; beyond the limit as the limit
    assert len(got) == 3 and {r.vec_id for r in got} == {1, None} and all(r.distance == 0 for r in got)
    assert clustering.clusters(df.where("vec_id > 9")).collect() == []


def test_annulus_is_exact_and_prunes():
    r = np.random.default_rng(5)
    centroids = r.integers(-50, 50, (64, 8)) * (1 + np.arange(64)[:, None])
    x = centroids[r.integers(0, 64, 4000)] + r.integers(-30, 30, (4000, 8))
    number, best, compared = clustering.nearest(x, centroids)
    every = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (best == every.min(1)).all()
    assert compared.mean() < 32
    # two centroids at the two ends of an annulus, equally far
    number, best, _ = clustering.nearest(np.array([[3, 0]]), np.array([[5, 0], [1, 0], [9, 9]]))
    assert (number[0], best[0]) == (0, 4)
    number, _, _ = clustering.nearest(np.array([[3, 0]]), np.array([[1, 0], [5, 0]]))
    assert number[0] == 0
    assert clustering.nearest(np.array([[3, 0]]), np.array([[1, 0]]))[0][0] == 0


# --- fill-in-middle ----------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


PIECES = ["a", "é", "日", "😀", "\n", "\n\n", "<", "P", ">", "S>", "<M", "\r", "word ", "\x00"]


@pytest.mark.parametrize("chunk", [1, 3, 16, fim.CHUNK])
def test_fill_in_middle(spark, chunk):
    """Whole texts and chunks of any size give the same; marks and code points may lie across chunks."""
    r = random.Random(6)
    rows = ODD if chunk > 16 else [(i, t[:40] if t else t) for i, t in ODD]
    rows = rows + [(100 + i, "".join(r.choice(PIECES) for _ in range(r.randint(0, 30)))) for i in range(300)]
    made = fim.fill_in_middle(documents(spark, rows), chunk=chunk)
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = collections.Counter((d, *brute_fim(d, t), t or "") for d, t in rows)
    assert collections.Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output, x.again) for x in got) == want
    assert len({x.form for x in got}) == 3
    assert fim.fill_in_middle(documents(spark, rows).where("doc_id > 9999"), chunk=chunk).collect() == []


def test_giant_documents(spark):
    """Texts of many chunks, of one line and of many, with a mark at the end or none, and copies."""
    long = "".join(f"line {i} {'é' * (i % 50)}\n" for i in range(20_000))
    rows = [(i, long[i:]) for i in range(12)] + [(3, long[3:]), (None, long), (20, "x" * 300_000), (21, long + "<M>"), (22, "\n" * 200_000), (23, long[:-1])]
    got = fim.fill_in_middle(documents(spark, rows)).collect()
    assert collections.Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == collections.Counter((d, *brute_fim(d, t)) for d, t in rows)


def test_automaton_composes():
    """Functions of parts compose to that of the whole, for every entry state."""
    machine, r = fim.automaton(), random.Random(7)
    classes, step, begins = machine
    for _ in range(200):
        data = "".join(r.choice(PIECES) for _ in range(r.randint(0, 40))).encode()
        f, n = fim.scanned(data, machine)
        for state in range(step.shape[1]):
            at, count = state, 0
            for byte in data:
                count += begins[classes[byte], at]
                at = step[classes[byte], at]
            assert (f[state], n[state]) == (at, count)
        cut = sorted(r.randint(0, len(data)) for _ in range(3))
        parts = [fim.scanned(data[i:j], machine) for i, j in zip([0, *cut], [*cut, len(data)])]
        fs, ns = fim.prefixes(np.array([p[0] for p in parts]), np.array([p[1] for p in parts]))
        assert (fs[-1] == f).all() and (ns[-1] == n).all()
    with pytest.raises(ValueError):
        fim.automaton(("a\n",))


# --- personal data -----------------------------------------------------------------------------


def test_bootstrap_goes_on_while_patterns_are_added(spark):
    """Each of nine contexts is confident only once the one before has made two tokens known."""
    rows = []
    for k in range(9):
        tokens = [(f"s{k}.{i}@x", True) for i in range(8)] + [(f"n{k - 1}.{i}", k == 0) for i in range(2)] + [(f"n{k}.{i}", False) for i in range(2)]
        rows += [(t, seed, [f"w\tcontext {k}"]) for t, seed in tokens]
    found = spark.createDataFrame(rows, "token string, seed boolean, patterns array<string>")
    assert {r.pattern for r in pii.bootstrap(found).collect()} == {f"w\tcontext {k}" for k in range(9)}
    assert {r.pattern for r in pii.bootstrap(found, rounds=3).collect()} == {f"w\tcontext {k}" for k in range(3)}
    assert pii.bootstrap(found.where("not seed")).collect() == []


def test_long_runs_of_digits_are_one_instance(spark):
    docs = spark.createDataFrame([(1, "code 11 22 33 44 55 66 77 88 99 10 11 12 end")], "row long, text string").withColumn("base", pii.base_spans(F.col("text")))
    assert [r.token for r in pii.instances(docs).collect()] == ["11 22 33 44 55 66 77 88 99 10 11 12"]


def test_redaction_of_many_spans(spark):
    """Across blocks of spans, at both ends, side by side, and with code points beyond ASCII."""
    r = random.Random(9)
    word = lambda: r.choice(("é", "u%d@x.org" % r.randint(0, 9), "10.0.0.1", "😀 ", " ", ","))
    texts = ["".join(word() for _ in range(r.randint(1, 900))) for _ in range(30)] + ["10.0.0.1u3@x.org", "+1 988 555 2485.1.1.1@x.org", "a@b.co", "a@b.co " * 64, " a@b.co" * 65, "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", pii.base_spans(F.col("text")))
    for x in df.where("size(base) > 0").select("text", "base", pii.redacted(F.col("text"), F.col("base")).alias("out")).collect():
        want, at, groups = "", 0, []
        for start, stop, kind in sorted(((s.start, s.stop, s.kind) for s in x.base), key=lambda s: (s[0], -s[1], s[2])):
            if groups and start < groups[-1][1]:
                groups[-1][1] = max(groups[-1][1], stop)
            else:
                groups.append([start, stop, kind])
        for start, stop, kind in groups:
            want += x.text[at:start] + f"<{list(pii.KINDS)[kind].upper()}>"
            at = stop
        assert x.out == want + x.text[at:]
