"""Joins of labels, terms and seeded orders against nested loops."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.operators import evaluation as V
from tessera.operators import latency as L


def test_labels_by_suffixes(spark):
    r = random.Random(2)
    segments = ["app", "core", "s.py", "as.py", "py", "", "é", "x/y"]
    path = lambda: "/".join(r.choices(segments, k=r.randint(0, 4)))
    catalogue = [(i, path(), r.choice(("main", "main", "go", None))) for i in range(150)]
    labels = [(i, f"{path()}::{r.choice(('main', 'go', 'no'))}") for i in range(60)] + [(61, "main"), (62, "::go"), (1, "s.py::main"), (1, "s.py::main")]
    got = V.label_match(spark.createDataFrame(labels, "query_id long, label string"), spark.createDataFrame(catalogue, "entity_id long, file_path string, qualname string"))
    want = []
    for q, label in labels:
        at, _, name = label.rpartition("::")
        want += [(q, label, e) for e, p, n in catalogue if n == name and (p.endswith(at) or at.endswith(p))]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 100


def test_a_name_that_all_share_compares_no_pairs(spark):
    """Paths of a shared name meet by equality: the join makes no more rows than match, but for cut suffixes."""
    catalogue = spark.range(2000).select(F.col("id").alias("entity_id"), F.concat(F.lit("pkg/m"), "id", F.lit(".py")).alias("file_path"), F.lit("main").alias("qualname"))
    labels = spark.range(2000).select(F.col("id").alias("query_id"), F.concat(F.lit("root/pkg/m"), "id", F.lit(".py::main")).alias("label"))
    out = V.label_match(labels, catalogue)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "EndsWith" not in plan and out.count() == 2000


def test_terms_in_texts(spark):
    r = random.Random(3)
    letters = "abcé. "
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(200)] + [None, "", "aaaa"]
    terms = ["".join(r.choices("abcé.", k=r.randint(4, 7))) for _ in range(300)] + ["aaaa", "abcab" * 30]
    got = V.terms_within(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {x.term for x in got.collect()} == {t for t in terms if any(t in x for x in texts if x)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_order_over_many_ranges(spark):
    pool = [f"q{i}" for i in range(500)]
    want = sorted(pool, key=lambda q: (hashlib.sha256(f"5:{q}".encode()).hexdigest(), q))
    df = spark.createDataFrame([(q,) for q in pool], "query string")
    for rows in (1, 10_000):
        out = L.query_order(df, 1200, 5, rows)
        got = sorted((x["nth"], x["query"]) for x in out.collect())
        assert got == [(i, want[i % 500]) for i in range(1200)]
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert L.query_order(df.limit(0), 5, 1).collect() == []
