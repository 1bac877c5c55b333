"""Rules that learn from all labelled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality


def test_rules_learn_from_all_rows(spark):
    """The forest's paths and threshold count every clean row of the learning fold, also beyond 20,000."""
    n = 27_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab cd "), 1), F.concat_ws(" ", F.sequence(F.col("id"), F.col("id") + 9 + F.pmod(F.xxhash64("id"), F.lit(7)))), F.repeat(F.lit("#"), F.pmod(F.hash("id"), F.lit(90)))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    forest = quality.fit_rules(docs, labels)
    learning = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = quality.counts_of([r.text for r in learning.collect()])
    x = quality.rule_matrix(counts[~quality.base_failed(counts)])
    assert len(x) > 20_000 and forest.scale == pytest.approx(quality.usual_depth(len(x)))
    score = np.sort(forest.score(x))
    assert forest.threshold == score[int(np.ceil(len(x) * 0.998))]
    at = forest.nodes(x)
    for t in range(3):
        leaves, held = np.unique(at[:, t], return_counts=True)
        level = np.floor(np.log2(leaves + 1))
        assert forest.path[t, leaves] == pytest.approx(level + quality.usual_depth(held))


@pytest.mark.parametrize("few", [2, 7, 4096])
def test_nth_largest(spark, few):
    values = np.round(np.random.default_rng(3).random(500), 2)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for n in (1, 2, 40, 499, 500):
        assert quality.nth_largest(df, "v", n, few) == np.sort(values)[-n]
