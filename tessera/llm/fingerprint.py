"""Operator 8: document fingerprints by one-permutation MinHash, by built-in functions alone.

The hashes of a text's distinct word shingles are dealt into bins by their high bits, and each
bin keeps its least. Sorted, the least of a bin is the first hash with those high bits. An empty
bin borrows from the first filled bin in its own fixed random order of all bins (optimal
densification: the choice depends on the bin alone, not on its neighbours). It tries the first
TRIES bins of that order; only where all are empty it takes the least rank among the filled bins. The fingerprint keeps
the low four bits of each bin, one hex digit; two of them agree by chance once in sixteen bins,
which the likeness corrects.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, word_array, written

SHINGLE, BINS, TRIES = 5, 256, 16
SHIFT = 64 - BINS.bit_length() + 1


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, also where it stands inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """The hash of each run of `size` words; of all words if there are fewer; none without words."""

    def runs(hashed: Column) -> Column:
        run = lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(size)))
        few = F.when(F.size(hashed) > 0, F.array(F.xxhash64(hashed))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hashed) >= size, F.transform(F.sequence(F.lit(0), F.size(hashed) - size), run)).otherwise(few)

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def orders() -> tuple[Column, Column]:
    """For each bin a fixed random order of all bins, itself first, and the rank of each bin in it: constants of BINS times BINS small numbers."""
    every = []
    for b in range(BINS):
        rest = [x for x in range(BINS) if x != b]
        random.Random(b).shuffle(rest)
        every.append([b, *rest])
    ranks = [[0] * BINS for _ in every]
    for b, order in enumerate(every):
        for i, x in enumerate(order):
            ranks[b][x] = i
    return tuple(F.from_json(F.lit(str(x)), "array<array<int>>") for x in (every, ranks))


def bin_digits(hashes: Column) -> Column:
    """An array with the hex digit of each bin's least hash, null where the bin is empty."""
    bin_of = lambda x: (F.shiftright(x, SHIFT) + BINS // 2).cast("int")  # noqa: E731  # rises with the hash, signed as it is

    def firsts(h: Column) -> Column:
        before = F.concat(F.array(F.lit(-1)), F.transform(h, bin_of))
        return F.filter(F.zip_with(h, F.slice(before, 1, F.size(h)), lambda x, b: F.when(bin_of(x) != b, x)), lambda x: x.isNotNull())

    def filled(f: Column) -> Column:
        """Each least hash's digit, after a null for each empty bin between it and the one before."""
        none = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
        before = F.concat(F.array(F.lit(-1)), F.transform(f, bin_of))
        parts = F.zip_with(f, F.slice(before, 1, F.size(f)), lambda x, b: F.concat(none(bin_of(x) - b - 1), F.array(F.lower(F.substring(F.hex(x), -1, 1)))))
        return F.concat(F.flatten(parts), none(BINS - 1 - F.element_at(before, -1)))

    return let(let(F.sort_array(hashes), firsts), filled)


def densified(digits: Column) -> Column:
    """The fingerprint: empty bins filled; empty text where all are."""
    order, rank = orders()

    def fill(d: Column) -> Column:
        held = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(d, b).isNotNull())
        return let(held, lambda held: F.array_join(F.transform(d, lambda x, b: F.coalesce(x, let(F.get(order, b), lambda o: tried(d, o)), least(d, held, b))), ""))

    def tried(d: Column, o: Column) -> Column:
        return F.coalesce(*(F.get(d, F.get(o, F.lit(i))) for i in range(1, TRIES)))

    def least(d: Column, held: Column, b: Column) -> Column:
        ranked = let(F.get(rank, b), lambda r: F.array_min(F.transform(held, lambda k: F.get(r, k) * BINS + k)))
        return F.get(d, ranked % BINS)

    return let(digits, lambda d: F.when(F.exists(d, lambda x: x.isNotNull()), fill(d)).otherwise(""))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: BINS hex digits, or empty for a text without words."""
    return densified(bin_digits(shingle_hashes(word_array(text))))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles from their fingerprints, between 0 and 1.

    1 for two empty fingerprints, 0 for an empty one and another.
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / BINS
    corrected = F.greatest(F.lit(0.0), (same - 1 / 16) / (1 - 1 / 16))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).when(a == b, 1.0).otherwise(corrected)


def in_order(docs: DataFrame, rows_a_part: int = 1000, ranges: int = 256) -> DataFrame:
    """Adds part, and a copy of each part's first row (flag copy) to the part before it; the order is descending doc_id.

    Rows of one id are ordered by text, null ids come last, in a part of their own. Ids are dealt
    into ranges between quantiles, and each range into parts of equal width, as many as the number
    of rows needs: one has about rows_a_part rows, whatever the size of the table. Only the
    quantiles come to the driver; parts meet their first ids by a join.
    """
    n = docs.count()
    parts = n // rows_a_part + 1
    tops = min(parts, ranges)
    each = -(-parts // tops)
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / tops for i in range(tops + 1)], 0.25 / tops)}, reverse=True)
    # range i goes from below cuts[i] (the first: from it) down to cuts[i + 1]
    top = F.greatest(F.lit(0), F.least(F.lit(max(0, len(cuts) - 2)), F.size(F.filter(F.lit(cuts or [0]), lambda c: F.col("doc_id") < c)) - 1))
    high, low = (F.get(F.lit(x or [0]), F.col("top")).cast("decimal(38,0)") for x in (cuts, cuts[1:] or cuts))
    inner = F.floor((high - F.col("doc_id")) * each / F.greatest(high - low, F.lit(1)))
    numbered = docs.withColumn("top", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(top))
    numbered = numbered.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(each - 1), inner))).cast("int"))
    heads = written(numbered.groupBy("top", "part").agg(F.max("doc_id").alias("head")), "heads")
    ends = heads.groupBy("top").agg(F.max("part").alias("last"))  # at most a row for each range
    every = Window.partitionBy(F.lit(0)).orderBy("top")
    around = Window.partitionBy(F.lit(0)).orderBy(F.desc("top"))
    before = ends.select("top", F.coalesce(F.lag(F.struct("top", "last")).over(every), F.first(F.struct("top", "last")).over(around)).alias("before"))
    above = F.coalesce(F.lag("part").over(Window.partitionBy("top").orderBy("part")), F.lit(-1))
    placed = heads.withColumn("above", above).join(F.broadcast(before), "top")
    to = placed.select("top", "part", "head", F.when(F.col("above") >= 0, F.struct("top", F.col("above").alias("part"))).otherwise(F.struct(F.col("before.top").alias("top"), F.col("before.last").alias("part"))).alias("to"))
    few = F.broadcast(to) if n // rows_a_part <= 100_000 else to
    own, copy = F.struct("top", "part", F.lit(False).alias("copy")), F.struct("to.top", "to.part", F.lit(True).alias("copy"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))
    return numbered.join(few, ["top", "part"]).withColumn("place", F.explode(places)).drop("top", "part", "head", "to").select("*", "place.*").drop("place")


def fingerprints(docs: DataFrame, rows_a_part: int = 1000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next for each row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next row in descending doc_id, the first row after the last. Ties of doc_id are
    ordered by text; a null id comes last; a single row follows itself. A null text is empty: its
    fingerprint is empty, and like another empty one only. Equal texts have equal fingerprints.
    Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    placed = in_order(base, rows_a_part).withColumn("fingerprint", fingerprint(F.col("text")))
    follow = Window.partitionBy("top", "part").orderBy("copy", F.desc("doc_id"), "text")
    nexts = placed.select("*", F.lead("text").over(follow).alias("next_text"), F.lead("fingerprint").over(follow).alias("next_fingerprint")).where(~F.col("copy"))
    n = F.length("text")
    edited = nexts.withColumn("edited", F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))")))
    done = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return done.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprints() of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_fingerprints": op8_fingerprints}
