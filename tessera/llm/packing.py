"""Operator 10: documents packed into sequences of a fixed length by cutting-stock column generation.

Every document's ids are cut into pieces of the full length and a rest. How many pieces there are
of each length class (lengths rounded up to a few tokens, so at most length / grain numbers,
counted over all pieces) is the demand of a cutting-stock problem. Its linear program starts with
one class a pattern; its dual prices go to a knapsack, whose dynamic program finds the pattern of
greatest value, until no pattern is worth more than the sequence it fills. The patterns' numbers
are rounded down and the rest is filled greedily. Pieces are then ranked within their class, and
a rank falls into one slot of one copy of one pattern.
"""

from __future__ import annotations

import re
import string
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import each_batch, table, text_of, written

LENGTH, GRAIN, END_ID = 2048, 8, 1

#: A space before white space or the end of a text; one before anything else, and cuts there.
run_of_space, next_piece, split = re.compile(r" (?!\S)").search, re.compile(r" (?=\S)").search, re.compile(r" (?=\S)").split


def id_bytes(ids, merges, added, pattern: str = public_tokenizers.PATTERN, most_known: int = 300_000, most_chars: int = 4 << 20):
    """A function from texts to the ids of each as little-endian 32-bit numbers.

    The pattern must take a space and the letters or marks after it as one pre-token, and ASCII marks
    between letters and a space as one too. Texts are cut at spaces before anything but white space.
    Each different piece of a call is encoded once, all that are not yet known together. When more
    than most_known pieces are known, those met in two calls stay. Texts of more than most_chars are
    encoded in parts.
    """
    import regex

    find, merge = regex.compile(pattern).findall, bpe.BatchMerger(ids, merges)
    number = {text: i.to_bytes(4, "little") for text, i in added.items()}
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
    known: dict[str, bytes] = {}

    def pre_tokens(piece: str):
        letters = piece.rstrip(string.punctuation)
        if not letters.isalpha():
            return find(" " + piece)
        return (" " + piece,) if len(letters) == len(piece) else (" " + letters, piece[len(letters) :])

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal known
        heads, rests = [], []
        for text in texts:
            head, *rest = split(text) if run_of_space(text) else text.split(" ")
            heads.append(find(head))
            rests.append(rest)
        met = set().union(*rests)
        tokens = {p: pre_tokens(p) for p in met if p not in known}
        every = list({*chain.from_iterable(tokens.values()), *chain.from_iterable(heads)})
        made = dict(zip(every, merge([t.encode() for t in every]))).__getitem__
        known.update((p, made(t[0]) if len(t) == 1 else b"".join(map(made, t))) for p, t in tokens.items())
        out = [b"".join((*map(made, head), *map(known.__getitem__, rest))) for head, rest in zip(heads, rests)]
        if len(known) > most_known:
            known = {p: known[p] for p in met if p not in tokens and len(p) <= 64}
        else:
            for p in tokens:
                if len(p) > 64:
                    del known[p]
        return out

    def in_parts(text: str):
        at = 0
        while len(text) - at > most_chars and (space := next_piece(text, at + most_chars)):
            yield text[at : space.start()]
            at = space.start()
        yield text[at:]

    def all_ids(texts: list[str]) -> list[bytes]:
        parts = [cut(t) if any(a in t for a in added) else [t] for t in texts]
        made = iter(encode([p for of_text in parts for p in of_text[::2] if len(p) <= most_chars]))
        one = lambda p: next(made) if len(p) <= most_chars else b"".join(encode([x])[0] for x in in_parts(p))
        return [b"".join(number[p] if i % 2 else one(p) for i, p in enumerate(of_text)) for of_text in parts]

    return all_ids


def pieces(docs: DataFrame, json_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens, and row, the document's row."""

    def make(ids, merges, added):
        encode, end = id_bytes(ids, merges, added), end_id.to_bytes(4, "little")

        def run(doc_ids, rows, texts):
            out = ([], [], [], [], [], [])
            for doc_id, row, raw in zip(doc_ids, rows, encode(texts)):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, length):
                    part = raw[4 * at : 4 * (at + length)]
                    for column, x in zip(out, (doc_id, row, at, len(part) // 4, zlib.crc32(part), n)):
                        column.append(x)
            return out

        return run

    ids, merges, added = bpe.read_json(json_path)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return each_batch(rows, make, f"doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long", ids=ids, merges=merges, added=added)


def best_pattern(value: np.ndarray, sizes: np.ndarray, limit: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: at most limit[i] items of sizes[i] within room, by dynamic programming.

    Bounded numbers become items of 1, 2, 4 ... pieces.
    """
    best, choice = np.zeros(room + 1), []
    for i in np.flatnonzero(value > 1e-12):
        left, step = int(min(limit[i], room // sizes[i])), 1
        while left > 0:
            take = min(step, left)
            weight = take * int(sizes[i])
            gain = best[: room + 1 - weight] + take * value[i]
            better = gain > best[weight:] + 1e-12
            choice.append((i, take, weight, better))
            best = np.concatenate([best[:weight], np.where(better, gain, best[weight:])])
            left, step = left - take, 2 * step
    out, at = np.zeros(len(sizes), int), room
    for i, take, weight, better in reversed(choice):
        if at >= weight and better[at - weight]:
            out[i] += take
            at -= weight
    return float(best[room]), out


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchange; the matrix is small, so no threaded library is called."""
    n = len(a)
    work = np.concatenate([a.astype(float), np.eye(n)], axis=1)
    for c in range(n):
        r = c + int(np.abs(work[c:, c]).argmax())
        if r != c:
            work[[c, r]] = work[[r, c]]
        work[c] /= work[c, c]
        rest = work[:, c].copy()
        rest[c] = 0
        rows = np.flatnonzero(rest)
        work[rows] -= rest[rows, None] * work[c]
    return work[:, n:]


def times_vector(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (a * v).sum(axis=1)


def first_basis(sizes: np.ndarray, need: np.ndarray, room: int) -> np.ndarray:
    """A pattern for each class, used until that class runs out: the columns of a basis that is feasible.

    Patterns are filled with the classes that still have pieces, large ones first in line. A
    pattern has none of the classes that ran out before it, so the basis can be inverted.
    """
    basis, left, worth = np.zeros((len(need), len(need))), need.copy(), (sizes / room) ** 1.05
    for t in range(len(need)):
        open_ = left > 1e-9 * need
        if not open_.any():
            break
        pattern = best_pattern(np.where(open_, worth, 0), sizes, np.where(open_, np.maximum(left, 1), 0).astype(int), room)[1]
        spent = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        c = int(spent.argmin())
        left = left - spent[c] * pattern
        left[c] = 0
        basis[:, c] = pattern
    for c in np.flatnonzero(~basis.any(axis=0)):
        basis[c, c] = max(1, room // sizes[c])
    return basis


def solve(demand: np.ndarray, room: int, rounds: int = 400, gap: float = 5e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns over classes 1 .. len(demand) (class i fills i units of room) and how often each is used.

    The basis of the linear program has as many patterns as classes in use. Each round prices one
    pattern in. They end when none improves, or when the bound on the optimum that the best
    pattern's value gives (the number used so far / value) is within `gap`.
    """
    used = np.flatnonzero(demand > 0)
    if not len(used):
        return []
    sizes, need = used + 1, demand[used].astype(float)
    m = len(used)
    basis = first_basis(sizes, need, room)
    inverse = inverted(basis)
    x = np.maximum(times_vector(inverse, need), 0)
    for step in range(rounds):
        value, pattern = best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, need.astype(int), room)
        if value <= 1 + 1e-9 or 1 - 1 / value <= gap:
            break
        enter = times_vector(inverse, pattern)
        able = enter > 1e-7
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, enter, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * enter, 0)
        x[out] = ratio[out]
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = inverted(basis)
            x = np.maximum(times_vector(inverse, need), 0)
        else:
            pivot = inverse[out] / enter[out]
            inverse = inverse - np.outer(enter, pivot)
            inverse[out] = pivot
    plan, left = [], demand[used].astype(int).copy()
    for column, times in zip(basis.T.round().astype(int), x):
        # rounded down, and not beyond what is left to place
        held = column > 0
        times = min(int(times + 1e-6), *(left[held] // column[held])) if held.any() else 0
        if times > 0:
            plan.append((column, times))
            left -= times * column
    while left.any():
        column, free = np.zeros(m, int), room
        for i in range(m - 1, -1, -1):
            column[i] = min(left[i], free // sizes[i])
            free -= column[i] * sizes[i]
        times = int(min(left[column > 0] // column[column > 0]))
        plan.append((column, times))
        left -= times * column
    full = []
    for column, times in plan:
        wide = np.zeros(len(demand), int)
        wide[used] = column
        full.append((wide, times))
    return full


def ranked(parts: DataFrame, rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds rank: the number of each piece among those of its class, from 0.

    Pieces are dealt into buckets by hash, so that a class with most of them is no one task's
    work: a bucket ranks its own, and the counts of the buckets before it are added.
    """
    buckets = max(1, parts.count() // rows_a_bucket)
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    own = Window.partitionBy("class", "bucket").orderBy("row", "start")
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("class", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    local = dealt.withColumn("nth", F.row_number().over(own) - 1)
    return local.join(counts, ["class", "bucket"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "bucket")


def pack(docs: DataFrame, json_path: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece of each row of docs.

    A document's ids are those of its text (null: empty) and end_id; so even an empty document has
    a piece. Equal rows have a piece each. Sequences are no longer than `length` and gapless.
    Only the counts of the classes (at most length / grain) come to the driver, and only the
    patterns' slots (at most a few for each class and pattern of a basis) are broadcast. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = written(pieces(docs, json_path, length, end_id).withColumn("class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    demand = np.zeros(-(-length // grain), np.int64)
    for c, n in parts.groupBy("class").count().collect():
        demand[c - 1] = n
    slots, taken, first = [], np.zeros(len(demand), np.int64), 0
    for pattern, times in solve(demand, len(demand)):
        for i in np.flatnonzero(pattern).tolist():
            slots.append((i + 1, int(taken[i]), int(taken[i] + times * pattern[i]), int(pattern[i]), first))
            taken[i] += times * pattern[i]
        first += times
    places = spark.createDataFrame(slots, "class int, low long, high long, each long, base long")
    within = (F.col("p.class") == F.col("s.class")) & (F.col("p.rank") >= F.col("s.low")) & (F.col("p.rank") < F.col("s.high"))
    placed = ranked(parts).alias("p").join(F.broadcast(places).alias("s"), within)
    numbered = placed.select("p.*", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row", "start").rowsBetween(Window.unboundedPreceding, -1)
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op10_packing": op10_packing}
