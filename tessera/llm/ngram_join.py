"""Operator 6: documents whose word n-grams have a Jaccard similarity of at least `percent` %, by PartEnum signatures.

Sizes fall into bands so wide that a set's similar sets, if larger, lie in its band or the next.
Two similar sets, the smaller of which lies in a band whose largest size is r, differ in at most
k = r (100 - percent) / percent features. A set has signatures for its own band and the one below,
each with the k of that band:

* large k: the domain of features is dealt into k // 2 + 1 + e parts, each of three subparts.
  Similar sets differ in at most one feature in 1 + e parts at least, so there they agree on two
  of the three subparts: the signatures are all the pairs of subparts of all parts.
* small k: one part of n subparts. Similar sets agree on n - k of them: the signatures are all
  pairs of subparts.

What holds no feature of a set is no signature of it, or unrelated sets would share it. That
loses nothing unless a set leaves more than e parts (n - k - 2 subparts) without; such a set also
has the signatures of another, independent partition, and so on (LEVELS times; only a set that
fails them all, one in many thousands, has signatures of what it lacks).

Sets equal as a whole are one class beforehand. Sets that share a signature are candidates. In
each such group a bound is tested first, on parity bitmaps of about a bit for each feature: two
bitmaps differ in no more bits than the sets differ in features. Candidates that pass are joined
to clusters; a cluster's features move once, and only an exact count of common n-grams makes a
link. Groups and clusters are dealt into blocks of bounded size; a task walks a block from set to
set, comparing a set with those not reached yet, and emits no pairs, only as many connections as
it has sets. Of a group of several blocks, a few sets are in all blocks, so that sets like them are
connected over all blocks at once. Only the sets outside the largest connected part of their group
then meet the group's other sets, block by block, and what is known to be connected isn't compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, each_arrow, table, text_of, unused, written

#: Up to this k the signatures are pairs of subparts of one part.
PAIRS_UP_TO = 8
#: Partitions tried for a set whose features leave too many parts empty.
LEVELS = 5
#: Above this number of rows a table is joined by a shuffle, not broadcast (some 40 bytes a row).
BROADCAST_ROWS = 500_000
#: Members of a group of several blocks that are in all of them, on average.
EVERYWHERE = 16
#: Texts that are worked on at once, at most: short ones have many signatures for their bytes.
ROWS = 500

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(33))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (lengths.cumsum() - lengths), lengths)


class WordHasher:
    """64-bit hashes of the words of some texts, A-Z lower-cased, straight from their UTF-8 bytes.

    A word's hash is the sum over its bytes of a random number of the byte times a power of an odd
    multiplier, from running sums; all white space that parts words is ASCII, so bytes suffice.
    """

    def __init__(self, chunk: int = 1 << 20):
        self.chunk, byte = chunk, np.arange(256)
        self.gap = (byte == 32) | ((byte >= 9) & (byte <= 13))
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint64)
        self.number = mixed(lower * C2 + C1)
        self.power = self.inverse = np.zeros(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.power) < n:
            factors = np.full((2, n), C3)
            factors[1] = pow(int(C3), -1, 1 << 64)
            factors[:, 0] = 1
            self.power, self.inverse = np.cumprod(factors, axis=1)
        return self.power[:n], self.inverse[:n]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words' hashes, text after text, and the number of words of each text."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = self.gap[data]
        first, last = ~gap[1:-1] & gap[:-2], ~gap[1:-1] & gap[2:]
        inner = ends[(ends > 0) & (ends < len(data))]  # where a text begins right after another
        first[inner] |= ~gap[1 + inner]
        last[inner - 1] |= ~gap[inner]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        out, at = np.zeros(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(stop, start[at] + self.chunk, "right")))
            low, high = start[at], stop[to - 1]
            power, inverse = self.powers(int(high - low))
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.number[data[low:high]] * power, out=total[1:])
            a, b = start[at:to] - low, stop[at:to] - low
            out[at:to] = mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * C1)
            at = to
        return out, np.diff(np.searchsorted(start, ends))


class Shingler:
    """The sets of some texts' n-grams: sorted distinct 64-bit hashes, one set after the other, and the sets' sizes."""

    def __init__(self, size: int):
        self.size, self.hashes = size, WordHasher()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        size, (h, n) = self.size, self.hashes(texts)
        runs = max(0, len(h) - size + 1)
        out = np.full(runs, size, np.uint64)
        for i in range(size):
            out = mixed(out * C3 + h[i : i + runs])
        first, many = n.cumsum() - n, np.where(n >= size, n - size + 1, np.minimum(n, 1))
        grams = np.zeros(int(many.sum()), np.uint64)
        at, long = many.cumsum() - many, n >= size
        grams[spread(at[long], many[long])] = out[spread(first[long], many[long])]
        for i in np.flatnonzero((n > 0) & ~long).tolist():
            x = n[i : i + 1].astype(np.uint64)
            for j in range(first[i], first[i] + n[i]):
                x = mixed(x * C3 + h[j : j + 1])
            grams[at[i]] = x[0]
        for a, m in zip(at[many > 1].tolist(), many[many > 1].tolist()):
            grams[a : a + m].sort()
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[at[many > 0]] = True
        ends = np.concatenate([[0], new.cumsum()])
        return grams[new], ends[at + many] - ends[at]


class Signer:
    """The PartEnum signatures of sets of 64-bit features; see the module's text."""

    def __init__(self, percent: int, upto: int = 1 << 40):
        self.percent, ends, low = percent, [], 1
        while low <= upto:
            ends.append(low * 100 // percent)
            low = ends[-1] + 1
        self.ends = np.array(ends)  # the largest size of each band

    def __call__(self, features: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the set, signature) of all signatures of all sets."""
        band = np.searchsorted(self.ends, sizes)
        # the least size of a similar set may lie in the band below
        below = (self.percent * sizes + 99) // 100 <= self.ends[np.maximum(band - 1, 0)]
        starts, out = sizes.cumsum() - sizes, [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for tag in np.unique(np.concatenate([band, band - 1])[np.concatenate([sizes > 0, (sizes > 0) & below & (band > 0)])]).tolist():
            chosen = np.flatnonzero((sizes > 0) & ((band == tag) | (below & (band == tag + 1))))
            if k := (100 - self.percent) * int(self.ends[tag]) // self.percent:
                out += self.of_band(tag, k, chosen, features, starts, sizes)
        return tuple(np.concatenate(x) for x in zip(*out))

    def of_band(self, tag: int, k: int, chosen, features, starts, sizes):
        for level in range(LEVELS):
            seed = mixed(np.array([tag * LEVELS + level + 1], np.uint64))[0]
            value = mixed(features[spread(starts[chosen], sizes[chosen])] ^ seed)
            row = np.repeat(np.arange(len(chosen)), sizes[chosen])
            of = self.pairs if k <= PAIRS_UP_TO else self.parts
            number, signature, failed = of(k, seed, value, row, len(chosen), level == LEVELS - 1)
            yield chosen[number], signature
            chosen = chosen[failed]
            if not len(chosen):
                return

    @staticmethod
    def contents(value, row, rows: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the features' hashes in each part of each set, and how many there are."""
        slot = row * parts + ((value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(rows * parts, np.uint64)
        np.add.at(content, slot, mixed(value * C3))
        return content.reshape(rows, parts), np.bincount(slot, minlength=rows * parts).reshape(rows, parts)

    def pairs(self, k, seed, value, row, rows, last):
        n = k + 2 + max(4, k // 2)
        content, count = self.contents(value, row, rows, n)
        content = mixed(content + np.arange(1, n + 1, dtype=np.uint64) * C1 + seed)
        filled, (i, j) = count > 0, np.triu_indices(n, 1)
        failed = filled.sum(axis=1) < k + 2  # of n - k that agree, fewer than two may be filled
        number, pair = np.nonzero(filled[:, i] & filled[:, j])
        out = [(number, mixed(content[number, i[pair]] * C2 + content[number, j[pair]]))]
        if last and failed.any():
            number, one = np.nonzero(filled & failed[:, None])
            out.append((number, mixed(content[number, one] * C2 + C3)))
            empty = np.flatnonzero(filled.sum(axis=1) <= k)
            out.append((empty, np.full(len(empty), mixed(np.array([seed * C2], np.uint64))[0])))
        return *(np.concatenate(x) for x in zip(*out)), np.flatnonzero(failed)

    def parts(self, k, seed, value, row, rows, last):
        spare = 1 + k // 10
        n = k // 2 + 1 + spare
        content, count = (x.reshape(rows, n, 3) for x in self.contents(value, row, rows, 3 * n))
        pair = content.sum(axis=2, keepdims=True) - content
        held = count.sum(axis=2, keepdims=True) > count
        failed = (~held).any(axis=2).sum(axis=1) > spare
        if last:
            held = held | failed[:, None, None]
        pair = mixed(pair + np.arange(1, 3 * n + 1, dtype=np.uint64).reshape(1, n, 3) * C1 + seed)
        return np.nonzero(held)[0], pair[held], np.flatnonzero(failed)


def parity_bits(features: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set, whether the number of its features in each place is odd; about a place for each feature.

    The number of places is a power of two, so that a longer bitmap can be folded to a shorter one.
    """
    width = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / 64))).astype(np.int64)
    first = width.cumsum() - width
    place = np.repeat(first, sizes) + (mixed(features * C2).astype(np.int64) & (np.repeat(width, sizes) - 1))
    packed = np.packbits(np.bincount(place, minlength=int(width.sum())).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a : a + w] for a, w in zip((first // 8).tolist(), (width // 8).tolist())]


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the set's 128-bit key, its size and its parity bitmap."""

    def make():
        shingles = Shingler(size)

        def run(doc_ids, texts):
            features, sizes = shingles(texts)
            raw, ends = features.tobytes(), (8 * sizes.cumsum()).tolist()
            keys = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]
            return doc_ids, keys, sizes, parity_bits(features, sizes)

        return run

    return each_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of()), make, "doc_id long, key binary, n_shingles long, bits binary", ROWS)


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, sig) for each signature of each document."""

    def make():
        shingles, sign = Shingler(size), Signer(percent)

        def run(ids, texts):
            number, signature = sign(*shingles(texts))
            return ids.to_numpy()[number], signature.view(np.int64)

        return run

    return each_arrow(docs.select(F.col("doc_id").cast("long").alias("id"), text_of()), make, "id long, sig long", ROWS)


def sets_of(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """The members (id, known, asks, units) with the features of their documents.

    The texts stay where they are read if a count finds few enough members to broadcast.
    """

    def make():
        shingles = Shingler(size)

        def run(ids, known, asks, units, texts):
            features, sizes = shingles(texts)
            return ids, known, asks, units, pa.ListArray.from_arrays(np.concatenate([[0], sizes.cumsum()]).astype(np.int32), features.view(np.int64))

        return run

    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text")).join(small(members), "id")
    return each_arrow(chosen.select("id", "known", "asks", "units", "text"), make, "id long, known long, asks boolean, units array<long>, features array<long>", ROWS)


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if a count finds few rows; else a shuffle join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(id, label) for all ends of the links (a, b): the least id that links lead to.

    Each round takes the least label among the neighbours and then the label's own label, until
    nothing changes; each round is written, so a lost executor costs no more than one.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    stepped = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("next")), "labels")
    while True:
        labels = stepped.select("id", F.col("next").alias("label"))
        near = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        # only labels that will change are looked up, so the members of a component don't all join one row
        jump = labels.where("label < id").select(F.col("id").alias("low"), F.col("label").alias("far"))
        before, stepped = stepped, written(lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("next"), "label"), "labels")
        drop_written(before)
        if stepped.where("next <> label").isEmpty():
            drop_written(edges)
            return stepped.select("id", F.col("next").alias("label"))


def walk(n: int, near) -> list[tuple[int, int]]:
    """(first, other) for each of n items that others reach, the first of its component.

    near(x, items): which of some items are near x. An item is compared with those not reached yet.
    """
    out, todo = [], np.arange(n)
    while len(todo) > 1:
        first, todo = int(todo[0]), todo[1:]
        front = [first]
        while front and len(todo):
            hit = near(front.pop(), todo)
            met, todo = todo[hit], todo[~hit]
            out += [(first, x) for x in met.tolist()]
            front += met.tolist()
    return out


def meet(known: np.ndarray, asks: np.ndarray, near) -> list[tuple[int, int]]:
    """(asking item, other) for each two of the known components that a near pair with an asking item joins.

    An item asks those that are not connected with it yet and, if they ask themselves, come later.
    """
    out, root = [], np.unique(known, return_inverse=True)[1]
    for x in np.flatnonzero(asks).tolist():
        apart = root != root[x]
        apart[:x] &= ~asks[:x]
        others = np.flatnonzero(apart)
        hit = others[near(x, others)] if len(others) else others
        joined, first = np.unique(root[hit], return_index=True)
        out += [(x, y) for y in hit[first].tolist()]
        root[np.isin(root, joined)] = root[x]
    return out


def bitmaps_near(bits: list[bytes], sizes: np.ndarray, percent: int):
    """near() for walk(): whether sizes and bitmaps allow two sets to be similar."""
    least = min(map(len, bits))
    table = np.empty((len(bits), least // 8), np.uint64)
    for length in set(map(len, bits)):
        rows = [i for i, b in enumerate(bits) if len(b) == length]
        long = np.frombuffer(b"".join(bits[i] for i in rows), np.uint64).reshape(len(rows), length // least, least // 8)
        table[rows] = np.bitwise_xor.reduce(long, axis=1)

    def near(x: int, items: np.ndarray) -> np.ndarray:
        n = sizes[items]
        differ = np.bitwise_count(table[items] ^ table[x]).sum(axis=1, dtype=np.int64)
        alike = differ * (100 + percent) <= (100 - percent) * (n + sizes[x])
        return alike & (100 * n >= percent * sizes[x]) & (100 * sizes[x] >= percent * n)

    return near


def features_near(features: list[np.ndarray], percent: int):
    """near() for walk(): whether two sets are similar, by counting the features of one in the others."""
    sizes = np.array([len(f) for f in features])
    _, column = np.unique(np.concatenate(features), return_inverse=True)
    first, marked = sizes.cumsum() - sizes, np.zeros(int(column.max()) + 1, np.int64)

    def near(x: int, items: np.ndarray) -> np.ndarray:
        own = column[first[x] : first[x] + sizes[x]]
        marked[own] = 1
        n = sizes[items]
        common = np.add.reduceat(marked[column[spread(first[items], n)]], n.cumsum() - n)
        marked[own] = 0
        return 100 * common >= percent * (n + sizes[x] - common)

    return near


def first_units(members: DataFrame) -> DataFrame:
    """The members (key, id, m, blocks, weight) of groups of m members with the units that they are in: the block of their group that their hash tells.

    In a group of several blocks some members, EVERYWHERE and a quarter of a block at most on average, are in all blocks.
    """
    share = F.least(EVERYWHERE / F.col("m"), 0.25 / F.col("blocks"))
    everywhere = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1 << 40)) < share * float(1 << 40))
    own = F.array(F.pmod(F.xxhash64("id", F.lit(17)), F.col("blocks").cast("long")))
    blocks = F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).otherwise(own)
    return members.select("id", F.col("id").alias("known"), F.lit(True).alias("asks"), F.transform(blocks, lambda b: F.xxhash64("key", b)).alias("units"))


def second_units(members: DataFrame, found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The members (key, id, weight) of groups of several blocks that may have connections beyond those found (a, b), with the units where they meet.

    Members outside the largest connected part of their group ask; they are dealt into blocks,
    and so are the others. Each two blocks of asking members are a unit, and each block of asking
    members with each of others. Weights add up to one a block. Where a group is connected as a
    whole, none of its members is left. Beside the units come the tables that they are read from.
    """
    labels = components(found)
    named = written(members.join(small(labels), "id", "left").select("key", "id", "weight", F.coalesce("label", "id").alias("known")), "named")
    drop_written(labels)
    parts = named.groupBy("key", "known").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    largest = F.max_by("known", F.struct("n", "known"))
    groups = parts.groupBy("key").agg(largest.alias("largest"), F.max_by("weight", F.struct("n", "known")).alias("most"), F.sum("weight").alias("all"))
    open_ = groups.select("key", "largest", F.ceil(F.col("all") - F.col("most") - 1e-9).alias("asking"), F.greatest(F.lit(1), F.ceil("most")).alias("others")).where("asking > 0")
    asks = F.col("known") != F.col("largest")
    own = F.pmod(F.xxhash64("id", F.lit(23)), F.when(asks, F.col("asking")).otherwise(F.col("others")))
    open_ = written(open_, "open")
    dealt = named.join(small(open_), "key").withColumns({"asks": asks, "own": own})

    def upto(n: str) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    among = F.transform(upto("asking"), lambda b: F.xxhash64("key", F.lit(1), F.least("own", b), F.greatest("own", b)))
    asked = F.transform(upto("others"), lambda b: F.xxhash64("key", F.lit(2), "own", b))
    asking = F.transform(upto("asking"), lambda b: F.xxhash64("key", F.lit(2), b, "own"))
    return dealt.select("id", "known", "asks", F.when(F.col("asks"), F.concat(among, asked)).otherwise(asking).alias("units")), [named, open_]


def in_two_rounds(members: DataFrame, connect) -> DataFrame:
    """A table (a, b) of the connections that connect() finds within the groups of the members (key, id, m, blocks, weight).

    connect() takes (id, known, asks, units). The features of all members of a group that is
    connected after the first round move once, but for the few that are in all blocks.
    """
    found = written(connect(first_units(members)), "connected")
    several = members.where("blocks > 1")
    if several.isEmpty():
        return found
    units, read = second_units(several, found)
    more = written(found.union(connect(units)), "connected")
    for t in (found, *read):
        drop_written(t)
    return more


def unit_connections(ids: np.ndarray, known: np.ndarray, asks: np.ndarray, near) -> list[tuple[int, int]]:
    """walk() where nothing is known of the unit's members, else meet()."""
    return walk(len(ids), near) if asks.all() and (known == ids).all() else meet(known, asks, near)


def candidate_clusters(groups: DataFrame, reps: DataFrame, percent: int, most_sets: int = 2000, rows_a_bucket: int = 20_000) -> DataFrame:
    """(a, b): connections between the sets of each group (key, id) that sizes and bitmaps allow to be similar.

    reps: (id, n_shingles, bits). A group of many sets is dealt into blocks; see in_two_rounds().
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.iloc[np.lexsort((part["id"].to_numpy(), part["unit"].to_numpy()))]
        unit, ids, sizes, bits = (part[c].to_numpy() for c in ("unit", "id", "n_shingles", "bits"))
        known, asks, a, b = part["known"].to_numpy(), part["asks"].to_numpy(), [], []
        cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for x, y in zip(cuts, cuts[1:]):
            found = unit_connections(ids[x:y], known[x:y], asks[x:y], bitmaps_near(list(bits[x:y]), sizes[x:y], percent)) if y - x > 1 else []
            a += [ids[x + i] for i, _ in found]
            b += [ids[x + j] for _, j in found]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    buckets = max(1, groups.count() // rows_a_bucket)

    def connect(members: DataFrame) -> DataFrame:
        units = members.select("id", "known", "asks", F.explode("units").alias("unit"))
        dealt = units.join(reps, "id").withColumn("bucket", F.pmod("unit", F.lit(buckets)))
        return dealt.groupBy("bucket").applyInPandas(compare, "a long, b long").where("a <> b").distinct()

    n = F.col("key.n")
    return in_two_rounds(groups.select("key", "id", n.alias("m"), F.ceil(n / most_sets).alias("blocks"), F.lit(1 / most_sets).alias("weight")), connect)


def links_in_clusters(docs: DataFrame, clusters: DataFrame, size: int, percent: int, most_sets: int = 3000, most_features: int = 1_000_000) -> DataFrame:
    """(a, b): connections by links between the members (id, label, n_shingles) of each cluster.

    A cluster has so many blocks that one holds about most_sets sets or most_features features;
    see in_two_rounds().
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        # another text of a repeated id may have no words
        part = part[part["features"].map(len) > 0].sort_values("id", ignore_index=True)
        if len(part) < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        ids = part["id"].to_numpy()
        near = features_near([np.asarray(f).view(np.uint64) for f in part["features"]], percent)
        found = unit_connections(ids, part["known"].to_numpy(), part["asks"].to_numpy(), near)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    def connect(members: DataFrame) -> DataFrame:
        moved = written(members, "members")
        units = sets_of(docs, moved, size).withColumn("unit", F.explode("units"))
        found = written(units.groupBy("unit").applyInPandas(compare, "a long, b long").where("a <> b"), "links")
        drop_written(moved)
        return found

    sizes = clusters.groupBy("label").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("v"))
    blocks = sizes.select("label", "m", F.ceil(F.greatest(F.col("m") / most_sets, F.col("v") / most_features)).alias("blocks"))
    weight = F.greatest(F.lit(1 / most_sets), F.col("n_shingles") / most_features)
    return in_two_rounds(clusters.join(blocks, "label").select(F.col("label").alias("key"), "id", "m", "blocks", weight.alias("weight")), connect)


def groups_of(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, id) for the members of each different group of ids that share a signature; key holds the least and last id, the count and a hash of them all.

    rows: (doc_id, id), the id of each document's class; only one document of a class is signed.
    """
    others = rows.where("doc_id <> id").select("doc_id").distinct().join(rows.where("doc_id = id").select("doc_id"), "doc_id", "left_anti")
    copies = written(others, "copies")
    single = docs.where("doc_id is not null").join(small(copies), docs["doc_id"].cast("long") == copies["doc_id"], "left_anti")
    same = Window.partitionBy("sig")
    counted = signatures(single, size, percent).select("id", F.min("id").over(same).alias("hub"), F.max("id").over(same).alias("last"), F.count("*").over(same).alias("n"), F.bit_xor(F.xxhash64("id")).over(same).alias("mark"))
    shared = counted.where("hub <> last").select(F.struct("hub", "last", "n", "mark").alias("key"), "id")
    groups = written(shared.distinct(), "groups")
    drop_written(copies)
    return groups


def linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, id, n_shingles) with the least id of equal sets, and labels (id, label) of the ids that have links.

    id is null where doc_id is, and doc_id's own where there are no words.
    """
    whole = written(described(docs, size), "described")
    counted = whole.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    several = written(counted.where("n > 1").select("key", "least"), "copied")
    named = whole.join(small(several), "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("id"), "n_shingles", "bits")
    rows = written(named, "rows")
    drop_written(whole)
    drop_written(several)
    groups = groups_of(docs, rows.select("doc_id", "id").where("doc_id is not null"), size, percent)
    reps = rows.where("doc_id = id and n_shingles > 0").select("id", "n_shingles", "bits")
    near = candidate_clusters(groups, reps, percent)
    drop_written(groups)
    slim = rows.select("doc_id", "id", "n_shingles")
    if near.isEmpty():
        return slim, docs.sparkSession.createDataFrame([], "id long, label long")
    labels = components(near)
    clusters = written(labels.join(reps.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "id"), "clusters")
    drop_written(labels)
    drop_written(near)
    links = links_in_clusters(docs, clusters, size, percent)
    drop_written(clusters)
    if links.isEmpty():
        return slim, docs.sparkSession.createDataFrame([], "id long, label long")
    found = components(links)
    drop_written(links)
    return slim, found


def similar_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    A set is the distinct n-grams of `size` words, A-Z lower-cased, by 64-bit hashes; with fewer
    words the whole sequence; none for a null or empty text or one without words, which links with
    nothing. component_id is the least doc_id that links lead to. Rows that repeat an id with one
    text are one document; with several, each row goes by its text and the id is linked with what
    any of them is. A row without id links with nothing and has no component. Very long texts are
    read whole, a text at a time. An empty table gives no rows. Other columns are not read.
    """
    rows, labels = linked(docs, size, percent)
    return rows.join(small(labels), "id", "left").select("doc_id", "n_shingles", F.coalesce("label", "id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that are not the least id of their group.

    Null, empty and wordless texts have no group and stay. Rows that repeat an id stay or go
    together; of those that stay with equal texts, one does. Rows without id stay. Columns may
    have any names.
    """
    found = similar_documents(docs, size, percent).where("doc_id <> component_id").select("doc_id").distinct()
    others = written(found, "others").select(F.col("doc_id").alias(unused(docs, "other")))
    kept = docs.join(small(others), docs["doc_id"].cast("long") == others[others.columns[0]], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    mark = unused(docs, "mark")
    once = kept.where("doc_id is not null").withColumn(mark, F.sha2(text_of().cast("binary"), 256)).dropDuplicates(["doc_id", mark]).drop(mark)
    return once.unionByName(kept.where("doc_id is null"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similar_documents() of all documents: four words, 85 %."""
    return similar_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_join": op6_ngram_join}
