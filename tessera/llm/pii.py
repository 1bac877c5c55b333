"""Operator 5: personal data by bootstrapped contextual extraction, by built-in functions alone.

Base spans come from four fixed patterns. They are the seeds of a bootstrap over all documents.
Instances are identifier-like tokens (with a digit or an @) and whole runs of digit groups, such
as a phone number with spaces. The lexical patterns of an instance, from narrow to wide:

* the two words before it,
* the word before it and its shape (digits as 9, runs of letters as a or A),
* its shape and the word after it,
* its shape alone, and that with runs of digits as one, if that many more instances bear it out.

Patterns and instances form a graph. In each round a pattern's confidence is the share of its
different instances that are known, if it has enough; an instance's is the chance that not all its
patterns are wrong; instances of high confidence are known in the next round. Occurrences that a
confident pattern itself finds and that no base span covers in their own text become spans of kind
"id"; what other texts hold of the instance doesn't matter.

Offsets need no Python: what a pattern matches and what splitting by it leaves alternate, so their
lengths add up to each match's place, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, text_of, unused, word_array, written
from .fingerprint import let

#: The kinds in their order with their patterns. Possessive loops, and starts only where
#: a run of characters starts or the last match ended (\G), match the same but never try a run twice.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A substring that every match of the kind has, to skip texts without it by a plain search.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: A run of groups of digits, or an identifier-like token; both begin a word and end with one.
INSTANCE = r"(?<![^\x20\x09-\x0D])(?:[+(]?[0-9]++(?:[\x20().-]{1,2}[0-9]++)++|[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]*+"
#: What a pattern begins with: two words, word and shape, shape and word, shape, shape with runs of digits as one.
WORDS, AFTER_WORD, BEFORE_WORD, SHAPE, LOOSE = "w", "ws", "sw", "s", "r"

SPAN = "array<struct<kind:int,start:int,stop:int,value:string>>"


def running(values: Column, merge, block: int = 64) -> Column:
    """For each int of an array, merge() of 0 and all before it, by blocks: no array as long as the whole is copied for each element."""

    def prefixes(some: Column) -> Column:
        return F.aggregate(some, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def moved(inner: Column) -> Column:
        before = prefixes(F.transform(inner, lambda p: F.element_at(p, -1)))
        shifted = lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: merge(b, v))
        return let(before, lambda found: F.flatten(F.zip_with(inner, F.slice(found, 1, F.size(inner)), shifted)))

    def blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / block).cast("int"))
        return F.transform(starts, lambda i: prefixes(F.slice(all_, i * block + 1, block)))

    return let(let(values, blocks), moved)


def matches(text: Column, pattern: str) -> Column:
    """The leftmost matches that don't overlap (m), and what stands before, between and after them (gap)."""
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))


def spans_of(both: Column, kind: int) -> Column:
    """An array of (kind, start, stop, value) from matches(), of which there is one at least."""
    sizes = F.zip_with(both["m"], F.slice(both["gap"], 1, F.size(both["m"])), lambda m, g: F.length(g) + F.length(m))
    ends = let(sizes, lambda s: F.zip_with(s, running(s, lambda x, y: x + y), lambda size, at: at + size))
    return F.zip_with(both["m"], ends, lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("stop"), m.alias("value"))).cast(SPAN)


def located(text: Column, pattern: str, kind: int) -> Column:
    """The leftmost matches that don't overlap, as an array of (kind, start, stop, value)."""
    return let(matches(text, pattern), lambda both: F.when(F.size(both["m"]) > 0, spans_of(both, kind)).otherwise(F.array().cast(SPAN)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern is one of personal data."""
    if kind == "ip":
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), part)
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15) if kind == "phone" else F.lit(True)


def passing(kind: str):
    return lambda span: passes(kind, span["value"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    parts = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        some = F.filter(located(text, pattern, i), passing(kind))
        parts.append(F.when(text.rlike(NEEDS[kind]), some).otherwise(F.array().cast(SPAN)))
    return F.concat(*parts)


def covered(spans: Column, base: Column) -> Column:
    """For each of some spans that don't overlap, in order, whether a base span overlaps it.

    Both are sorted together: a span is overlapped if, of the base spans that begin before its end,
    the one that ends last ends after its start.
    """
    ends = F.transform(spans, lambda s: F.struct(s["stop"].alias("at"), F.lit(0).alias("base"), s["start"].alias("other")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["stop"].alias("other")))

    def swept(events: Column) -> Column:
        latest = running(F.transform(events, lambda e: F.when(e["base"] == 1, e["other"]).otherwise(0)), lambda x, y: F.greatest(x, y))
        both = F.zip_with(events, latest, lambda e, at: F.struct(e["base"].alias("base"), (at > e["other"]).alias("over")))
        return F.transform(F.filter(both, lambda x: x["base"] == 0), lambda x: x["over"])

    return let(F.array_sort(F.concat(ends, starts)), swept)


def in_context(text: Column, base: Column) -> Column:
    """An array of the instances of a text: start, stop, value, the two words before (left; none if there is only one), the word after (right, empty at the end) and seed.

    Instances are whole words and what stands between them isn't empty, so two instances before it
    hold all that an instance's context may need; no text is cut for each.
    """

    def made(both: Column) -> Column:
        piece = lambda name, i: F.coalesce(F.get(both[name], i), F.lit(""))
        left = lambda i: F.slice(word_array(F.concat(piece("m", i - 2), piece("gap", i - 1), piece("m", i - 1), piece("gap", i))), -2, 2)
        right = lambda i: F.regexp_extract(F.concat(piece("gap", i + 1), piece("m", i + 1)), r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)", 1)

        def each(spans: Column) -> Column:
            one = lambda seed: lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), left(i).alias("left"), right(i).alias("right"), F.get(seed, i).alias("seed"))
            return let(covered(spans, base), lambda seed: F.transform(spans, one(seed)))

        return let(spans_of(both, len(KINDS)), each)

    return let(matches(text, INSTANCE), lambda both: F.when(F.size(both["m"]) > 0, made(both)))


def shape(token: Column) -> Column:
    """Digits as 9, each run of letters as a, A (upper-case A-Z) or l (not ASCII)."""
    for pattern, kept in (("[0-9]", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), (r"[^\x00-\x7F]+", "l")):
        token = F.regexp_replace(token, pattern, kept)
    return token


def instances(spans: DataFrame) -> DataFrame:
    """row, start, stop, token, seed and patterns for each instance of (row, text, base)."""
    tokens = spans.where(F.col("text").rlike("[0-9@]")).select("row", F.explode(in_context(F.col("text"), F.col("base"))).alias("s"))
    token = F.regexp_replace("s.value", r"[.,;:!?]+$", "")
    made = tokens.select(
        "row", F.col("s.start").alias("start"), (F.col("s.start") + F.length(token)).alias("stop"), token.alias("token"), F.col("s.seed").alias("seed"),
        F.transform("s.left", F.lower).alias("left"), F.lower("s.right").alias("right"), shape(token).alias("shape"),
    ).where("token <> ''")
    pattern = lambda kind, *parts: F.concat_ws("\t", F.lit(kind), *parts)
    some = F.array_compact(F.array(
        F.when(F.size("left") > 0, pattern(WORDS, F.array_join("left", " "))), F.when(F.size("left") > 0, pattern(AFTER_WORD, F.element_at("left", -1), "shape")),
        F.when(F.col("right") != "", pattern(BEFORE_WORD, "shape", "right")), pattern(SHAPE, "shape"), pattern(LOOSE, F.regexp_replace("shape", "9+", "9")),
    ))
    # long words by their hash
    short = F.transform(some, lambda p: F.when(F.length(p) > 160, F.concat(F.substring_index(p, "\t", 1), F.lit("\t"), F.sha2(p.cast("binary"), 256))).otherwise(p))
    return made.select("row", "start", "stop", "token", "seed", short.alias("patterns"))


def with_patterns(edges: DataFrame, patterns: DataFrame, broadcast_rows: int, salts: int = 64) -> DataFrame:
    """The edges (pattern, token, ...) of some different patterns, with the patterns' columns.

    Patterns are broadcast if a count finds few; else a pattern is joined in `salts` parts, by the
    hash of the token, so that one of very many edges is no single task's.
    """
    if patterns.count() <= broadcast_rows:
        return edges.join(F.broadcast(patterns), "pattern")
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(salts)))
    return dealt.join(patterns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["pattern", "salt"]).drop("salt")


def bootstrap(found: DataFrame, rounds: int | None = None, confident: float = 0.8, least_tokens: int = 3, least_of_shape: int = 20, broadcast_rows: int = 100_000) -> DataFrame:
    """The patterns that are confident after a round that adds none, or after so many rounds.

    The graph of patterns and tokens is aggregated before anything is joined, so a pattern that
    a third of all tokens share is one row for each of its tokens. A pattern needs least_tokens
    different tokens, one without words least_of_shape. What is known only grows from round to
    round, so the rounds end.
    """
    graph = written(found.select(F.explode("patterns").alias("pattern"), "token", "seed").groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "graph")
    seeds = graph.groupBy("token").agg(F.max(F.col("seed").cast("double")).alias("seeded"))
    known, stored, before, done = seeds.withColumnRenamed("seeded", "weight"), None, 0, 0
    least = F.when(F.substring_index("pattern", "\t", 1).isin(SHAPE, LOOSE), least_of_shape).otherwise(least_tokens)
    while True:
        scored = graph.join(known, "token").groupBy("pattern").agg(F.sum("weight").alias("good"), F.count("*").alias("tokens"))
        enough = scored.select("pattern", "tokens", F.round(F.col("good") / F.col("tokens"), 12).alias("confidence")).where((F.col("tokens") >= least) & (F.col("confidence") >= confident))
        sure = written(enough.select("pattern", "confidence"), "sure")
        if stored is not None:
            drop_written(stored)
        n, done = sure.count(), done + 1
        if n == before or done == rounds:
            drop_written(graph)
            return sure.select("pattern")
        reached = with_patterns(graph, sure, broadcast_rows).groupBy("token").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))), 12).alias("chance"))
        stored = known = written(seeds.join(reached, "token", "left").select("token", F.greatest("seeded", F.when(F.col("chance") >= confident, F.col("chance")).otherwise(0.0)).alias("weight")), "known")
        drop_written(sure)
        before = n


def found_by(found: DataFrame, patterns: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """The instances that one of the patterns finds."""
    edges = found.select("row", "start", "stop", "token", F.explode("patterns").alias("pattern"))
    return with_patterns(edges, patterns, broadcast_rows).select("row", "start", "stop", "token").distinct()


def rediscovered(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """(kind, hidden, again): how many tokens of base spans are hidden from the bootstrap (one in `one_in`, by hash), and how many of those its patterns find."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    found = written(instances(rows.withColumn("base", base_spans(F.col("text")))), "instances")
    hidden = F.col("seed") & (F.pmod(F.xxhash64("token"), F.lit(one_in)) == 0)
    again = found_by(found.where(hidden), bootstrap(found.withColumn("seed", F.col("seed") & ~hidden)))
    kind = F.when(F.contains("token", F.lit("@")), "email").when(F.rlike("token", F.lit(r"[0-9]\.[0-9]")), "ip").when(F.contains("token", F.lit("+")), "phone").otherwise("card").alias("kind")
    each = found.where(hidden).select("token").distinct().join(again.select("token", F.lit(1).alias("met")).distinct(), "token", "left")
    return each.groupBy(kind).agg(F.count("*").alias("hidden"), F.count("met").alias("again"))


def all_spans(docs: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, mark (the hash of the text), base and extra (arrays of spans) for each row of docs.

    Confident patterns are broadcast if a count finds few of them.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    marked = rows.withColumn("mark", F.xxhash64("text")).withColumn("base", base_spans(F.col("text")))
    # only texts that may hold an instance are kept
    based = written(marked.withColumn("text", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("")), "base")
    found = written(instances(based), "instances")
    more = found_by(found.where("not seed"), bootstrap(found, broadcast_rows=broadcast_rows), broadcast_rows).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "stop", F.col("token").alias("value")))).alias("extra")
    )
    slim = based.select("doc_id", "row", "mark", "base")
    return slim.join(more, "row", "left").withColumn("extra", F.coalesce("extra", F.array().cast(SPAN)))


def listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, "id"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans, for each row of docs.

    A null or empty text has none. Spans found by context have the kind id and follow the base
    spans, which stay as they are. Equal rows have equal results. Other columns are not read.
    """
    done = all_spans(docs)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return done.select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, of the kind that starts first (of those, the longest).

    The pieces between the spans are cut out and joined once, so a text of many spans isn't copied
    for each. There is one span at least.
    """
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in [*KINDS, "id"]))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    def merged(every: Column) -> Column:
        """A span for those that overlap: one begins where all before it have ended, and ends where the last of its own does."""
        stops = F.transform(every, lambda s: -s["back"])

        def of(latest: Column) -> Column:
            firsts = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: F.get(every, i)["start"] >= F.get(latest, i))
            end = lambda some, k: F.coalesce(F.get(latest, F.get(some, k + 1)), F.array_max(stops))
            each = lambda some: F.transform(some, lambda i, k: F.struct(F.get(every, i)["start"].alias("start"), end(some, k).alias("stop"), F.get(every, i)["kind"].alias("kind")))
            return let(firsts, each)

        return let(running(stops, lambda x, y: F.greatest(x, y)), of)

    block = 64

    def joined(kept: Column) -> Column:
        """Cut in blocks of spans, and these in pieces: a text isn't walked from its start for each span."""

        def pieces(part: Column, begin: Column) -> Column:
            inside = F.substring(text, begin + 1, F.element_at(part, -1)["stop"] - begin)
            ends = F.concat(F.array(begin), F.transform(part, lambda s: s["stop"]))
            one = lambda cut: F.array_join(F.zip_with(part, F.slice(ends, 1, F.size(part)), lambda s, at: F.concat(F.substring(cut, at - begin + 1, s["start"] - at), F.get(names, s["kind"]))), "")
            return let(inside, one)

        def cut(i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(kept, i * block - 1)["stop"])
            return let(F.slice(kept, i * block + 1, block), lambda part: let(begin, lambda at: pieces(part, at)))

        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / block).cast("int")), cut)
        last = F.element_at(kept, -1)["stop"]
        return F.concat(F.array_join(blocks, ""), F.substring(text, last + 1, F.length(text)))

    return let(let(ordered, merged), joined)


def redact(docs: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of docs, all columns, with personal data replaced in text and n_chars (where there is one) as its new length.

    A null or empty text, or one without spans, stays as it is, with its n_chars; equal rows stay
    equal, and columns may have any names. Base spans are found
    again where a row is rewritten; those found by context are joined by id and text hash,
    broadcast if a count finds few of them.
    """
    of = unused(docs, "extra")
    once = all_spans(docs).where("size(extra) > 0").select("doc_id", "mark", "extra").dropDuplicates(["doc_id", "mark"])
    extra = written(once.select(F.struct("doc_id", "mark", "extra").alias(of)), "extra")
    few = F.broadcast(extra) if extra.count() <= broadcast_rows else extra
    text = text_of()
    joined = docs.join(few, F.col("doc_id").eqNullSafe(F.col(f"{of}.doc_id")) & (F.xxhash64(text) == F.col(f"{of}.mark")), "left")
    spans = F.concat(base_spans(text), F.coalesce(F.col(f"{of}.extra"), F.array().cast(SPAN)))
    out = joined.withColumn(of, spans)
    hit = F.size(of) > 0
    out = out.withColumn("text", F.when(hit, redacted(text, F.col(of))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_personal() of all documents."""
    return find_personal(table(spark, sf_dir, "documents"))


QUERIES = {"op5_pii": op5_pii}
