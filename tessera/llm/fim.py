"""Operator 13: fill-in-middle by a parallel automaton scan.

An automaton over the bytes of a text knows whether a byte begins a unit (a line with its end, or
the last one without) and whether a mark has been met. A chunk of a text is scanned without
knowing the state it is entered in: it gives the function from its entry state to its exit state,
and for each entry state the number of units that begin in it. Both compose associatively, so the
chunks' functions, composed from left to right, resolve the entry states of all chunks and the number
of units before them; a cut after so many units lies in the chunk where the next unit begins, and
only this chunk is looked at again.

A text of up to 64 KiB is one chunk, and its row needs no shuffle. A longer one is cut into
chunks that all tasks scan; what meets by text is a function for each chunk, at most some 32,000 for
the longest text there can be.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_of

CHUNK = 64 << 10
#: The marks of prefix, suffix and middle, and the seed of the draws.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50


def automaton(marks: tuple[str, ...] = MARKS) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(class of each byte, next state by class and state, whether a unit begins by class and state).

    A state is 2 * (what has been read of a mark) + (1 inside a unit); the last two have met a
    mark and stay so. Class 0 is all bytes that neither end a line nor occur in a mark.
    """
    words = [m.encode() for m in marks]
    if not words or any(not w or b"\n" in w for w in words):
        raise ValueError("marks must be of one line and not empty")
    begun = sorted({w[:i] for w in words for i in range(len(w))}, key=lambda p: (len(p), p))
    letters = [None, b"\n", *(bytes([c]) for c in sorted(set(b"".join(words))))]
    met = len(begun)
    step, begins = np.zeros((len(letters), 2 * met + 2), np.uint8), np.zeros((len(letters), 2 * met + 2), np.int64)
    for c, letter in enumerate(letters):
        for state in range(2 * met + 2):
            read, inside = divmod(state, 2)
            if read < met and letter is not None:
                seen = begun[read] + letter
                ends = any(seen.endswith(w) for w in words)
                read = met if ends else next(begun.index(seen[i:]) for i in range(len(seen) + 1) if seen[i:] in begun)
            elif read < met:
                read = 0
            step[c, state] = 2 * read + (letter != b"\n")
            begins[c, state] = not inside
    classes = bytearray(256)
    for c, letter in enumerate(letters[1:], 1):
        classes[letter[0]] = c
    return bytes(classes), step, begins


def composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First, then second; each a function of states and counts by entry state, or rows of such."""
    (f, n), (g, m) = first, second
    return np.take_along_axis(g, f, -1), n + np.take_along_axis(m, f, -1)


def scanned(data: bytes, machine) -> tuple[np.ndarray, np.ndarray]:
    """The function and the counts of a chunk: those of its bytes, composed in pairs. A run of class 0 does what its first byte does."""
    classes, step, begins = machine
    codes = np.frombuffer(data.translate(classes), np.uint8)
    if not len(codes):
        return np.arange(step.shape[1], dtype=np.uint8), np.zeros(step.shape[1], np.int64)
    keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))
    codes = codes[keep]
    f, n = step[codes], begins[codes]
    while len(f) > 1:
        odd = (f[-1:], n[-1:]) if len(f) % 2 else None
        even = len(f) // 2 * 2
        f, n = composed((f[0:even:2], n[0:even:2]), (f[1:even:2], n[1:even:2]))
        if odd:
            f, n = np.concatenate([f, odd[0]]), np.concatenate([n, odd[1]])
    return f[0], n[0]


def prefixes(f: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions and counts of the first, the first two, ... chunks: a scan in doubling steps."""
    f, n, shift = f.copy(), n.copy(), 1
    while shift < len(f):
        g, m = composed((f[:-shift], n[:-shift]), (f[shift:], n[shift:]))
        f[shift:], n[shift:] = g, m
        shift *= 2
    return f, n


def chars(data: bytes) -> int:
    """How many code points begin in data."""
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def begin_of(data: bytes, inside: bool, nth: int) -> int:
    """The code points of a chunk before its unit nth (from 0) begins; inside: whether a unit goes on at its start."""
    starts = np.flatnonzero(np.frombuffer(data, np.uint8)[:-1] == 10) + 1
    at = int(starts[nth if inside else nth - 1]) if inside or nth else 0
    return chars(data[:at])


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of sha256(seed:doc_id) as integers; without an id, that of seed: alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cuts(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many units prefix and middle end."""
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _short(docs: DataFrame, machine, chunk: int) -> DataFrame:
    """key columns, n, met, and the code points at which prefix and middle end, of texts of one chunk; the text goes with them."""
    schema = docs.schema
    met = machine[1].shape[1] - 2

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
                found = [scanned(t, machine) for t in texts]
                n, seen = np.array([x[1][0] for x in found], np.int64), np.array([x[0][0] >= met for x in found], bool)
                at = cuts(n, *(part.column(part.schema.get_field_index(h)).to_numpy() for h in ("h1", "h2")))
                ends = [[chars(t) if u == k else begin_of(t, False, int(u)) for t, u, k in zip(texts, x, n)] for x in at]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(seen), *(pa.array(e, pa.int64()) for e in ends)], names=[*part.schema.names, "n", "met", "prefix_end", "middle_end"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.where(F.octet_length("text") <= chunk).mapInArrow(run, f"{fields}, n long, met boolean, prefix_end long, middle_end long")


def _long(docs: DataFrame, machine, chunk: int) -> DataFrame:
    """The same of longer texts: chunks are scanned by all tasks, functions meet by text, and the chunks that hold a cut are looked at again.

    Rows of one id and one text share their cuts, so these are found once.
    """
    giants = docs.where(F.octet_length("text") > chunk).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    met = machine[1].shape[1] - 2

    def pieces(data: Column) -> Column:  # the bytes are made once, not for each chunk
        count = F.ceil(F.octet_length(data) / chunk).cast("int")
        return F.get(F.transform(F.array(data), lambda d: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(d, i * chunk + 1, F.lit(chunk)))), F.lit(0))

    spread = giants.select("doc_id", "digest", "h1", "h2", F.posexplode(pieces(F.col("text").cast("binary"))).alias("at", "data"))

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                data = part.column(part.schema.get_field_index("data")).to_pylist()
                found = [scanned(d, machine) for d in data]
                extra = [pa.array([f.tolist() for f, _ in found], pa.list_(pa.int32())), pa.array([n.tolist() for _, n in found], pa.list_(pa.int64())), pa.array([chars(d) for d in data], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.select(["doc_id", "digest", "h1", "h2", "at"]).columns, *extra], names=["doc_id", "digest", "h1", "h2", "at", "f", "counts", "n_chars"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    functions = spread.repartition("digest", "at").mapInArrow(scan, f"doc_id {kind}, digest string, h1 long, h2 long, at int, f array<int>, counts array<long>, n_chars long")
    once = functions.groupBy("doc_id", "digest", "h1", "h2", "at").agg(F.first("f").alias("f"), F.first("counts").alias("counts"), F.first("n_chars").alias("n_chars"))

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        f, n = prefixes(np.array(rows["f"].tolist(), np.uint8), np.array(rows["counts"].tolist(), np.int64))
        entry, before, count = np.append(0, f[:-1, 0]), np.append(0, n[:-1, 0]), int(n[-1, 0])
        code_points = np.append(0, rows["n_chars"].cumsum())
        out = {"doc_id": rows["doc_id"].iloc[:1], "digest": rows["digest"].iloc[:1], "n": count, "met": bool(f[-1, 0] >= met)}
        for name, u in zip(("prefix", "middle"), cuts(np.array([count]), rows["h1"].to_numpy()[:1], rows["h2"].to_numpy()[:1])):
            i = int(np.searchsorted(n[:, 0], u[0], "right"))  # the chunk where unit u begins
            ended = i == len(f)
            out |= {f"{name}_at": -1 if ended else i, f"{name}_inside": bool(not ended and entry[i] % 2), f"{name}_nth": 0 if ended else int(u[0] - before[i]), f"{name}_before": int(code_points[i])}
        return pd.DataFrame(out)

    one = "at int, inside boolean, nth long, before long"
    found = ", ".join(f"{name}_{c}" for name in ("prefix", "middle") for c in one.split(", "))
    placed = once.groupBy("doc_id", "digest").applyInPandas(resolve, f"doc_id {kind}, digest string, n long, met boolean, {found}")

    @F.pandas_udf("long")
    def within(data: pd.Series, inside: pd.Series, nth: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([b + (begin_of(d, bool(i), int(k)) if d is not None else 0) for d, i, k, b in zip(data, inside, nth, before)], dtype="int64")

    def end(name: str) -> Column:
        held = F.when(F.col(f"{name}_at") >= 0, F.substring(F.col("text").cast("binary"), F.col(f"{name}_at") * chunk + 1, F.lit(chunk)))
        return within(held, F.col(f"{name}_inside"), F.col(f"{name}_nth"), F.col(f"{name}_before")).alias(f"{name}_end")

    same = giants["doc_id"].eqNullSafe(placed["doc_id"]) & (giants["digest"] == placed["digest"])
    return giants.join(placed, same).select(*(giants[c] for c in docs.columns), "n", "met", end("prefix"), end("middle"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, ...] = MARKS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    n is the number of lines. rate: of 100 documents, how many are transformed; spm: of 100 of
    those, how many give the suffix first. A text that is null, empty or holds a mark stays as it
    is (form plain, null counts). Rows without a doc_id draw from the seed alone; rows of one id and one
    text give equal rows. Other columns are left out.
    """
    machine = automaton(marks)
    h = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", text_of().alias("text"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    cut = _short(rows, machine, chunk).unionByName(_long(rows, machine, chunk))
    plain = F.col("met") | (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    text, a, b = F.col("text"), F.col("prefix_end").cast("int"), F.col("middle_end").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.length(text))
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    counted = lambda x: F.when(F.col("form") != "plain", x)
    return cut.withColumn("form", form).select("doc_id", "n", "form", counted(F.col("prefix_end")).alias("prefix_chars"), counted(F.col("middle_end") - F.col("prefix_end")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text that gave an output: what stands between its marks, in the order of the text."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    second, third, last = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(second, last, third)).otherwise(F.concat(third, last, second))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill_in_middle() of all documents, with digests for the outputs and for the texts restored from them."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLES = {
    "op13_fill_in_middle": f"""with d as (select doc_id, coalesce(text, '') as t, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as us, [('0x' || h[8 * i + 1:8 * i + 8])::bigint for i in range(4)] as hs from d),
c as (select *, len(us) as n, least(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) as a, greatest(hs[1] % (len(us) + 1), hs[2] % (len(us) + 1)) as b from u),
p as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or hs[3] % 100 >= {RATE} then 'plain' when hs[4] % 100 < {SPM} then 'spm' else 'psm' end as form,
    coalesce(array_to_string(us[1:a], ''), '') as prefix, coalesce(array_to_string(us[a + 1:b], ''), '') as middle, coalesce(array_to_string(us[b + 1:n], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    sha256(case form when 'plain' then t when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p"""
}
QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
