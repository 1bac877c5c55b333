"""Operator 2: WARC archives, written by Spark and read back by boundary-chain verification.

Writing: a record is one row of the text writer, whose line separator is the blank line that ends
a WARC record, so Spark's own commit protocol covers the files. A payload that equals an earlier
one becomes a revisit record without a payload. A block is an HTTP response: its header, which
states the payload's length also where a revisit leaves the payload out, and the payload.

Reading: the text reader splits the files at the magic "WARC/1.", wherever it stands, also inside
payloads. Every row is a candidate record: its header says where its successor should begin.
Candidates of one split are first joined to chains inside it, then pointer jumping from the start
of each file (a number of rounds logarithmic in its splits) finds the splits' entries that can be
reached, and only candidates on such a chain are records. The payload of a record whose text
holds the magic lies in several rows; those rows alone are put together again by a shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, shared_dir, table, written

MAGIC = "WARC/1."
END = "\r\n\r\n"
#: Fixed value of the format (the magic within is left out): what a revisit says of its payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed values of base32 (RFC 4648) beside the digits that conv() gives.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits make four of base32."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), CONV_DIGITS, BASE32_DIGITS)


def first_of_copies(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, first id) of each payload of least_bytes at least that more than one page has."""
    counted = pages.where(F.octet_length("payload") >= least_bytes).groupBy(F.sha1("payload").alias("sha"))
    return counted.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, broadcast_rows: int = 500_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of (page_id, url, html) below path.

    Of pages with equal payloads of at least least_bytes bytes, that with the smallest page_id is
    a response and the others are revisits of it; rows that repeat that page_id are responses too.
    A null html is an empty payload; a null url has no target line; a page without id revisits the
    smallest id of its copies, if there is one. The table of repeated payloads is broadcast if a
    count finds at most broadcast_rows rows, else joined by a shuffle. date: when the pages were
    taken. Other columns are not read.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    copies = written(first_of_copies(rows, least_bytes), "copies")
    small = copies.count() <= broadcast_rows
    marked = rows.withColumn("sha", F.sha1("payload")).join(F.broadcast(copies) if small else copies, "sha", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")) & (F.octet_length("payload") >= least_bytes)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"))
    header = F.concat_ws(
        "\r\n",
        F.lit(f"{MAGIC}1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        # a line break in a URL must not end the header
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(MAGIC), F.lit("WARC%2F1."))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1_base32(F.col("payload"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + len(END) + F.when(revisit, 0).otherwise(F.octet_length("payload"))).cast("string")),
    )
    record = F.concat(header, F.lit(END), http, F.lit(END), F.when(revisit, F.lit("")).otherwise(F.col("payload").cast("string")))
    marked.select(record.alias("value")).write.option("lineSep", END).text(path)
    drop_written(copies)


def field(header: Column, name: str) -> Column:
    """A header field's value, null where the header lacks it."""
    got = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    return F.when(got != "", got)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics: file, split, order within the task, text and its length with the magic after it."""
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("nth"), "value", (F.octet_length("value").cast("long") + len(MAGIC)).alias("length"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Adds start: the offset in the file of the magic before each row. Rows must be free of payloads here.

    Within a split the rows' lengths add up; a split's first row begins where the rows of the
    splits before it end.
    """
    per_split = rows.groupBy("file", "split").agg(F.sum("length").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = per_split.select("file", "split", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("length").over(within), F.lit(0)))
    return local.join(base, ["file", "split"]).withColumn("start", F.col("base") + F.col("local") - len(MAGIC)).drop("base", "local")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each magic in the files, with what its header says and the digest of the payload found there."""
    rows = rows_of(spark, path)
    header = F.substring_index("value", END, 1)
    at = F.octet_length("header") + len(END)
    http = F.substring(F.substring_index("value", END, 2), F.length("header") + len(END) + 1, F.length("value"))
    # a block that is no HTTP response is a payload as a whole
    skipped = F.when(F.startswith("http", F.lit("HTTP/")), F.octet_length("http") + len(END)).otherwise(0)
    payload = F.expr(f"substring(cast(value as binary), octet_length(header) + {len(END) + 1} + skipped, int(least(plen, {1 << 31 - 1})))")
    parsed = (
        rows.withColumn("header", header)
        .withColumn("clen", F.when(F.col("value").rlike(r"^[01]\r\n") & F.contains("value", F.lit(END)), F.expr("try_cast(regexp_extract(header, '(?im)^Content-Length:[ \\\\t]*([0-9]+)', 1) as bigint)")))
        .withColumn("http", http).withColumn("skipped", skipped).withColumn("plen", F.greatest(F.col("clen") - F.col("skipped"), F.lit(0)))
        .withColumn("payload", payload)
    )
    whole = F.octet_length("payload") == F.col("plen")
    return parsed.select(
        "file", "split", "nth", "length", "plen",
        (at + F.col("skipped") + len(MAGIC)).cast("long").alias("to_payload"),
        F.when(F.col("clen").isNotNull(), at + len(MAGIC) + F.col("clen") + len(END)).alias("size"),
        F.regexp_extract(field(F.col("header"), "WARC-Record-ID"), r"^<urn:page:(-?\d+)>$", 1).alias("id"),
        field(F.col("header"), "WARC-Target-URI").alias("url"), field(F.col("header"), "WARC-Type").alias("record_type"),
        F.regexp_extract(field(F.col("header"), "WARC-Refers-To"), r"^<urn:page:(-?\d+)>$", 1).alias("refers"),
        field(F.col("header"), "WARC-Payload-Digest").alias("said_digest"), field(F.col("http"), "Content-Length").alias("said_bytes"),
        F.when(whole, sha1_base32(F.col("payload"))).alias("digest"),
    )


def exits(part: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where the chain from it leaves the split."""
    part = part.sort_values("start", ascending=False)
    out: dict[int, int] = {}
    for start, to in zip(part["start"].tolist(), part["next"].tolist()):
        out[start] = out.get(to, to)
    return part.assign(exit=part["start"].map(out).astype("int64"))


def on_chain(part: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from its entry passes."""
    to, entries = dict(zip(part["start"].tolist(), part["next"].tolist())), part.loc[part["entry"], "start"].tolist()
    passed = set()
    for at in entries:
        while at in to and at not in passed:
            passed.add(at)
            at = to[at]
    return part.loc[part["start"].isin(passed), ["file", "start"]]


def reachable(found: DataFrame) -> DataFrame:
    """(file, start) of the candidates on the chain from each file's start.

    found: (file, split, start, next). A round of pointer jumping doubles the splits that a pointer
    passes; the rounds end when no pointer leads to another candidate.
    """
    slim = found.where("next is not null").select("file", "split", "start", "next")
    jump = written(slim.groupBy("file", "split").applyInPandas(exits, f"{slim.schema.simpleString()[7:-1].replace(':', ' ')}, exit long"), "exits")
    entry = jump.where("start = 0").select("file", "start")
    pointer = jump.select("file", "start", "exit")
    while not pointer.isEmpty():
        reached = entry.join(pointer, ["file", "start"]).select("file", F.col("exit").alias("start"))
        entry = written(entry.unionByName(reached).distinct(), "entry")
        ahead = pointer.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
        pointer = written(pointer.join(ahead, ["file", "exit"]).select("file", "start", F.col("beyond").alias("exit")), "pointer")
    # an entry may point past the end or to no candidate: on_chain stops there
    marked = jump.join(entry.withColumn("entry", F.lit(True)), ["file", "start"], "left").select("file", "split", "start", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "split").applyInPandas(on_chain, "file string, start long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records below path: page_id, url, record_type, refers_to, payload_bytes and payload_digest.

    The digest is that of the payload read; a revisit has those that its headers state. Bytes that
    no chain from a file's start reaches are no records, whatever they look like; a chain ends at
    a header that can't be read. No files, no rows.
    """
    found = written(placed(candidates(spark, path)).withColumn("next", F.col("start") + F.col("size")), "found")
    records = written(found.join(reachable(found), ["file", "start"], "left_semi"), "records")
    broken = records.where("digest is null").select("file", "start", (F.col("start") + F.col("to_payload")).alias("begin"), "plen")
    whole = records
    if not broken.isEmpty():
        whole = records.join(put_together(spark, path, found, broken), ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        F.expr("try_cast(id as bigint)").alias("page_id"), "url", "record_type", F.expr("try_cast(refers as bigint)").alias("refers_to"),
        F.when(revisit, F.expr("try_cast(said_bytes as bigint)")).otherwise(F.col("plen")).alias("payload_bytes"),
        F.when(revisit, F.substring("said_digest", 6, 32)).otherwise(F.col("digest")).alias("payload_digest"),
    )


def put_together(spark: SparkSession, path: str, found: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, start, joined): the digest of each record whose payload holds the magic.

    The rows of a payload follow its record's, so the record a row belongs to is the last one
    that begins at or before it; only rows of such records are shuffled with their text.
    """
    every = found.select("file", "split", "nth", "start").join(broken.withColumn("record", F.col("start")), ["file", "start"], "left")
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    held = every.withColumn("record", F.last("record", True).over(upto)).withColumn("end", F.last(F.col("begin") + F.col("plen"), True).over(upto)).withColumn("begin", F.last("begin", True).over(upto))
    held = held.where("record is not null and start <= end").select("file", "split", "nth", "start", "record", "begin", "end")
    text = rows_of(spark, path).select("file", "split", "nth", F.concat(F.lit(MAGIC), "value").cast("binary").alias("bytes"))
    parts = text.join(held, ["file", "split", "nth"]).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("parts"), F.first("begin").alias("begin"), F.first("end").alias("end")
    )
    joined = F.expr("substring(cast(array_join(transform(parts, p -> hex(p.bytes)), '') as string), int(2 * (begin - record) + 1), int(2 * (end - begin)))")
    return parts.select("file", F.col("record").alias("start"), sha1_base32(F.unhex(joined)).alias("joined"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives below the shared folder and read back."""
    path = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    read = read_warc(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


QUERIES = {"op2_warc": op2_warc}

#: base32 in SQL: each five hex digits of the SHA-1 make four digits.
ORACLES = {
    "op2_warc": """
with hashed as (
    select page_id, url, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), digits as (
    select *, list_transform(range(0, 8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: strpos('0123456789abcdef', substr(hex, (5 * i + j)::bigint, 1)) - 1), lambda x, y: 16 * x + y)) as v from hashed
), coded as (
    select *, array_to_string(list_transform(v, lambda x: concat(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32768) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 1024) % 32 + 1, 1),
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x // 32) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1))), '') as payload_digest from digits
), firsts as (select hex, min(page_id) as first_id from hashed group by hex)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id <> first_id then first_id end as refers_to, url
from coded join firsts using (hex)
"""
}
