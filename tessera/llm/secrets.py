"""Operator 7: secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must contain.
The texts of a batch form a segment with its own inverted index: all trigrams of their bytes (A-Z
lower-cased) are read once, and those that some rule asks for become posting lists, which serve
all rules. A rule's query intersects and unites posting lists, and its pattern runs over the
candidates that remain. A rule without mandatory trigrams scans every text of the segment.

A segment's index lives as long as its scan: the rules are known beforehand, so an index kept on
disk would be read once, and shuffling postings to join them costs more than the texts' bytes.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import each_arrow, table, text_of

parse, op = re._parser.parse, re._constants

#: The rules in their order: kind, pattern, and the shortest value of its last group that counts.
RULES = (
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"(AKIA[A-Z0-9]+)", 16),
    ("hex", r"([0-9a-f]+)", 32),
)
#: Rules beyond the base ones, whose matches are added to the spans.
ADDED = (
    ("private_key", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1),
    ("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1),
    ("github", r"(gh[pousr]_[A-Za-z0-9]+)", 40),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]+)", 15),
    ("stripe", r"([rs]k_live_[A-Za-z0-9]+)", 24),
)

#: The query that every text answers.
ALL = ("and", frozenset())


def both(a, b):
    """The conjunction of two queries; a query is ("and" or "or", set of trigrams and queries)."""
    parts = [x[1] if isinstance(x, tuple) and x[0] == "and" else {x} for x in (a, b)]
    return ("and", frozenset().union(*parts))


def either(queries):
    queries = set(queries)
    return ALL if ALL in queries else queries.pop() if len(queries) == 1 else ("or", frozenset(queries))


def of_strings(strings):
    """The query for texts that hold one of some strings; trigrams beyond ASCII are left out."""
    return either(("and", frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii())) for s in strings)


def trigram_query(pattern: str, most: int = 16):
    """What the lower-cased text of every match must contain, as a query over lower-case trigrams.

    Walks the parsed pattern with the strings that may stand here so far. Where a part has no
    few exact strings, the trigrams of the strings before it become part of the query.
    """

    def strings(node) -> set[str] | None:
        """The few strings that a part matches, lower-cased, or None."""
        kind, arg = node
        if kind is op.LITERAL:
            return {chr(arg).lower()}
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 8:
            return {chr(c).lower() for _, c in arg}
        if kind is op.SUBPATTERN:
            return sequence(arg[-1])
        if kind is op.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[1] == 1 and (one := sequence(arg[2])) is not None:
            return one | ({""} if arg[0] == 0 else set())
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            more = strings(node)
            if more is None or len(out) * len(more) > most:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(nodes):
        query, here = ALL, {""}
        for node in nodes:
            kind, arg = node
            more = strings(node)
            if more is not None and len(here) * len(more) <= most:
                here = {a + b for a in here for b in more}
                continue
            query, here = both(query, of_strings(here)), {""}
            if more is not None:
                here = more
            elif kind is op.SUBPATTERN:
                query = both(query, walk(arg[-1]))
            elif kind is op.BRANCH:
                query = both(query, either(walk(x) for x in arg[1]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
                query = both(query, walk(arg[2]))
        return both(query, of_strings(here))

    return walk(parse(pattern))


def trigrams(query) -> set[str]:
    return set().union(*({x} if isinstance(x, str) else trigrams(x) for x in query[1])) if query[1] else set()


#: Each byte with A-Z lower-cased, as a number that leaves room for two more.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int32)


def code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Segment:
    """The inverted index of some texts: for each trigram asked for, the numbers of the texts that hold it."""

    def __init__(self, texts: pa.Array, wanted: dict[str, int], asked: np.ndarray):
        """wanted: a number for each trigram; asked: that number by the trigram's code, -1 where no rule asks for it."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        ends -= ends[0]
        self.size, self.wanted = len(texts), wanted
        number = asked[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        place = np.flatnonzero(number >= 0)
        text = np.searchsorted(ends, place, "right") - 1
        inside = place + 3 <= ends[text + 1]  # not across two texts
        pair = np.unique(number[place[inside]].astype(np.int64) * self.size + text[inside])
        gram, text = np.divmod(pair, max(1, self.size))
        self.postings = np.split(text, np.searchsorted(gram, np.arange(1, len(wanted))))

    def find(self, query) -> np.ndarray:
        """The sorted numbers of the texts that answer a query, the shortest lists intersected first."""
        if not query[1]:
            return np.arange(self.size)
        lists = sorted((self.postings[self.wanted[x]] if isinstance(x, str) else self.find(x) for x in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def segments(queries):
    """A function from texts to their segment, with the postings that some queries ask for."""
    wanted = {g: i for i, g in enumerate(sorted(set().union(*map(trigrams, queries))))}
    asked = np.full(1 << 24, -1, np.int16)
    for g, i in wanted.items():
        asked[code(g)] = i
    return lambda texts: Segment(texts, wanted, asked)


def scan(docs: DataFrame, rules=RULES, added=ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the number of matches of each rule that are long enough, their digest, and the spans of added rules, too.

    Matches are leftmost and don't overlap within a rule; those whose last group is too short are
    dropped and not tried again. Spans are kind:start:end in code points, by start, then in the
    rules' order. A null or empty text has none, a very long one is a segment of its own, equal
    rows have equal results, and an empty table gives no rows. Other columns are not read.
    """
    kinds, base = [kind for kind, _, _ in (*rules, *added)], len(rules)

    def make():
        compiled = [(re.compile(pattern), trigram_query(pattern), least) for _, pattern, least in (*rules, *added)]
        segment = segments([q for _, q, _ in compiled])

        def run(doc_ids, texts):
            index, raw = segment(texts), texts.to_pylist()
            spans = [[] for _ in raw]
            for k, (pattern, query, least) in enumerate(compiled):
                for i in index.find(query).tolist():
                    spans[i] += [(m.start(), k, m.end()) for m in pattern.finditer(raw[i]) if m.end(m.lastindex) - m.start(m.lastindex) >= least]
            listed = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(s))
            counts = [[sum(x[1] == k for x in s) for s in spans] for k in range(base)]
            digests = [hashlib.sha256(listed([x for x in s if x[1] < base]).encode()).hexdigest() for s in spans]
            return doc_ids, *counts, digests, list(map(listed, spans))

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {', '.join(f'n_{k} long' for k in kinds[:base])}, base_sha256 string, spans string"
    return each_arrow(docs.select(id_col, text_of(text_col)), make, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op7_secrets": op7_secrets}


def spans_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one rule: matches and the gaps between them alternate, so lengths add up to offsets."""
    return f"""
select doc_id, kind, start, start + length(m) as stop from (
    select doc_id, '{kind}' as kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{
        'm': ms[i], 'v': vs[i],
        'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)}}), recursive := true)
    from (select doc_id, regexp_extract_all(t, $re${pattern}$re$) as ms, regexp_extract_all(t, $re${pattern}$re$, {group}) as vs, regexp_split_to_array(t, $re${pattern}$re$) as gaps from docs)
    where len(ms) > 0
) where length(v) >= {least}"""


KINDS = [kind for kind, _, _ in (*RULES, *ADDED)]
SQL_RULES = [("assign", RULES[0][1].replace("(?ai:", "(?i:"), 1, 8), *((k, p, 1, n) for k, p, n in (*RULES[1:], *ADDED))]
ORDER = "order by start, case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
BASE = ", ".join(f"'{k}'" for k, _, _ in RULES)
SPAN = "concat(kind, ':', start::bigint, ':', stop::bigint)"

ORACLES = {
    "op7_secrets": f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(spans_sql(*rule) for rule in SQL_RULES)}),
grouped as (
    select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
        string_agg({SPAN}, ',' {ORDER}) filter (kind in ({BASE})) as base, string_agg({SPAN}, ',' {ORDER}) as spans
    from found group by doc_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join grouped using (doc_id)
"""
}
