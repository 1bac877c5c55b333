"""Full-text functions: an identifier-aware tokenizer, stems, search vectors, web-search queries and cover density.

Tokens are runs of a-z and 0-9 after lower-casing, so identifiers split at _ and dots. A search
vector holds the stems of all tokens but stop words with their places, made once and stored beside
its row. Weights and cover density follow the public description of PostgreSQL's ts_rank_cd.
All of it is built-in functions.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import english

#: The weights of the fields A, B, C and D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

#: Words that are no lexemes.
STOP = (
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its me my "
    "no nor not of off on or our out over own she should so some such than that the their them then there these they this "
    "those to too under until up very was we were what when where which while who whom why will with would you your"
).split()
#: Suffix rules in their order: plurals, participles, a final e. Patterns mean the same to Java and RE2.
STEM = ((r"(ss|x|ch|sh|z)es$", r"$1"), (r"ie[sd]$", "y"), (r"([^aious])s$", r"$1"), (r"^([a-z0-9]*[aeiouy][a-z0-9]+)(ing|ed)$", r"$1"), (r"([a-z0-9][a-z0-9])e$", r"$1"))
RULES = [(re.compile(pattern), kept.replace("$1", r"\1")) for pattern, kept in STEM]
VECTOR = "array<struct<lexeme:string,at:int,letter:string>>"


def stem(word: Column) -> Column:
    changed = reduce(lambda w, rule: F.regexp_replace(w, *rule), STEM, word)
    return F.when(F.right(word, F.lit(1)).isin("s", "d", "g", "e"), changed).otherwise(word)  # no rule changes others


def stem_of(word: str) -> str:
    """stem() of one word."""
    return reduce(lambda w, rule: rule[0].sub(rule[1], w), RULES, word) if word[-1:] in ("s", "d", "g", "e") else word


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def parse_query(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-search query as alternatives of (negated, phrase) terms that must all hold.

    Words are ANDed, quotes make phrases, `or` starts an alternative, a leading - negates.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            out.append([])
            continue
        phrase = re.findall("[a-z0-9]+", quoted or word)
        if phrase:
            out[-1].append((bool(minus), phrase))
    return [x for x in out if x]


def matches(words: Column, query: str) -> Column:
    """Whether an array of tokens answers a query; false for one without terms."""
    def has(phrase: list[str]) -> Column:
        if len(phrase) == 1:
            return F.array_contains(words, phrase[0])
        padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return F.contains(padded, F.lit(f" {' '.join(phrase)} "))

    out = F.lit(False)
    for terms in parse_query(query):
        every = F.lit(True)
        for negated, phrase in terms:
            every = every & (~has(phrase) if negated else has(phrase))
        out = out | every
    return out


def search_vector(fields: dict[str, Column], query: str | None = None) -> Column:
    """(lexeme, at, letter) of all tokens of the fields by weight letter, places running on from field to field; stop words leave a gap.

    With a query, only tokens that begin as its stems do: enough to answer and rank that query.
    """
    begun = None if query is None else "^(" + "|".join(sorted({w[:-1] for terms in lexemes(query) for _, phrase in terms for _, w in phrase})) + ")"

    def placed(words: Column, letter: str, before: Column) -> Column:
        each = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), (before + i).alias("at"), F.lit(letter).alias("letter")))
        return each if begun is None else F.filter(each, lambda x: F.rlike(x["lexeme"], F.lit(begun)))

    split = F.struct(*(tokens(text).alias(letter) for letter, text in fields.items()))

    def vector(words: Column) -> Column:
        parts, before = [], F.lit(0)
        for letter in fields:
            parts.append(placed(words[letter], letter, before))
            before = before + F.size(words[letter])
        kept = F.filter(F.concat(*parts), lambda x: ~x["lexeme"].isin(STOP))
        return F.transform(kept, lambda x: F.struct(stem(x["lexeme"]).alias("lexeme"), x["at"].alias("at"), x["letter"].alias("letter")))

    return F.get(F.transform(F.array(split), vector), F.lit(0)).cast(VECTOR)


#: Stemmers by name: the suffix rules above, which SQL can express, and Porter2 for English.
STEMMERS = {"rules": stem_of, "english": english.stem}


def lexemes(query: str, stemmer: str = "rules") -> list[list[tuple[bool, list[tuple[int, str]]]]]:
    """parse_query() with stems and their places in a phrase; stop words are no terms, and alternatives without terms none."""
    out = []
    for terms in parse_query(query):
        kept = [(negated, [(i, STEMMERS[stemmer](w)) for i, w in enumerate(phrase) if w not in STOP]) for negated, phrase in terms]
        out.append([t for t in kept if t[1]])
    return [x for x in out if x]


def may_answer(texts: list[Column], query: str) -> Column:
    """Whether texts may answer a query, by plain substrings: a token begins as its stem does, but for the stem's last letter."""
    every = [[w[:-1] for negated, phrase in terms if not negated for _, w in phrase] for terms in lexemes(query)]
    low = F.lower(F.concat_ws(" ", *texts))
    held = [reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words], F.lit(True)) for words in every]
    return reduce(Column.__or__, held, F.lit(False))


def answers(vector: Column, query: str, stemmer: str = "rules") -> Column:
    """Whether a search vector answers a web-search query; false for one without terms."""

    def has(phrase: list[tuple[int, str]]) -> Column:
        first, word = phrase[0]

        def after(x: Column, i: int, w: str) -> Column:
            return F.exists(vector, lambda y: (y["lexeme"] == w) & (y["at"] == x["at"] + (i - first)))

        def here(x: Column) -> Column:
            return reduce(Column.__and__, [after(x, i, w) for i, w in phrase[1:]], x["lexeme"] == word)

        return F.exists(vector, here)

    every = [reduce(Column.__and__, [~has(p) if negated else has(p) for negated, p in terms]) for terms in lexemes(query, stemmer)]
    return F.coalesce(reduce(Column.__or__, every, F.lit(False)), F.lit(False))


def cover_density(places: list[tuple[int, str, float]], terms: set[str]) -> float:
    """The sum over minimal covers of the terms: terms / sum of 1 / weight, over 1 + the words beside them."""
    found = sorted(p for p in places if p[1] in terms)
    last: dict[str, tuple[int, float]] = {}
    total, begun = 0.0, -1
    for at, term, weight in found:
        last[term] = (at, weight)
        if len(last) == len(terms):
            low = min(p for p, _ in last.values())
            if low > begun:  # a cover that starts where the last one did isn't minimal
                total += len(terms) / sum(1 / w for _, w in last.values()) / (1 + at - low + 1 - len(terms))
                begun = low
    return total


def cover_rank(vector: Column, query: str) -> Column:
    """The cover density of a query's terms in a search vector: one pass over the places of its terms."""
    terms = sorted({w for terms in lexemes(query) for negated, phrase in terms if not negated for _, w in phrase})
    return cover_rank_of(vector, F.array(*map(F.lit, terms))) if terms else F.lit(0.0)


def cover_rank_of(vector: Column, terms: Column) -> Column:
    """cover_rank() for an array of different terms; 0 for an empty one."""
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    none = F.transform(terms, lambda _: F.struct(F.lit(-1).alias("at"), F.lit(1.0).alias("w")))
    start = F.struct(none.alias("last"), F.lit(0.0).alias("total"), F.lit(-1).alias("begun"))

    def step(acc: Column, x: Column) -> Column:
        last = F.zip_with(acc["last"], terms, lambda p, t: F.when(t == x["lexeme"], F.struct(x["at"].alias("at"), weight[x["letter"]].alias("w"))).otherwise(p))

        def added(last: Column) -> Column:
            low = F.array_min(F.transform(last, lambda p: p["at"]))
            worth = F.size(last) / F.aggregate(last, F.lit(0.0), lambda a, p: a + 1 / p["w"]) / (x["at"] - low + 2 - F.size(last))
            fresh = (low >= 0) & (low > acc["begun"])  # a cover that starts where the last one did isn't minimal
            return F.struct(last.alias("last"), F.when(fresh, acc["total"] + worth).otherwise(acc["total"]).alias("total"), F.when(fresh, low).otherwise(acc["begun"]).alias("begun"))

        return F.get(F.transform(F.array(last), added), F.lit(0))

    return F.aggregate(F.filter(vector, lambda x: F.array_contains(terms, x["lexeme"])), start, step)["total"]


#: A parsed query: alternatives of terms, each negated or not, with the places of its phrase.
PARSED = "array<array<struct<negated:boolean,phrase:array<struct<at:int,lexeme:string>>>>>"


def as_parsed(query: str | None, stemmer: str = "rules") -> list:
    """lexemes() of one query, in the form of PARSED."""
    return [[{"negated": negated, "phrase": [{"at": i, "lexeme": w} for i, w in phrase]} for negated, phrase in alt] for alt in lexemes(query or "", stemmer)]


def parsed_queries(query: Column, stemmer: str = "rules") -> Column:
    """lexemes() of a column of queries, as PARSED; empty for null and blank ones."""
    @F.pandas_udf(PARSED)
    def parse(texts: pd.Series) -> pd.Series:
        return pd.Series([as_parsed(t, stemmer) for t in texts])

    return parse(query)


def positive(parsed: Column) -> Column:
    """The different lexemes of a parsed query's terms that aren't negated, in order."""
    words = F.transform(F.flatten(parsed), lambda t: F.when(~t["negated"], t["phrase"]["lexeme"]).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.flatten(words)))


def answers_parsed(vector: Column, parsed: Column) -> Column:
    """answers() for a column of parsed queries."""

    def has(phrase: Column) -> Column:
        first = F.get(phrase, F.lit(0))
        held = lambda x, p: F.exists(vector, lambda y: (y["lexeme"] == p["lexeme"]) & (y["at"] == x["at"] + p["at"] - first["at"]))
        return F.exists(F.filter(vector, lambda x: x["lexeme"] == first["lexeme"]), lambda x: F.forall(phrase, lambda p: held(x, p)))

    return F.exists(parsed, lambda alt: F.forall(alt, lambda t: has(t["phrase"]) != t["negated"]))
