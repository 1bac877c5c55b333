"""Nulls, empty and long texts, repeated rows, ties, empty tables and columns of clashing names, for every operator."""

import public_tokenizers as P
import pytest

from tessera.llm import fingerprint, ngram_join, packing, pii, quality, secrets, tokenize, warc
from tessera.llm.common import shared_dir

LONG = " ".join(f"word{i % 997} the" for i in range(6_000))
ROWS = [
    (1, None, "x", 1), (2, "", None, 2), (3, " \n\t", "y", None), (4, "one two three four five six seven eight nine ten eleven.", "x", 1),
    (4, "one two three four five six seven eight nine ten eleven.", "x", 1), (5, LONG, "x", 3), (6, LONG, "x", 3), (None, "no id a@b.co", "z", 4), (7, "9" * 40_000, "n", 0), (8, "a" * 40_000 + "@", "n", 0),
]
#: Names that operators use for their results or inside.
SCHEMA = "doc_id long, text string, label string, score int"
LABELS = "doc_id long, quality int, toxic int"

OPERATORS = {
    "encode": lambda d, s: tokenize.round_trip(d, P.path("byte_bpe_50k.tiktoken")),
    "count": lambda d, s: tokenize.count_tokens(d, P.path("byte_bpe_50k.json")),
    "classify": lambda d, s: quality.classify(d, s.createDataFrame([(1, 1, 0), (4, 1, None), (4, 0, 0), (None, 1, 0), (2, None, 0), (5, 0, 0)], LABELS)),
    "rules": lambda d, s: quality.apply_rules(d, s.createDataFrame([(4, 1, 0), (5, 0, 0)], LABELS)),
    "personal": lambda d, s: pii.find_personal(d),
    "similar": lambda d, s: ngram_join.similar_documents(d),
    "secrets": lambda d, s: secrets.scan(d),
    "fingerprints": lambda d, s: fingerprint.fingerprints(d),
    "redact": lambda d, s: pii.redact(d),
    "keep quality": lambda d, s: quality.keep_quality(d, s.createDataFrame([], LABELS)),
    "keep rules": lambda d, s: quality.keep_by_rules(d, s.createDataFrame([], LABELS)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = OPERATORS[name](docs, spark).collect()
    if name == "keep rules":
        assert {r.doc_id for r in got} == {4}  # the others have too few words or repeat themselves
    else:
        assert len(got) == len(ROWS)
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](docs.where("doc_id > 99"), spark).collect() == []


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(r.doc_tokens == 1 for r in got) == 2 and sum(r.doc_id == 4 for r in got) == 2
    assert packing.pack(docs.where("doc_id > 99"), P.path("byte_bpe_50k.json")).collect() == []


def test_keep_one_keeps_a_row_of_each_group(spark):
    kept = sorted(str(r.doc_id) for r in ngram_join.keep_one(spark.createDataFrame(ROWS, SCHEMA)).collect())
    assert kept == ["1", "2", "3", "4", "5", "7", "8", "None"]


def test_names_inside_are_free(spark):
    """Columns named like those that operators add inside stay as they are."""
    docs = spark.createDataFrame([(1, "a@b.co is mine", 1, 2, 3, 4), (1, "a@b.co is mine", 1, 2, 3, 4)], "doc_id long, text string, extra int, mark int, other int, row int")
    assert [tuple(r) for r in pii.redact(docs).collect()] == [(1, "<EMAIL> is mine", 1, 2, 3, 4)] * 2
    assert [tuple(r) for r in ngram_join.keep_one(docs).collect()] == [(1, "a@b.co is mine", 1, 2, 3, 4)]


def test_known_values(spark):
    rows = {r.doc_id: r for r in ngram_join.similar_documents(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert rows[1].n_shingles == rows[3].n_shingles == 0 and rows[1].component_id == 1 and rows[3].component_id == 3
    assert rows[6].component_id == 5 and rows[7].n_shingles == 1 and rows[None].component_id is None
    prints = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert prints[5].fingerprint == prints[6].fingerprint and prints[6].near_next == 1.0 and prints[1].fingerprint == ""
    assert prints[5].near_next < 0.2  # row 4 follows


def test_archives(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "same", 2), (None, "u", "same", 3)], "page_id long, url string, html string, value int")
    path = shared_dir(spark)
    warc.write_warc(pages, path)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()}
    assert got == {(None, 0, "response", None), (1, 4, "response", None), (None, 4, "revisit", 1)}
    path = shared_dir(spark)
    warc.write_warc(pages.where("value > 9"), path)
    assert warc.read_warc(spark, path).collect() == []
