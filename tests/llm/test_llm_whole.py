"""Statistics, fingerprints, verdicts, archives and the whole pipeline against plain versions, and on odd rows."""

import base64
import hashlib
import math
import random
import statistics
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers
import xxhash
from brute import WORDS, components, rules
from oracle import views
from test_llm_operators import documents, one_permutation
import corpus_pipeline
from tessera.llm import bpe, fingerprint, packing, quality, tokenize, warc
from tessera.llm.common import held_out, shared_dir, table

PIECES = ["a", "the", "The", "USA", "É", "日本", "1", "23", "! ", "|", "#", ". ", ", ", " ", " ", " ", "\n", "\n\n", "\t", "same same ", "one two three four five "]


def plain_features(text):
    """The 19 statistics, each by its own definition."""
    w, lines = WORDS(text), text.split("\n")
    chars, n = len(text) or 1, len(w) or 1
    count = lambda some: sum(c in some for c in text)
    n_words, word_chars, symbols, dup_lines, repeats = rules(text)
    most = max((w.count(x) for x in set(w)), default=0)
    return [
        np.log1p(len(text)), np.log1p(n_words), word_chars / n, max((len(x) for x in w), default=0), len(set(w)) / n, most / n, symbols / chars, count("|") / chars,
        count("!") / chars, count("0123456789") / chars, count(".") / n, count(",") / n, sum(x.isupper() for x in w) / n, sum(a == b for a, b in zip(w, w[1:])) / n, len(lines) / n,
        dup_lines / len(lines), n_words / len(lines), sum(len(c.encode()) - 1 for c in text) / chars, repeats / n,
    ]


def test_statistics_of_texts(sf_dir):
    r = random.Random(1)
    some = ["", " ", "\n", "one"] + ["".join(r.choice(PIECES) for _ in range(r.randint(0, 120))) for _ in range(400)] + [t for _, t in documents(sf_dir)][:60]
    for t in some:
        assert quality.features(t) == pytest.approx(plain_features(t)), t
    assert len(quality.FEATURES) == len(plain_features("x"))


def test_scores_of_documents(spark, sf_dir):
    """op3's score of each document is what the fitted trees give for its plain statistics, one tree after the other."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_classifier(docs, labels)
    got = {r.doc_id: r for r in quality.op3_quality(spark, sf_dir).collect()}
    for d, t in documents(sf_dir):
        assert got[d].predicted == int(got[d].score >= 0.3) and 0 <= got[d].score <= 1
        total, x = model.base, plain_features(t)
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (x[f[at]] > c[at])
            total += leaf[at - len(f)]
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_verdicts_of_documents(spark, sf_dir):
    """op9's kept, tree by tree over plain counts."""
    forest = quality.fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    got = {r.doc_id: r.kept for r in quality.op9_quality_rules(spark, sf_dir).collect()}
    for d, t in documents(sf_dir):
        n, *rest = rules(t)
        row, paths = [x / max(1, n) for x in rest], []
        for f, c, p in zip(forest.feature, forest.cut, forest.path):
            at = 0
            while f[at] >= 0:
                at = 2 * at + 1 + (row[f[at]] > c[at])
            paths.append(p[at])
        score = 2 ** (-statistics.fmean(paths) / forest.scale) if paths else 0.0
        assert got[d] == (n >= 10 and 100 * rest[3] <= 20 * n and score <= forest.threshold + 1e-12)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_hashes(text):
    """Spark's hash of each word, and of each run of five hashes."""
    word = [xxhash.xxh64(w.encode(), 42).intdigest() for w in WORDS(text or "")]

    def chain(run):
        seed = 42
        for x in run:
            seed = xxhash.xxh64(x.to_bytes(8, "little"), seed).intdigest()
        return signed(seed)

    return [chain(word[i : i + 5]) for i in range(len(word) - 4)] if len(word) >= 5 else [chain(word)] if word else []


def test_fingerprints_from_texts(spark, sf_dir):
    """Both fingerprints from the texts themselves, and both likenesses, in plain Python."""
    def like(a, b):
        if not a or not b:
            return float(a == b)
        return 1.0 if a == b else max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))

    docs = sorted(documents(sf_dir), reverse=True)
    got = {r.doc_id: r for r in fingerprint.op8_fingerprints(spark, sf_dir).collect()}
    prints = {d: one_permutation(plain_hashes(t)) for d, t in docs}
    for (d, t), (e, after) in zip(docs, docs[1:] + docs[:1]):
        edited = one_permutation(plain_hashes(t[: len(t) - len(t) // 2] + after[: len(t) // 2]))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (prints[d], edited)
        assert got[d].near_edited == pytest.approx(like(prints[d], edited)) and got[d].near_next == pytest.approx(like(prints[d], prints[e]))


def test_archives_of_long_and_clashing_pages(spark):
    """Payloads of megabytes that hold the magic often, and one page_id with two payloads."""
    magic = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc"
    long = "x" * 1_000_000 + magic * 500 + "é" * 500_000 + magic
    rows = [(1, "u", long), (2, "u", "short"), (2, "v", "other"), (3, "w", long), (2, "u", "short"), (4, None, magic)]
    path = shared_dir(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = sorted((i, len(t.encode()), digest(t), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, t in rows)
    got = warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


CLASHES = "doc_id long, text string, n_tokens string, row string, start string, ids string, n_bytes string"


def test_columns_named_like_results(spark):
    docs = spark.createDataFrame([(1, "some text", *"abcde"), (1, "some text", *"abcde"), (2, None, *"abcde")], CLASHES)
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = len(library.encode("some text", add_special_tokens=False).ids)
    ranks = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted(r.n_tokens for r in tokenize.round_trip(docs, P.path("byte_bpe_50k.tiktoken")).collect()) == [0, *[len(ranks.encode_ordinary("some text"))] * 2]
    assert sorted(r.n_tokens for r in tokenize.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()) == [0, n, n]
    assert sorted(r.doc_tokens for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect()) == [1, n + 1, n + 1]


def through(spark, docs, sf_dir):
    """The pipeline's stages, each on what the one before kept."""
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/{name.replace(' ', '_')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_pipeline_on_odd_and_no_rows(spark, sf_dir):
    """Null, empty and repeated texts, rows that repeat an id or have none: a document with nothing wrong comes through once."""
    docs = table(spark, sf_dir, "documents")
    labels = dict(views(sf_dir).sql("select doc_id, quality from labels").fetchall())
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    good = [r for r in docs.orderBy("doc_id").collect() if labels.get(r.doc_id) == 1 and 400 < r.n_chars < 4000 and learnt(r.doc_id)]
    one_each = {i for _, _, i in components([(r.doc_id, r.text) for r in good], 5, 80)}
    clean = [r for r in good if r.doc_id in one_each][:6]
    rows = [tuple(r) for r in clean] + [tuple(clean[0])] * 2  # a row three times
    place = docs.columns.index
    odd = []
    for change in ({"text": None}, {"text": ""}, {"text": " \n"}, {"doc_id": None}, {"lang": None, "source": None, "n_chars": None, "doc_id": 10**9}):
        row = list(clean[1])
        for k, v in change.items():
            row[place(k)] = v
        odd.append(tuple(row))
    got = through(spark, spark.createDataFrame(rows + odd, docs.schema), sf_dir).collect()
    begun = [r.doc_id for r in got if r.start == 0]
    assert sorted(i for i in begun if i is not None) == sorted(r.doc_id for r in clean) and begun.count(None) == 1
    assert through(spark, docs.where("doc_id < 0"), sf_dir).collect() == []


def test_held_out_fold(spark):
    got = spark.range(300).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)
    assert not spark.sql("select cast(null as long) as id").select(held_out("id")).first()[0]
