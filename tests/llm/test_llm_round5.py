"""Ids of many texts at once, for packing."""

import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers

from tessera.llm import bpe, packing

PARTS = [
    " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "​", "a", "the", "'s", "'", "don't", "É", "é", "1", "12", "½", "!", "...", ",", "%%%", "_", "-", "`", "~",
    "<|endoftext|>", "<|endo", "\U0001f600", "中文", "x" * 70, "ب", "ǅ", "ª", "²",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_json(P.path("byte_bpe_50k.json"))


def numbers(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def test_batches_of_pre_tokens(vocabulary):
    """Each pre-token has the ids that it has alone, at lengths of one column, of several, and of none."""
    ids, merges, _ = vocabulary
    r, alone, batch = random.Random(3), bpe.Merger(ids, merges), bpe.BatchMerger(ids, merges)
    some = [bytes(r.choice(b"ab c\xc3\xa9theoun\n") for _ in range(r.randint(1, 90))) for _ in range(4000)] + [b"a" * n for n in range(1, 300)] + [bytes((b,)) for b in range(256)]
    assert batch(some) == [numbers(alone(w)) for w in some] and batch([]) == []
    bare = bpe.BatchMerger(ids, {})
    assert bare([b"the"]) == [numbers([ids[b"t"], ids[b"h"], ids[b"e"]])]


@pytest.mark.parametrize(("most_known", "most_chars"), [(300_000, 4 << 20), (50, 4 << 20), (300_000, 5)])
def test_ids_of_texts(vocabulary, most_known, most_chars):
    """The library's ids, whatever stands beside a space, and whatever was met in calls before."""
    library, r = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(7)
    some = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(4000)] + ["", " ", "  ", "a ", " a", "a" * 3000, "9" * 300 + " " + "ab" * 200 + " b"]
    encode = packing.id_bytes(*vocabulary, most_known=most_known, most_chars=most_chars)
    for at in range(0, len(some), 500):
        part = some[at : at + 500]
        assert encode(part) == [numbers(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
    assert encode([]) == []


def test_new_words_cost_less_than_merging_each(vocabulary):
    """Texts of words that are all different take less than merging one word after another, which packing did before."""
    r, (ids, merges, added) = random.Random(5), vocabulary
    words = list({"".join(r.choice(["er", "un", "the", "ou", "in", "ach", "st"]) for _ in range(r.randint(3, 6))) for _ in range(60_000)})
    encode, alone = packing.id_bytes(ids, merges, added), bpe.Merger(ids, merges)
    encode(["a b"])
    at = time.thread_time()
    got = b"".join(encode([" " + " ".join(words)]))
    batch, at = time.thread_time() - at, time.thread_time()
    want = b"".join(numbers(alone((" " + w).encode())) for w in words)
    assert got == want and batch < 0.85 * (time.thread_time() - at)
