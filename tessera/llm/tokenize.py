"""Operators 1 and 4: encoding and decoding of texts, and token counts."""

from __future__ import annotations

import hashlib
from itertools import chain

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import each_batch, table, text_of


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row by the ranks in a file that the driver reads.

    A null text is empty and has no ids. Equal rows give equal rows; an empty table gives none.
    Only the two named columns are read, so other columns can't clash.
    """

    def make(ranks):
        encode = encoder(ranks, pattern)
        return lambda doc_ids, texts: (doc_ids, [list(chain.from_iterable(encode(t))) for t in texts])

    kind = docs.schema[id_col].dataType.simpleString()
    return each_batch(docs.select(id_col, text_of(text_col)), make, f"{id_col} {kind}, ids array<int>", ranks=bpe.read_ranks(ranks_path))


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; a null array is empty, invalid UTF-8 becomes U+FFFD."""

    def make(bytes_of):
        return lambda doc_ids, ids: (doc_ids, ["".join(bpe.decode(i or [], bytes_of)) for i in ids])

    kind = encoded.schema[id_col].dataType.simpleString()
    by_id = {i: t for t, i in bpe.read_ranks(ranks_path).items()}
    return each_batch(encoded.select(id_col, ids_col), make, f"{id_col} {kind}, text string", bytes_of=by_id)


def encoder(ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
    """A function from a text to its ids, in a list of tuples."""
    machine = bpe.Transducer(ranks)
    return bpe.Encoder(pattern, lambda t: machine.encode(t.encode())).of(bpe.flat)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids again, and return the count of ids and the two digests.

    A null text is empty: no tokens and the digests of nothing. One row for each row.
    """

    def make(ranks):
        bytes_of, machine = {i: t for t, i in ranks.items()}, bpe.Transducer(ranks)

        def with_decimals(parts):
            ids = bpe.flat(parts)
            return ids, " ".join(map(str, ids))

        encode = bpe.Encoder(pattern, lambda t: machine.encode(t.encode())).of(with_decimals)

        def run(doc_ids, texts):
            counts, hashes, back = [], [], []
            for text in texts:
                parts, decimals = zip(*encode(text)) if text else ((), ())
                ids = list(chain.from_iterable(parts))
                counts.append(len(ids))
                hashes.append(hashlib.sha256(" ".join(decimals).encode()).hexdigest())
                digest = hashlib.sha256()
                for piece in bpe.decode(ids, bytes_of):
                    digest.update(piece.encode())
                back.append(digest.hexdigest())
            return doc_ids, counts, hashes, back

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return each_batch(docs.select(id_col, text_of(text_col)), make, schema, ranks=bpe.read_ranks(ranks_path))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def whole_tokens(ids: dict[bytes, int], merges, pattern: str = public_tokenizers.PATTERN) -> frozenset[str]:
    """The strings of the vocabulary proved to be one pre-token and to encode as one token.

    Each is checked by the pattern and by the merges themselves, so a text's pre-token in this
    set counts as one token without merging.
    """
    import regex

    alone, merge, out = regex.compile(pattern).fullmatch, bpe.Merger(ids, merges), []
    for raw in ids:
        try:
            s = raw.decode()
        except UnicodeDecodeError:
            continue
        if alone(s) and len(merge(raw)) == 1:
            out.append(s)
    return frozenset(out)


def counter(ids, merges, added, whole, pattern: str = public_tokenizers.PATTERN):
    """A function from a text to its number of tokens; strings of added tokens count one each."""
    import regex

    merge = bpe.Merger(ids, merges)

    def tokens(pre: str) -> int:
        return 1 if pre in whole else len(merge(pre.encode()))

    run = bpe.Encoder(pattern, tokens, 600_000).of(sum)
    cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))).split if added else None

    def count(text: str) -> int:
        if not any(a in text for a in added):
            return sum(run(text))
        parts = cut(text)
        return len(parts) - 1 + sum(sum(run(p)) for p in parts)

    return count


def count_tokens(docs: DataFrame, json_path: str, limit: int = 512, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether they are over the limit, for each row.

    A null text is empty and has no tokens. Equal rows give equal rows. The vocabulary and the
    set of whole tokens (both as large as the tokenizer's file) go to the tasks by broadcast.
    """

    def make(ids, merges, added, whole):
        count = counter(ids, merges, added, whole, pattern)

        def run(doc_ids, texts):
            n = [count(t) for t in texts]
            return doc_ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return run

    ids, merges, added = bpe.read_json(json_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return each_batch(docs.select(id_col, text_of(text_col)), make, schema, ids=ids, merges=merges, added=added, whole=whole_tokens(ids, merges, pattern))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op1_bpe": op1_bpe, "op4_token_counts": op4_token_counts}
