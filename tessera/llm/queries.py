"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import clustering, fim, fingerprint, ngram_join, packing, pii, quality, secrets, sharding, tokenize, warc

QUERIES = {**tokenize.QUERIES, **warc.QUERIES, **quality.QUERIES, **secrets.QUERIES, **fingerprint.QUERIES, **ngram_join.QUERIES, **packing.QUERIES, **pii.QUERIES, **sharding.QUERIES, **clustering.QUERIES, **fim.QUERIES}
ORACLES: dict[str, str] = {**warc.ORACLES, **secrets.ORACLES, **clustering.ORACLES, **fim.ORACLES}
