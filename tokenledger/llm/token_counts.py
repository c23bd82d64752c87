"""Operator 1: token counts of whole texts.

Batch encoding inside an Arrow function that returns lengths only: ids never leave the worker.
Arrow batches are worked off in runs of about ``CHUNK_BYTES`` of UTF-8, and every text is cut at
boundaries that no token crosses, so one very long text is many short calls of the tokenizer; only a
stretch without any such boundary (no blank, no line end) is one call.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each get their own
count; extra columns are kept, a column of the name of a result is replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_runs, sizes
from .tokens import units, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048


def token_count(vocabulary: str = VOCABULARY):
    """An Arrow function from text to its number of tokens, without added special tokens."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tok = units(vocabulary_path(vocabulary))
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            out: list[int] = []
            for lo, hi in byte_runs(sizes(texts)):
                out += [len(b) // 4 for b in tok.ids(texts[lo:hi])]
            yield pa.array(out, pa.int64())

    return count


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    return docs.withColumns(
        {
            "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
            "n_tokens": token_count(vocabulary)(F.col(text)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
