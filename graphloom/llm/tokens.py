"""The tokenizer that the operators share: byte-level BPE ranks from a file, which is a parameter."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, slices, texts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of this vocabulary: contractions, then words, numbers and signs with the space before them, then white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(4)
def encoding(path: str = VOCABULARY):
    """One encoder a process and file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) for each row of docs; a null or empty text has 0."""

    def count(batches):
        encode = encoding(path).encode_ordinary
        for piece in slices(batches, "text"):
            n = [len(encode(x)) if x else 0 for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return arrow(texts(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")), count, "doc_id bigint, tokens bigint")
