"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import pick, spread

# Fixed value: the pattern that cuts text into the pieces this vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """Path of the installed byte-level vocabulary; pass another to use that."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, over the whole text; null and empty texts have 0 tokens."""
    path = vocabulary or default_vocabulary()
    docs = pick(docs, doc_id, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b["t"]]
            yield pa.RecordBatch.from_arrays([b["d"], pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return spread(docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t"))).mapInArrow(count, "doc_id long, n_tokens long")
