"""Token counts of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column

from .common import python_udf

#: A rank file in the tiktoken format, and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest text given to the tokenizer at once; longer ones are parted at a line or word end, as its pattern would part them.
PIECE = 1 << 18


def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def length(enc, text: str) -> int:
    """How many tokens ``text`` has.  Long texts go piece by piece, cut only where a letter is followed by one blank."""
    n, at = 0, 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut += 1
        if cut >= len(text) - 1:
            break
        n += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(enc.encode_ordinary(text[at:]))


def _count_batches(batches: Iterator[pd.Series], path: str) -> Iterator[pd.Series]:
    enc = encoding(path)
    for texts in batches:
        yield pd.Series([length(enc, t) if t else 0 for t in texts], dtype="int64")


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Tokens of a text; 0 for null and empty ones.  ``path`` is read by each worker and must exist on every node."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _count_batches(batches, path)

    return python_udf(run, "bigint")(text)
