"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this public vocabulary splits a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for a null or empty one. Special tokens' names in a text are plain text.

    ``vocabulary`` is the path of a rank file that every executor can read; it is loaded once a worker.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for texts in batches:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    return count(text)
