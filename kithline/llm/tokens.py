"""Sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file used unless a path is given: byte-level BPE for many languages.
DEFAULT = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a .tiktoken vocabulary file; one per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Number of tokens of a text; null for null, 0 for ''.

    A text of any length is tokenised whole.
    """
    path = path or default_path()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([None if x is None else len(enc.encode_ordinary(x)) for x in s], dtype="Int32")

    return count(text)
