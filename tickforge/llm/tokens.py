"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Vocabulary of a byte-level BPE for many languages, as ranks. A parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE cuts a text into words before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a whole text; null for null, 0 for ''. Once loaded, a worker keeps the vocabulary."""

    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int32")

    return count(text)


def with_sizes(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(keep, n_tokens) of the rows whose text is not null."""
    return df.filter(F.col(text).isNotNull()).select(*keep, token_count(F.col(text), path).alias("n_tokens"))
