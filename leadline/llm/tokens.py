"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the rank file of a byte-level BPE lies; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(tokenizer)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    # Marked so that a filter on the number does not count every text twice.
    return count.asNondeterministic()(text)
