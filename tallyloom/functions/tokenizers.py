"""Exact token counts by a vocabulary file, an Arrow batch at a time; without one, character estimates."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.functions.tokens import char_estimate

_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def count_tokens(text: Column, path: str | None, pattern: str = "", normalise: bool = False) -> Column:
    """Tokens of a text by the rank file at ``path``; falls back to the estimate where there is no such file.

    ``normalise`` applies NFKC first.
    """
    if not path or not os.path.exists(path):
        return char_estimate(F.length(text))

    @pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        encoding = _encoding(path, pattern)
        plain = (unicodedata.normalize("NFKC", t) if normalise else t for t in texts.fillna(""))
        return pd.Series([len(encoding.encode_ordinary(t)) for t in plain], dtype="int64")

    return run(text)


def encode_tokens(text: Column, path: str, pattern: str, normalise: bool = False) -> Column:
    """Token ids of a text; ``normalise`` applies NFKC first, as one family of tokenizers does."""

    @pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        import unicodedata

        encoding = _encoding(path, pattern)
        return pd.Series([encoding.encode_ordinary(unicodedata.normalize("NFKC", t) if normalise else t) for t in texts.fillna("")])

    return run(text)


def decode_tokens(ids: Column, path: str, pattern: str) -> Column:
    """The text of token ids; bytes that aren't UTF-8 become replacement characters."""

    @pandas_udf("string")
    def run(held: pd.Series) -> pd.Series:
        encoding = _encoding(path, pattern)
        return pd.Series([encoding.decode([int(i) for i in x]) if x is not None else None for x in held])

    return run(ids)


def truncate_tokens(text: Column, limit: int, path: str, pattern: str, normalise: bool = False) -> Column:
    """The text of the first ``limit`` tokens."""
    return decode_tokens(F.slice(encode_tokens(text, path, pattern, normalise), 1, max(0, limit)), path, pattern)
