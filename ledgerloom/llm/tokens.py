"""Token counts by a public byte-level BPE tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rank file: one base64 token and its rank per line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-splitting pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_LOADED: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file, loaded once per worker."""
    import base64

    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_tokens(df: DataFrame, text: str = "text", out: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """Adds the number of tokens of each text; null for null, 0 for an empty text. Whole texts are encoded."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sys

        held = getattr(sys, "_token_encodings", None)  # survives the unpickling of this function for each task
        if held is None:
            held = sys._token_encodings = {}
        if path not in held:
            held[path] = encoding(path)
        enc = held[path]
        for batch in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in batch], dtype="Int32")

    return df.withColumn(out, F.pandas_udf(count, "int")(text))
