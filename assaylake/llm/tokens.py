"""Token counts by a public byte-pair vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.common import col

#: Folder with the vocabulary files; every executor must have it.
TOKENIZERS = os.environ.get("ASSAYLAKE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary and cuts a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts the tokens of a text; special tokens in a text are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def with_token_counts(df: DataFrame, row_id: str, text: str, *keep: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row id, keep..., n_tokens) of every row; NULL and empty texts have 0 tokens. Texts are read whole."""
    types = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(col(row_id).alias("id"), *[col(c).alias(a) for c, a in zip(keep, names, strict=True)], col(text).alias("text"))
    schema = ", ".join([f"id {types[row_id]}", *[f"{a} {types[c]}" for c, a in zip(keep, names, strict=True)], "n bigint"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(folder, vocabulary)
        for pdf in batches:
            pdf["n"] = [count(t) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pdf.drop(columns="text")

    out = rows.mapInPandas(run, schema)
    return out.select(F.col("id").alias(row_id), *[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], F.col("n").alias("n_tokens"))
