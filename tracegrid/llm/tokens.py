"""Token counts of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.runtime import columns_named

#: Folder of the public vocabulary files; a parameter of every operator that counts tokens.
TOKENIZERS = os.environ.get("TRACEGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The tokenizer, loaded once per process."""
    import tiktoken

    path = os.path.join(folder, vocabulary)
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_chars, tokens) of each document's whole text; 0 tokens for a NULL or empty text.

    Texts go to the tokenizer in Arrow batches and stay on their executor; strings
    that look like special tokens are ordinary text.
    """

    @F.pandas_udf("struct<n_chars:bigint,tokens:bigint>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, vocabulary)
        for texts in batches:
            yield pd.DataFrame([(len(x), len(enc.encode_ordinary(x))) if isinstance(x, str) else (0, 0) for x in texts], columns=["n_chars", "tokens"])

    d = columns_named(documents, *dict.fromkeys([*keep, "text"])).withColumn("__t", count(F.col("text")))
    return d.select(*keep, F.col("__t.n_chars").alias("n_chars"), F.col("__t.tokens").alias("tokens"))
