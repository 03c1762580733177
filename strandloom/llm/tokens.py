"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strandloom.workspace import ship_package

FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, key: str, text: str, path: str = f"{FOLDER}/{VOCABULARY}") -> DataFrame:
    """key, n_tokens of every row; a null text has no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": [len(encode(t)) if t else 0 for t in b["text"]]})

    ship_package(documents.sparkSession)
    chosen = documents.selectExpr(f"`{key}`", f"`{text}` as text")
    kind = chosen.schema[key].dataType.simpleString()
    return chosen.mapInPandas(count, f"`{key}` {kind}, n_tokens bigint")
