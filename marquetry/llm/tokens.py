"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE; the path is a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, key: str, text: str, keep: list[str] | None = None, path: str = TOKENIZER) -> DataFrame:
    """(``key``, ``keep``..., tokens): the whole text's number of tokens; null and empty texts have none."""
    keep = keep or []
    rows = documents.select(F.col(key).alias(key), *keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if isinstance(t, str) else 0 for t in b["__text"]]
            yield b.drop(columns="__text").assign(tokens=sizes)

    return rows.mapInPandas(run, f"{fields}, tokens long")
