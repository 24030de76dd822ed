"""Sizes in tokens of a public tokenizer, whose file is a parameter and stays outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank file of a byte-level vocabulary, and the pattern that splits text before it.
VOCABULARY = os.environ.get("FOLIOFLOW_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, loaded once per process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of a text; special strings are ordinary text. A null text has 0."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(path)
        for b in batches:
            yield pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in b.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(text)


def split_tokens(df: DataFrame, key: str, text: str, most: int, path: str = VOCABULARY) -> DataFrame:
    """key, part and tokens of the pieces that a text larger than `most` tokens is cut into; all but the last are full."""
    sizes = df.select(F.col(f"`{key}`"), count(F.col(f"`{text}`"), path).alias("tokens"))
    return pieces_of(sizes, key, most)


def pieces_of(sizes: DataFrame, key: str, most: int) -> DataFrame:
    """One row per piece of at most `most` tokens; documents without tokens keep one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / most).cast("int"))
    rows = sizes.select(F.col(f"`{key}`"), "tokens", F.explode(F.sequence(F.lit(1), n)).alias("part"))
    return rows.select(F.col(f"`{key}`"), "part", F.when(F.col("part") * most <= F.col("tokens"), F.lit(most)).otherwise(F.col("tokens") - (F.col("part") - 1) * most).cast("int").alias("tokens"))
