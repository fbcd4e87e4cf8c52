"""Sizes in tokens of a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank file; ``VERTEXLOOM_TOKENIZER`` names another.
VOCABULARY = os.environ.get("VERTEXLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# The pattern that splits text before the merges: fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(enc, text: str | None) -> int:
    return len(enc.encode_ordinary(text or ""))


def _sizer(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for b in batches:
            enc = enc or encoder(vocabulary)
            texts = b.column(b.num_columns - 1)
            sizes = np.fromiter((count(enc, t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes)], names=[*b.schema.names[:-1], "n_tokens"])

    return run


def sized(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens LONG`` of every row; NULL and empty texts have 0 tokens. The text itself is dropped."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + ", n_tokens long"
    return rows.mapInArrow(_sizer(vocabulary), schema)
