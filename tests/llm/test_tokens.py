import os

import pytest

from vertexloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


def test_sizes(spark):
    docs = [(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "ß€😀 né"), (6, "a" * 200_000), (7, " " * 200_000), (8, "word " * 50_000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(df, ["doc_id"]).collect()}
    enc = tokens.encoder(tokens.VOCABULARY)
    assert got[1] == len(enc.encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] > 1
    assert got[8] == len(enc.encode_ordinary("word " * 50_000))
    assert 0 < got[6] < 200_000 and got[7] > 0
    assert tokens.sized(df.limit(0), ["doc_id"]).count() == 0

