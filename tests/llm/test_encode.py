"""Encoding: equal to the tokenizer on whole texts, and an exact round trip; chunks of any size are stitched to the same ids."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    return E.encoding(open(E.DEFAULT_VOCABULARY, "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab'lsre 12\n\t é漢😀.-", max_size=200), st.integers(3, 40), st.integers(4, 20))
def test_stitched_is_whole(t, step, overlap):
    enc = E.encoding(open(E.DEFAULT_VOCABULARY, "rb").read())
    parts = []
    for at in range(0, len(t), step):
        text = t[at : at + step + overlap]
        bounds, ids, count = E.chunk_tokens(text, at + step + overlap >= len(t), enc)
        parts.append({"at": at, "text": text, "bounds": bounds, "ids": ids, "count": count})
    if parts:
        assert E.stitch(parts, enc) == enc.encode_ordinary(t)


def test_table(spark, enc):
    texts = [None, "", " ", "a<|endoftext|>b", "x" * 3000, ("lorem ipsum, don't " * 400), "漢字かな交じり文。" * 300, "été 😀\n\n  x", "a\x00b"]
    df = spark.createDataFrame([(i % 8, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("at", F.lit(2))
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encode_corpus(df, chunk=500, overlap=60).collect())
    assert got == sorted((i % 8, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    for t in texts:
        assert E.decode(enc.encode_ordinary(t or "")) == (t or "")
    assert E.encode_corpus(df.limit(0)).count() == 0
