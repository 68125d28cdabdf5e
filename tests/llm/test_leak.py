"""Leaks: both ways of looking against a plain scan, and removal."""

import random

import pytest
from pyspark.sql import functions as F

from verbatrix.llm.leak import find_leaks, remove_leaks, words


def plain(docs, items, n=10):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            k = min(n, len(v))
            if k and {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} & {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}:
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def tables(spark, words):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 9, 10, 14, 30])))) for i in range(30)] + [(30, None), (31, ""), (32, "?! …"), (33, "Été À-1")]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)] + [(40, None), (41, ""), (42, "x ÉTÉ, à 1 y"), (42, "x ÉTÉ, à 1 y")]
    for i in range(20):
        x = items[rng.randrange(30)][1].upper().split()
        docs.append((50 + i, " ".join(rng.choices(words, k=10)) + "; " + ", ".join(x[: rng.choice([5, 10, 30])]) + "."))
    return docs, items


def test_both_ways(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("gram", F.lit(1)).withColumn("doc", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit(1))
    want = plain(docs, items)
    assert {tuple(r) for r in find_leaks(d, i).collect()} == want and len(want) > 20
    assert sorted(tuple(r) for r in find_leaks(d, i, broadcast_words=0).collect()) == sorted(want)
    assert find_leaks(d.limit(0), i).count() == find_leaks(d, i.limit(0)).count() == 0
    kept = remove_leaks(d, i, spans=False)
    assert {r["doc_id"] for r in kept.collect()} == {x for x, _ in docs} - {x for x, _ in want}
    clean = remove_leaks(d, i)
    assert clean.columns == d.columns and clean.count() == len(docs)
    assert sorted(map(str, remove_leaks(d, i, broadcast_words=0).collect())) == sorted(map(str, clean.collect()))
    assert plain([(r["doc_id"], r["text"]) for r in clean.collect() if r["doc_id"] == 42], items) == set()
    assert {r["text"] for r in clean.filter("doc_id = 42").collect()} == {"x  y"}


def test_longer_in_lower_case(spark):
    """Only the span goes where lower-casing makes the text longer."""
    docs = spark.createDataFrame([(1, "İİ before, ONE TWO three; after İ"), (2, "of İ two"), (3, "ΣΑΣ İ, one two three")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "of İ")], "item_id bigint, text string")
    for words in (0, 100):
        got = {r["doc_id"]: r["text"] for r in remove_leaks(docs, items, broadcast_words=words).collect()}
        assert got == {1: "İİ before, ; after İ", 2: " two", 3: "ΣΑΣ İ, "}
