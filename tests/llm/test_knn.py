"""Nearest vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F

from verbatrix.llm.knn import Curves, hilbert_keys, nearest

SCHEMA = "space string, id bigint, vec array<float>"


def test_hilbert_is_a_curve():
    n = 8
    cells = np.array([(i, j) for i in range(n) for j in range(n)], np.uint32)
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(n * n))
    path = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)], np.uint32)
    path = cube[np.argsort(hilbert_keys(cube, 2))].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert Curves(4, 2, 16, 3, 1).keys(np.eye(4), 0).shape == (4,)


def brute(ids, x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(x @ x.T, 6)
    out = {}
    for i in range(len(ids)):
        order = sorted((-cos[i, j], ids[j]) for j in range(len(ids)) if j != i and cos[i, j] >= least)
        out[ids[i]] = [(j, -c) for c, j in order[:k]]
    return out


def test_found_and_ranked(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 32))
    x = np.float32(centres[rng.integers(0, 150, 900)] + 0.25 * rng.standard_normal((900, 32)))
    x[100:140] = x[100]  # copies
    x[140:150] = x[100] * 2  # of another length
    ids = list(range(1, 901))
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in zip(ids, x)], SCHEMA).withColumn("key", F.lit(1)).withColumn("same", F.lit("x"))
    got = {}
    for r in nearest(df, 5, 0.7, width=32, block=64, curves=12).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    want = brute(ids, np.float64(x), 5, 0.7)
    pairs = {(i, j) for i, l in want.items() for j, _ in l}
    found = {(i, j) for i, l in got.items() for _, j, _ in l}
    assert len(pairs & found) / len(pairs) >= 0.99
    assert [j for _, j, _ in sorted(got[101])] == [102, 103, 104, 105, 106] and [j for _, j, _ in sorted(got[145])] == [101, 102, 103, 104, 105]
    exact = sum(sorted(got.get(i, [])) == [(n, j, c) for n, (j, c) in enumerate(l, 1)] for i, l in want.items())
    assert exact / len(want) >= 0.98


def test_without_threshold(spark):
    rng = np.random.default_rng(6)
    x = np.float32(rng.standard_normal((300, 8)))
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = nearest(df, 3, width=8, block=64, curves=16).collect()
    want = brute(list(range(300)), np.float64(x), 3, -2)
    hit = sum(r["neighbour"] in {j for j, _ in want[r["id"]]} for r in got)
    assert len(got) == 900 and hit / 900 >= 0.9


def test_unfit_vectors(spark):
    rows = [("s", 1, [1.0, 0.0]), ("s", 2, None), ("s", 3, [0.0, 0.0]), ("s", 4, [1.0]), ("s", 5, [1.0, None]), ("s", 6, [float("nan"), 1.0]), ("s", 7, [2.0, 0.0]), ("t", 1, [1.0, 0.0]), ("s", 8, [float("inf"), 0.0])]
    got = {(r["space"], r["id"], r["neighbour"]) for r in nearest(spark.createDataFrame(rows, SCHEMA), 5, 0.5, width=2).collect()}
    assert got == {("s", 1, 7), ("s", 7, 1)}
    assert nearest(spark.createDataFrame([], SCHEMA), 5, 0.5, width=2).count() == 0


def test_hot_vector(spark):
    df = spark.range(3000).select(F.lit("s").alias("space"), "id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).cast("array<float>").alias("vec"))
    got = nearest(df, 2, 0.9999999, width=2).filter("id % 3 = 0").groupBy("id").agg(F.collect_list("neighbour").alias("n")).collect()
    assert len(got) == 1000 and all(set(r["n"]) <= {0, 3, 6} for r in got)


def test_tight_group(spark):
    """A third of all rows, all different, near one template: exact neighbours, over several tiles."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 32))
    x[::3] = rng.standard_normal(32) + 0.05 * rng.standard_normal((2000, 32))
    x = np.float32(x)
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in nearest(df, 5, 0.85, width=32, block=64, curves=4, tile=300).filter("id % 3 = 0").collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    want = brute(list(range(0, 6000, 3)), np.float64(x[::3]), 5, 0.85)
    hit = sum(len({j for _, j in got.get(i, [])} & {j for j, _ in l}) for i, l in want.items())
    assert len(want) == 2000 and hit / sum(map(len, want.values())) >= 0.999


def test_small_tight_groups(spark):
    """Groups below the size of a crowd, closer together than the rounding to bytes can tell."""
    for size, noise in ((60, 0.002), (100, 0.0005), (300, 0.002)):
        rng = np.random.default_rng(size)
        x = rng.standard_normal((1500, 64))
        x[:size] = rng.standard_normal(64) + noise * rng.standard_normal((size, 64))
        x = np.float32(x)
        df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
        for least in (0.85, None):
            got = {}
            for r in nearest(df, 5, least, curves=8).filter(f"id < {size}").collect():
                got.setdefault(r["id"], set()).add(r["neighbour"])
            want = brute(list(range(1500)), np.float64(x), 5, 0.85)
            hit = sum(len(got[i] & {j for j, _ in want[i]}) for i in range(size))
            assert hit / (5 * size) >= 0.99
