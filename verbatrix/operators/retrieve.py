"""The dense arm: resolution of a question against keys, values and aliases, a coarse prefilter for large pools, and currency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import gaussian, unit_rows
from ..schema import DEFAULTS, Params
from .log import alias_parents, distinct_log, live_rows, standing_edges


def cosines(rows: DataFrame, q: np.ndarray, columns: dict[str, str]) -> DataFrame:
    """rows with, for each vector column, the cosine with q under the given name (null for null vectors, 0 for zero ones)."""
    q = unit_rows(np.asarray(q, np.float64))

    for column, name in columns.items():
        length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        weights = F.array(*[F.lit(float(x)) for x in q])
        d = F.aggregate(F.zip_with(column, weights, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn(name, F.when(F.size(column) == len(q), F.when(length > 0, d / length).otherwise(0.0)))
    return rows


def coarse(vectors: DataFrame, dim: int, seed: int, p: Params = DEFAULTS) -> DataFrame:
    """The prefilter's columns pk and pv: a seeded projection of keys and values to fewer dimensions, unit length (zero rows stay
    zero); derived from the vectors, so new rows are an anti join and an append."""
    basis = gaussian(dim, p.prefilter_dim, seed + 2) / np.sqrt(p.prefilter_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c in ("k", "v"):
                x = b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, dim))
                y = unit_rows(x @ basis).astype(np.float32)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, p.prefilter_dim, dtype=np.int32)), pa.array(y.ravel())))
            yield pa.RecordBatch.from_arrays([b.column("store"), b.column("h"), *out], ["store", "h", "pk", "pv"])

    fine = vectors.filter((F.size("k") == dim) & (F.size("v") == dim)).select("store", "h", "k", "v")
    return fine.mapInArrow(run, "store string, h string, pk array<float>, pv array<float>")


def nominated(coarse_rows: DataFrame, q: np.ndarray, dim: int, seed: int, lexical: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(store, h) of the candidates to rescore exactly: the best of each coarse column, and the rows the lexical arm names."""
    qp = unit_rows(np.asarray(q, np.float64) @ (gaussian(dim, p.prefilter_dim, seed + 2) / np.sqrt(p.prefilter_dim)))
    scored = cosines(coarse_rows, qp, {"pk": "ck", "pv": "cv"})
    top = lambda c: scored.orderBy(F.col(c).desc(), "store", "h").limit(p.prefilter_candidates).select("store", "h")
    both = top("ck").unionByName(top("cv"))
    return (both.unionByName(lexical.select("store", "h")) if lexical is not None else both).distinct()


def resolution(log: DataFrame, vectors: DataFrame, q: np.ndarray, candidates: DataFrame | None = None) -> DataFrame:
    """(store, seq, h, res) of live entries: the best cosine of the question with key, value, or the key of an alias. With candidates,
    only those."""
    log = distinct_log(log)
    v = vectors.select("store", "h", "k", "v").dropDuplicates(["store", "h"])
    rows = live_rows(log).select("store", "seq", "h").join(v, ["store", "h"])
    if candidates is not None:
        rows = rows.join(candidates, ["store", "h"], "left_semi")
    own = cosines(rows, q, {"k": "ck", "v": "cv"}).select("store", "seq", "h", F.greatest("ck", "cv").alias("res"))
    alias = log.filter("kind = 'alias'").select("store", F.col("seq").alias("alias_seq"), "h").join(v.select("store", "h", "k"), ["store", "h"]).drop("h")
    alias = cosines(alias.join(alias_parents(log), ["store", "alias_seq"]), q, {"k": "ca"}).groupBy("store", F.col("parent_seq").alias("seq")).agg(F.max("ca").alias("ca"))
    return own.join(alias, ["store", "seq"], "left").select("store", "seq", "h", F.greatest("res", "ca").alias("res")).filter("res is not null")


def families(log: DataFrame) -> DataFrame:
    """(store, family, seq, h): the live rows that compete to be current, by topic (two rows or more) or along a displacement."""
    log = distinct_log(log)
    rows = live_rows(log).select("store", "seq", "h", "topic")
    topical = rows.filter(F.coalesce("topic", F.lit("")) != "")
    many = topical.groupBy("store", "topic").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    same = topical.join(many, ["store", "topic"]).select("store", F.concat(F.lit("t"), "topic").alias("family"), "seq", "h")
    e = standing_edges(log, known=True)
    pair = e.select("store", F.concat_ws(":", F.lit("e"), "seq", "target_seq").alias("family"), F.explode(F.array(F.struct("seq", "h"), F.struct(F.col("target_seq").alias("seq"), F.col("target_h").alias("h")))).alias("x"))
    return same.unionByName(pair.select("store", "family", "x.seq", "x.h"))


def currency(log: DataFrame, vectors: DataFrame, states: DataFrame, store_batch_bytes: int = 128 << 20) -> DataFrame:
    """(store, seq, currency) of rows in a family: what the state says of the row's value at its key, relative to the family's best; the least
    over its families. Rows in none are 1 by definition and not listed. States are broadcast in batches of stores of bounded size."""
    fam = families(log)
    rows = fam.select("store", "seq", "h").distinct().join(vectors.select("store", "h", "k", "v").dropDuplicates(["store", "h"]), ["store", "h"])
    sizes = [(r["store"], 8 * r["dim"] ** 2) for r in states.select("store", "dim").collect()]
    batches: list[list[str]] = [[]]
    room = store_batch_bytes
    for name, size in sorted(sizes):
        if batches[-1] and size > room:
            batches.append([])
            room = store_batch_bytes
        batches[-1].append(name)
        room -= size
    agree = None
    for names in batches:
        some = {r["store"]: np.array(r["s"]).reshape(r["dim"], r["dim"]) for r in states.filter(F.col("store").isin(names)).select("store", "dim", "s").collect()}
        shared = log.sparkSession.sparkContext.broadcast(some)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in it:
                src, out = b.column("store").to_pylist(), np.full(b.num_rows, np.nan)
                ks, vs = b.column("k").to_pylist(), b.column("v").to_pylist()
                for s in set(src):
                    m = shared.value[s]
                    at = [i for i, x in enumerate(src) if x == s and len(ks[i]) == len(m) == len(vs[i])]
                    if at:
                        k, v = unit_rows(np.array([ks[i] for i in at])), unit_rows(np.array([vs[i] for i in at]))
                        out[at] = np.maximum(np.einsum("ij,ij->i", k @ m.T, v), 1e-6)
                yield pa.RecordBatch.from_arrays([b.column("store"), b.column("seq"), pa.array(out)], ["store", "seq", "agree"])

        part = rows.filter(F.col("store").isin(names) & F.col("k").isNotNull() & F.col("v").isNotNull()).select("store", "seq", "k", "v").mapInArrow(run, "store string, seq bigint, agree double")
        agree = part if agree is None else agree.unionByName(part)
    with_agree = fam.join(agree.filter(~F.isnan("agree")), ["store", "seq"])
    best = with_agree.groupBy("store", "family").agg(F.max("agree").alias("best"))
    return with_agree.join(best, ["store", "family"]).groupBy("store", "seq").agg(F.min(F.col("agree") / F.col("best")).alias("currency"))
