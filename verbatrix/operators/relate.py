"""The relate hop: what other stores hold near an answer's hits, without the hubs that are near everything."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import unit_rows, without_direction
from ..schema import DEFAULTS, Params

MOST_CANDIDATES = 20_000


def mean_direction(pool: DataFrame, column: str = "k") -> np.ndarray | None:
    """The direction of the sum of all unit vectors of a column: element-wise sums, one row to the driver."""
    from ..functions.vectors import norm

    rows = pool.filter(F.col(column).isNotNull()).select(column, norm(F.col(column)).alias("_l")).filter("_l > 0")
    sums = rows.select(F.posexplode(column).alias("i", "x"), "_l").groupBy("i").agg(F.sum(F.col("x").cast("double") / F.col("_l")).alias("s")).orderBy("i").collect()
    total = np.array([r["s"] for r in sums])
    return total / np.linalg.norm(total) if len(total) and np.linalg.norm(total) > 0 else None


def near_anchors(pool: DataFrame, anchors: list[dict], floor: float, mean: np.ndarray | None) -> DataFrame:
    """(anchor, source, seq, cosine, centred) of the pool's rows (source, seq, v) of other sources with a cosine of at least the
    floor to an anchor ({"source", "v"}, a handful)."""
    a = unit_rows(np.array([x["v"] for x in anchors], np.float64))
    ac = without_direction(a, mean)
    own = np.array([x["source"] for x in anchors], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            cos, centred = x @ a.T, without_direction(x, mean) @ ac.T
            cos[np.array(b.column("source").to_pylist(), object)[:, None] == own[None, :]] = -2
            i, j = np.nonzero(cos >= floor)
            rows = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), b.column("source").take(rows), b.column("seq").take(rows), pa.array(cos[i, j]), pa.array(centred[i, j])], ["anchor", "source", "seq", "cosine", "centred"])

    return pool.select("source", "seq", "v").mapInArrow(run, "anchor int, source string, seq bigint, cosine double, centred double")


def hubness(pool: DataFrame, candidates: DataFrame, mean: np.ndarray | None, k: int = 10) -> DataFrame:
    """(source, seq, hubness): the mean of the k largest centred cosines of a candidate to the other rows of its own source (all
    others if fewer, 0 if none). candidates: source, seq, v. They are broadcast MOST_CANDIDATES at a time, so the pool is read once
    for each such batch; of each Arrow batch only the k best a candidate leave it."""
    total = candidates.count()
    parts = max(1, -(-total // MOST_CANDIDATES))
    out = None
    for n in range(parts):
        some = candidates if parts == 1 else candidates.filter(F.pmod(F.xxhash64("source", "seq"), F.lit(parts)) == n)
        rows = some.collect()
        names, seqs = np.array([r["source"] for r in rows], object), np.array([r["seq"] for r in rows])
        vecs = without_direction(unit_rows(np.array([r["v"] for r in rows], np.float64)), mean) if rows else np.zeros((0, 1))
        of = {s: np.flatnonzero(names == s) for s in set(names)}
        shared = pool.sparkSession.sparkContext.broadcast((of, seqs, vecs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            of, seqs, vecs = shared.value
            for b in batches:
                src, at = np.array(b.column("source").to_pylist(), object), b.column("seq").to_numpy()
                if not len(at):
                    continue
                x = without_direction(unit_rows(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)), mean)
                for s in set(src):
                    c = of.get(s)
                    if c is None:
                        continue
                    rows = np.flatnonzero(src == s)
                    cos = vecs[c] @ x[rows].T
                    cos[seqs[c][:, None] == at[rows][None, :]] = -np.inf
                    m = min(k, cos.shape[1])
                    top = -np.partition(-cos, m - 1, axis=1)[:, :m]
                    i, j = np.nonzero(np.isfinite(top))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(s, pa.string()), len(i)), pa.array(seqs[c][i]), pa.array(top[i, j])], ["source", "seq", "c"])

        best = pool.select("source", "seq", "v").mapInArrow(run, "source string, seq bigint, c double")
        w = Window.partitionBy("source", "seq").orderBy(F.col("c").desc())
        best = best.withColumn("rn", F.row_number().over(w)).filter(f"rn <= {k}").groupBy("source", "seq").agg(F.avg("c").alias("hubness"))
        out = best if out is None else out.unionByName(best)
    return out


def relate(pool: DataFrame, anchors: list[dict], p: Params = DEFAULTS) -> list[list[dict]]:
    """For each of the first relate_hits anchors ({"source", "h", "v"}, in rank order) the related rows of other sources, best first.

    pool: source, seq, h, topic, at, kind, text, v, and k for the mean direction; live rows only, usable vectors. A row qualifies by its raw
    cosine and is ranked by twice its centred one less its hubness. A source gives at most relate_per_store rows of different
    topics (rows without topic by h) to a hit, a hit has at most relate_per_hit, an ask relate_per_ask. No shown hit and nothing shown
    under an earlier hit is shown (again). Only the best few of each source reach the driver.
    """
    anchors_ = anchors[: p.relate_hits]
    if not anchors_:
        return []
    mean = mean_direction(pool)
    near = near_anchors(pool, anchors_, p.relate_floor, mean)
    rows = near.join(pool.select("source", "seq", "h", "topic", "at", "kind", "v"), ["source", "seq"]).filter(~F.col("h").isin([x["h"] for x in anchors]))
    hub = hubness(pool, rows.select("source", "seq", "v").dropDuplicates(["source", "seq"]), mean, p.hub_k)
    scored = rows.drop("v").join(hub, ["source", "seq"], "left").withColumn("score", 2 * F.col("centred") - F.coalesce("hubness", F.lit(0.0)))
    scored = scored.withColumn("slot", F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic")).otherwise(F.col("h")))
    by = [F.round("score", 9).desc(), F.col("seq").asc()]
    one = scored.withColumn("rn", F.row_number().over(Window.partitionBy("anchor", "source", "slot").orderBy(*by))).filter("rn = 1")
    deep = p.relate_per_store + p.relate_per_ask
    few = one.withColumn("rn", F.row_number().over(Window.partitionBy("anchor", "source").orderBy(*by))).filter(f"rn <= {deep}").drop("rn")
    found = [r.asDict() for r in few.collect()]
    seen: set[str] = set()
    out, left = [], p.relate_per_ask
    for n in range(len(anchors_)):
        mine = sorted((r for r in found if r["anchor"] == n and r["slot"] not in seen), key=lambda r: (-round(r["score"], 9), r["source"], r["seq"]))
        taken: dict[str, int] = {}
        picks = []
        for r in mine:
            if taken.get(r["source"], 0) < p.relate_per_store:
                taken[r["source"]] = taken.get(r["source"], 0) + 1
                picks.append(r)
        picks = picks[: min(p.relate_per_hit, left)]
        left -= len(picks)
        seen.update(r["slot"] for r in picks)
        out.append(picks)
    return out
