"""Displacement inference: which earlier entries a new entry without topic displaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import unit_rows
from ..schema import DEFAULTS, Params
from ..session import materialise
from .log import distinct_log, latest_by_topic, live_rows, with_ordinal

BLOCK = 1024
#: So many blocks ask in one task at most (64 MB of keys at 1024 dimensions).
ASKING = 16


def packed_keys(vectors: DataFrame, dim: int) -> DataFrame:
    """(store, h, k) with keys of width dim as bytes, which are cheap to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("k").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            at = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([b.column("store").take(at), b.column("h").take(at), pa.array([r.tobytes() for r in x[fine]], pa.binary())], ["store", "h", "k"])

    return vectors.filter(F.size("k") == dim).select("store", "h", "k").mapInArrow(run, "store string, h string, k binary")


def displacements(log: DataFrame, vectors: DataFrame, dim: int, p: Params = DEFAULTS, block: int = BLOCK, since: int | None = None) -> DataFrame:
    """(store, seq, h, target_seq, target_h, cosine, w): of every live entry without topic the `displace_top` most similar entries
    before it in its store, by keys, with a cosine of at least the floor; w is the cosine, capped and rounded to 3 digits. Ties: the earlier one.
    With since, only entries from that seq on ask; all earlier ones are still looked at.

    Only live entries displace and are displaced. Entries without a usable key neither do nor are. Every earlier entry is looked at, as the
    definition has it. A store's rows are dealt into blocks of `block` in order of writing, which are written with their keys once; what asks is
    one block's rows at a time, and the blocks not after it come to its task one by one, for one matrix product each, of which only
    the best leave it. Each block is sent once to every group of up to ASKING asking blocks, not to every block. Blocks without queries aren't probed.
    """
    rows = live_rows(distinct_log(log)).select("store", "seq", "h", (F.coalesce("topic", F.lit("")) == "").alias("asks"))
    rows = rows if since is None else rows.withColumn("asks", F.col("asks") & (F.col("seq") >= since))
    numbered = with_ordinal(rows, ["store"], ["seq"], "place").withColumn("block", F.floor((F.col("place") - 1) / block).cast("int"))
    keyed = materialise(numbered.join(packed_keys(vectors, dim).dropDuplicates(["store", "h"]), ["store", "h"]).select("store", "block", "seq", "h", "asks", "k"), "keyed")
    # groups of blocks that ask share what they are compared with: a row of the task's stream is a key, for one group
    asking, cores = keyed.filter("asks").select("store", "block").distinct(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = asking.count()
    per = max(1, min(ASKING, blocks // (2 * cores)))
    asking = asking.select("store", F.floor(F.col("block") / per).cast("int").alias("group")).distinct()
    last = F.col("group") * per + (per - 1)
    sent = keyed.join(asking, "store").filter(F.col("block") <= last).withColumn("mine", F.floor(F.col("block") / per) == F.col("group"))
    parts = max(1, min(4 * cores, blocks // per + 1))
    # first the group's own rows, which it keeps, then the earlier ones, which pass by
    stream = sent.select("store", "group", "mine", "block", "seq", "asks", "k").repartition(parts, "store", "group").sortWithinPartitions("store", "group", F.desc("mine"), "seq")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list = []
        rest: list = []
        now, asked, asked_seq = None, None, None

        def compared(seqs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
            near = asked @ unit_rows(keys).astype(np.float32).T
            i, j = np.divmod(np.flatnonzero(near.ravel() >= p.displace_floor - 1e-4), near.shape[1])
            before = seqs[j] < asked_seq[i]
            i, j = i[before], j[before]
            # what is near in single precision is decided in double
            cos = np.round(np.einsum("ij,ij->i", unit_rows(exact[i]), unit_rows(keys[j])), 9)
            sure = cos >= p.displace_floor
            i, j, cos = i[sure], j[sure], cos[sure]
            order = np.lexsort((seqs[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            counts = np.bincount(i, minlength=len(asked_seq))
            keep = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) < p.displace_top
            i, j, cos = i[keep], j[keep], cos[keep]
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[0], pa.string()), len(i)), pa.array(asked_seq[i]), pa.array(seqs[j]), pa.array(cos)], ["store", "seq", "target_seq", "cosine"])

        def taken(of: list) -> tuple[np.ndarray, np.ndarray]:
            seqs, keys = np.array([r[0] for r in of], np.int64), np.frombuffer(b"".join(r[2] for r in of), np.float32).reshape(-1, dim)
            of.clear()
            return seqs, keys

        exact = np.zeros((0, dim), np.float32)

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal asked, asked_seq, exact
            asks = np.array([r[1] for r in own], bool)
            seqs, keys = taken(own)
            asked_seq, exact = seqs[asks], keys[asks]
            asked = unit_rows(exact).astype(np.float32)
            for a in range(0, len(seqs), block):
                yield compared(seqs[a : a + block], keys[a : a + block])

        for b in batches:
            for s, g, mine, seq, asks, k in zip(*(b.column(c).to_pylist() for c in ("store", "group", "mine", "seq", "asks", "k"))):
                if (s, g) != now:
                    if own:
                        yield from ready()
                    if rest:
                        yield compared(*taken(rest))
                    now, asked = (s, g), None
                if mine:
                    own.append((seq, asks, k))
                    continue
                if asked is None:
                    yield from ready()
                rest.append((seq, asks, k))
                if len(rest) == block:
                    yield compared(*taken(rest))
        if own:
            yield from ready()
        if rest:
            yield compared(*taken(rest))

    found = stream.mapInArrow(best, "store string, seq bigint, target_seq bigint, cosine double")
    w = Window.partitionBy("store", "seq").orderBy(F.col("cosine").desc(), "target_seq")
    top = found.withColumn("rn", F.row_number().over(w)).filter(f"rn <= {p.displace_top}").drop("rn")
    names = keyed.select("store", "seq", "h")
    return (
        top.join(names, ["store", "seq"])
        .join(names.select("store", F.col("seq").alias("target_seq"), F.col("h").alias("target_h")), ["store", "target_seq"])
        .select("store", "seq", "h", "target_seq", "target_h", "cosine", F.round(F.least("cosine", F.lit(p.displace_cap)), 3).alias("w"))
    )


def with_displacements(log: DataFrame, found: DataFrame) -> DataFrame:
    """The log's rows with inferred displacements in displaces (rows without any keep their own)."""
    lists = found.groupBy("store", "h").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("o"), "target_h", "w"))).alias("l"))
    lists = lists.select("store", "h", F.transform("l", lambda x: F.struct(x["target_h"].alias("target_h"), x["w"].alias("w"))).alias("_d"))
    return log.join(lists, ["store", "h"], "left").withColumn("displaces", F.coalesce("_d", "displaces")).drop("_d")


def collisions(log: DataFrame, new: DataFrame, vectors: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(store, h, topic, prior_h, cosine, unrelated) for new entries (store, h, topic, v) whose topic is held: unrelated where the
    values' cosine is below the collision bound (a topic used as a folder: the write would erase something else)."""
    from ..functions.vectors import cosine

    held = latest_by_topic(log).filter(F.coalesce("topic", F.lit("")) != "").select("store", "topic", F.col("h").alias("prior_h"))
    held = held.join(vectors.select("store", F.col("h").alias("prior_h"), F.col("v").alias("pv")), ["store", "prior_h"])
    return new.join(held, ["store", "topic"]).select("store", "h", "topic", "prior_h", cosine(F.col("v"), F.col("pv")).alias("cosine")).withColumn("unrelated", F.col("cosine") < p.collision_cosine)
