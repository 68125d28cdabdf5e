"""Asking a question of one or several stores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entry_text, verdict
from ..operators import lexical as lex
from ..operators.fold import fold, operations
from ..operators.log import as_of as until
from ..operators.log import displaced, distinct_log, latest_by_topic, live_rows, superseded
from ..operators.relate import relate
from ..operators.retrieve import currency, resolution
from ..schema import DEFAULTS, Params, StoreConfig
from ..session import materialise


@dataclass
class Answer:
    support: float
    verdict: str
    hits: list[dict]
    related: list[list[dict]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def compatible(local: StoreConfig, others: dict[str, StoreConfig]) -> tuple[list[str], list[str]]:
    """The stores that can be read with the local one, and a warning for each that can't."""
    ok, warn = [], []
    for name, cfg in others.items():
        bad = local.mismatch(cfg)
        (warn if bad else ok).append(f"store {name} skipped: other {', '.join(bad)}" if bad else name)
    return ok, warn


def in_scope(stores: list[str], local: str, only: str = "all", exclude: tuple[str, ...] = ()) -> list[str]:
    """The stores to ask: all, local, or one by name; exclude leaves some out. Unknown names, and only together with exclude, are errors."""
    unknown = [x for x in exclude if x not in stores]
    if unknown or (only not in ("all", "local") and only not in stores):
        raise ValueError(f"no such store: {', '.join(unknown) or only}")
    if exclude and only not in ("all", "local"):
        raise ValueError("one store only, or all but some: not both")
    return [s for s in stores if s not in exclude and (only == "all" or s == (local if only == "local" else only))]


def ranked(log: DataFrame, vectors: DataFrame, q: np.ndarray, question: str, cfg: StoreConfig, as_of: str | None = None, current_only: bool = False, states: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """(store, seq, h, at, kind, topic, res, bm25, gate, currency, fused, final, superseded_by, displaced) of every visible row of the pool.

    log: rows of all stores asked; vectors: store, h, k, v. Statistics, ranks and the gate are the whole pool's, currency each store's own.
    """
    log = materialise(distinct_log(log), "pool")
    visible = live_rows(log) if as_of is None else until(log, as_of)
    if current_only:
        visible = visible.join(latest_by_topic(log).select("store", "seq"), ["store", "seq"], "left_semi")
    res = resolution(log, vectors, q).join(visible.select("store", "seq"), ["store", "seq"], "left_semi")
    if states is None:
        states = fold(operations(log, vectors, as_of), cfg.dim, cfg.beta)
    cur = currency(log, vectors, materialise(states, "states"))

    key = ["store", "seq"]
    docs = visible.select(*key, entry_text(F.col("topic"), F.col("text")).alias("doc"))
    # all rows count in the pool's statistics, those out of sight as empty
    size = log.select(*key).join(lex.lengths(docs, key, F.col("doc")), key, "left").select(*key, F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
    ask_ = log.sparkSession.createDataFrame([(1, question)], "qid int, text string")
    terms = lex.question_terms(ask_, "qid", F.col("text"))
    posts = lex.postings(docs, key, F.col("doc"))
    weight = lex.gate(terms, "qid", posts, size, p).agg(F.coalesce(F.max("gate"), F.lit(0.0)).alias("gate"))
    score = lex.bm25(terms, "qid", posts, size, key, p).drop("qid")
    pool = res.join(score, key, "left").crossJoin(F.broadcast(weight)).join(cur, key, "left")
    pool = pool.withColumn("bm25", F.coalesce("bm25", F.lit(0.0))).withColumn("currency", F.coalesce("currency", F.lit(1.0))).withColumn("_all", F.lit(1))
    # vectors are kept in single precision: beyond five digits the order of cosines is noise
    pool = pool.withColumn("_near", F.round("res", 5))
    out = lex.fused(pool, ["_all"], "_near", "bm25", "gate", key, p).drop("_all", "_near").withColumn("final", F.col("fused") * F.col("currency"))
    later = superseded(log) if as_of is None else superseded(log).filter(F.lit(False))
    return out.join(later, key, "left").join(displaced(log), ["store", "h"], "left").join(visible.select(*key, "at", "kind", "topic"), key)


def ask(log: DataFrame, vectors: DataFrame, q: np.ndarray, question: str, cfg: StoreConfig, top: int = 5, warnings: list[str] | None = None, p: Params = DEFAULTS, **how) -> Answer:  # noqa: ANN003
    """The best rows, how well the pool supports an answer, and what other stores relate. Texts are read for the shown rows only."""
    rows = materialise(ranked(log, vectors, q, question, cfg, p=p, **how), "ranked")
    support = rows.agg(F.max("res").alias("s")).select("s", verdict(F.col("s"), p.settled, p.unwritten).alias("verdict")).first()
    if support["s"] is None:
        return Answer(0.0, "unwritten", [], [], warnings or [])
    best = rows.orderBy(F.round("final", 12).desc(), "store", "seq").limit(top)
    text = log.select("store", "seq", "text")
    hits = [r.asDict() for r in best.join(text, ["store", "seq"]).join(vectors.select("store", "h", "v").dropDuplicates(["store", "h"]), ["store", "h"], "left").collect()]
    hits.sort(key=lambda r: (-round(r["final"], 12), r["store"], r["seq"]))
    related: list[list[dict]] = []
    if rows.select("store").distinct().limit(2).count() > 1:
        pool = rows.select("store", "seq", "h", "topic", "at", "kind").join(vectors.select("store", "h", "k", "v").dropDuplicates(["store", "h"]), ["store", "h"]).withColumnRenamed("store", "source")
        related = relate(pool.filter("v is not null and k is not null"), [{"source": r["store"], "h": r["h"], "v": r["v"]} for r in hits if r["v"] is not None], p)
    return Answer(round(support["s"], 2), support["verdict"], [{k: v for k, v in r.items() if k != "v"} for r in hits], related, warnings or [])
