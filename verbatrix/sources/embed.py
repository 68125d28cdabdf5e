"""Embedders: a registry, one built in, and a content-addressed cache, so that a text is embedded once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Lift, bind_rows, bind_slots, unit_rows
from ..schema import StoreConfig

TOKEN = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def hashed_tokens(text: str) -> list[str]:
    out = []
    for w in TOKEN.findall(text.lower()):
        out.append(w)
        if "-" in w:
            out += w.split("-")
    return out


class HashedEmbedder:
    """Signed feature hashing of tokens: bucket and sign of a token from its SHA-256; unit length, zero without tokens.
    Needs no weights, and SQL can compute it too."""

    name, query_prefix = "hashed", ""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._of: dict[str, tuple[int, int]] = {}

    def passages(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in hashed_tokens(t):
                at = self._of.get(w)
                if at is None:
                    d = hashlib.sha256(w.encode()).hexdigest()
                    at = self._of[w] = int(d[:8], 16) % self.dim, 1 if int(d[8], 16) % 2 else -1
                out[i, at[0]] += at[1]
        return unit_rows(out)


#: Name to a function that makes an embedder (with dim, query_prefix, passages(list) -> rows of unit length). Model-backed ones are added by their users.
EMBEDDERS: dict[str, Callable[..., object]] = {"hashed": HashedEmbedder}


def register_embedder(name: str, make: Callable[..., object]) -> None:
    EMBEDDERS[name] = make


def text_digest() -> F.Column:
    """The first 16 bytes (32 hex digits) of a text's SHA-256."""
    return F.substring(F.sha2(F.col("text"), 256), 1, 32)


def embed_distinct(texts: DataFrame, embedder: str = "hashed", dim: int = 64, block: int = 512) -> DataFrame:
    """(digest, vec) of the distinct non-null texts of column text. The embedder is made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = EMBEDDERS[embedder](dim)
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                x = np.asarray(model.passages(part.column("text").to_pylist()), np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("digest"), flat], ["digest", "vec"])

    distinct = texts.filter("text is not null").groupBy(text_digest().alias("digest")).agg(F.first("text").alias("text"))
    return distinct.mapInArrow(run, "digest string, vec array<float>")


def embed_missing(texts: DataFrame, cache: DataFrame, **how) -> DataFrame:  # noqa: ANN003
    """What embedding these texts adds to the cache (digest, vec): only texts it lacks go through the model."""
    lacking = texts.filter("text is not null").withColumn("digest", text_digest()).join(cache.select("digest"), "digest", "left_anti")
    return embed_distinct(lacking.select("text"), **how)


def with_vectors(df: DataFrame, column: str, out: str, embedded: DataFrame) -> DataFrame:
    """df with the vector of a text column from (digest, vec)."""
    e = embedded.select(F.col("digest").alias("_d"), F.col("vec").alias(out))
    return df.withColumn("_d", F.substring(F.sha2(F.col(column), 256), 1, 32)).join(e, "_d", "left").drop("_d")


def lift_of(cfg: StoreConfig) -> Lift | None:
    """The projection from embeddings to fold space; none where the embedder already has the store's width and keys are linear."""
    return None if cfg.d_embed == cfg.dim and not cfg.sigma else Lift(cfg.d_embed, cfg.dim, cfg.seed, cfg.sigma)


def question_vector(question: str, cfg: StoreConfig, slots: dict[str, str] | None = None) -> np.ndarray:
    """The address a question asks at: lifted like a key where keys aren't linear, bound to its slots."""
    model = EMBEDDERS[cfg.model](cfg.d_embed)
    x = np.asarray(model.passages([model.query_prefix + question]), np.float64)
    lift = lift_of(cfg)
    if lift is not None:
        x = lift.keys(x) if cfg.sigma else lift.values(x)
    return bind_slots(x[0], slots, cfg.seed)


def spoken_texts(log: DataFrame) -> DataFrame:
    """(text) what a log's vectors are made of: topics and texts."""
    rows = log.filter(~F.coalesce("kind", F.lit("note")).isin("keep", "retract"))
    return rows.select("text").unionByName(rows.select(F.col("topic").alias("text")).filter("text <> ''"))


def fold_vectors(log: DataFrame, cfg: StoreConfig, embedded: DataFrame | None = None) -> DataFrame:
    """(store, h, k, v) of a log's entries and aliases, from embedded texts (digest, vec) if there are some. The key is of the topic, or else the text, bound to the slots; the value is of the text;
    an alias has its parent's value. Keeps and retracts have none. Every distinct text is embedded once."""
    from ..operators.log import distinct_log

    rows = distinct_log(log).filter(~F.coalesce("kind", F.lit("note")).isin("keep", "retract"))
    rows = rows.select("store", "h", "target", "kind", "text", "slots", F.when(F.col("topic") != "", F.col("topic")).otherwise(F.col("text")).alias("address"))
    e = embed_distinct(rows.select("text").unionByName(rows.select(F.col("address").alias("text"))), cfg.model, cfg.d_embed) if embedded is None else embedded
    own = with_vectors(with_vectors(rows, "text", "v", e), "address", "k", e).filter("v is not null and k is not null")
    lift = lift_of(cfg)

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if not len(b):
                continue
            k, v = np.stack(b["k"]).astype(np.float64), np.stack(b["v"]).astype(np.float64)
            if lift is not None:
                k, v = lift.keys(k), lift.values(v)
            k = bind_rows(k, [dict(zip(n, y)) if n is not None else None for n, y in zip(b["names"], b["given"])], cfg.seed)
            yield b[["store", "h", "target", "kind"]].assign(k=k.tolist(), v=v.tolist())

    given = own.select("store", "h", "target", "kind", F.map_keys("slots").alias("names"), F.map_values("slots").alias("given"), "k", "v")
    made = given.mapInPandas(run, "store string, h string, target string, kind string, k array<double>, v array<double>")
    parent = made.select("store", F.col("h").alias("target"), F.col("v").alias("pv"))
    return made.join(parent, ["store", "target"], "left").select("store", "h", "k", F.when(F.col("kind") == "alias", F.col("pv")).otherwise(F.col("v")).alias("v"))
