"""The entry row, a store's configuration, and the engine's parameters."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import types as T

ENTRY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("slots", T.MapType(T.StringType(), T.StringType())),
        T.StructField("displaces", T.ArrayType(T.StructType([T.StructField("target_h", T.StringType()), T.StructField("w", T.DoubleType())]))),
        T.StructField("target", T.StringType()),
        T.StructField("questions", T.ArrayType(T.StringType())),
    ]
)
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("store", T.StringType()), T.StructField("h", T.StringType()), *ENTRY.fields])

#: Kinds that are events about entries, not entries.
SPECIAL = ("keep", "retract", "alias")
#: Configuration keys in which stores must agree to be read together.
MATCH_KEYS = ("model", "dim", "seed", "sigma", "d_embed", "beta")


@dataclass(frozen=True)
class StoreConfig:
    """Fixed when a store is made; another configuration is another store."""

    model: str
    dim: int = 4096
    beta: float = 1.0
    sigma: float | None = None
    seed: int = 7
    d_embed: int = 256
    version: int = 1

    def mismatch(self, other: "StoreConfig") -> list[str]:
        return [k for k in MATCH_KEYS if getattr(self, k) != getattr(other, k)]

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Params:
    """What the engine's decisions depend on; the defaults are the published ones."""

    fold_chunk: int = 64
    displace_floor: float = 0.72
    displace_cap: float = 0.90
    displace_top: int = 3
    collision_cosine: float = 0.55
    horizon_words: int = 350
    pack_words: int = 300
    min_chunk_chars: int = 50
    settled: float = 0.65
    unwritten: float = 0.55
    relate_floor: float = 0.68
    relate_hits: int = 3
    relate_per_store: int = 2
    relate_per_hit: int = 6
    relate_per_ask: int = 12
    hub_k: int = 10
    prefilter_rows: int = 100_000
    prefilter_candidates: int = 5_000
    prefilter_dim: int = 256
    relate_slack: float = 0.10
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    gate_floor: float = 3.0
    gate_span: float = 3.0
    rrf_k: int = 60


DEFAULTS = Params()
