"""The command line: verbs over a store in a folder."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import functions as F

from .functions.text import attenuation_reading, past_horizon, truncated
from .operators import log as L
from .operators.fold import fold, gauges, operations
from .plans.ask import ask, in_scope
from .schema import ENTRY, StoreConfig
from .session import local_session
from .sources.embed import EMBEDDERS, question_vector
from .sources.stores import Store
from .sources.translate import TRANSLATORS, ingest, jsonl


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def slots_of(pairs: list[str]) -> dict[str, str]:
    return dict(p.split("=", 1) if "=" in p else (p, "") for p in pairs)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="verbatrix")
    p.add_argument("--store", default="store")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, **kw) -> None:  # noqa: ANN003
        s = sub.add_parser(name, **kw)
        for a, opts in args:
            s.add_argument(*a.split(), **opts)

    verb("init", ("--model", {"default": "hashed", "choices": sorted(EMBEDDERS)}), ("--dim", {"type": int, "default": 256}), ("--beta", {"type": float, "default": 1.0}), ("--seed", {"type": int, "default": 7}), ("--sigma", {"type": float}), ("--d-embed", {"type": int}))
    verb("remember", ("text", {}), ("--topic", {}), ("--kind", {"default": "note"}), ("--at", {}), ("--question", {"action": "append", "default": []}), ("--slot", {"action": "append", "default": []}), ("--infer", {"action": argparse.BooleanOptionalAction, "default": True}))
    verb("question", ("hash", {}), ("questions", {"nargs": "+"}))
    verb("keep", ("hash", {}))
    verb("forget", ("hashes", {"nargs": "*"}), ("--last", {"type": int, "default": 0}))
    verb("ingest", ("format", {"choices": sorted(TRANSLATORS)}), ("paths", {"nargs": "+"}), ("--at", {}), ("--infer", {"action": argparse.BooleanOptionalAction, "default": False}))
    verb("ask", ("question", {}), ("--top", {"type": int, "default": 5}), ("--as-of", {}), ("--current", {"action": "store_true"}), ("--slot", {"action": "append", "default": []}), ("--from", {"dest": "only", "default": "all"}), ("--except", {"dest": "exclude", "action": "append", "default": []}))
    verb("show", ("hashes", {"nargs": "+"}))
    verb("log", ("--top", {"type": int, "default": 20}), ("--all", {"action": "store_true"}))
    verb("topics")
    verb("stats")
    verb("others", ("action", {"choices": ["add", "remove", "list"]}), ("addr", {"nargs": "?"}), ("--name", {}))
    verb("merge", ("other", {}), ("--out", {"required": True}))
    verb("recompile", ("--model", {"required": True}), ("--dim", {"type": int}), ("--out", {}))
    verb("publish")
    return p


def run(argv: list[str] | None = None, spark=None) -> list[dict]:  # noqa: ANN001
    """Do what the arguments say; the rows that a verb shows are returned and, by main, printed as JSON lines."""
    a = parser().parse_args(argv)
    spark = spark or local_session()
    if a.verb == "init":
        Store.create(spark, a.store, StoreConfig(a.model, a.dim, a.beta, a.sigma, a.seed, a.d_embed or a.dim))
        return [{"store": a.store}]
    store = Store(spark, a.store)
    if a.verb == "remember":
        row = (a.text, a.topic, a.at or now(), a.kind, slots_of(a.slot), [], None, a.question)
        entry = spark.createDataFrame([row], ENTRY)
        held = [r.asDict() for r in store.collisions(entry).filter("unrelated").select("topic", "prior_h", "cosine").collect()] if a.topic else []
        new = store.add(entry, a.infer and not a.topic)
        shown = new.filter(L.is_entry()).select(F.explode("displaces").alias("d")).select("d.target_h", "d.w", attenuation_reading(F.col("d.w")).alias("reading"))
        return [{"added": new.filter(L.is_entry()).count(), "displaced": [r.asDict() for r in shown.collect()], "collides": held}]
    if a.verb == "question":
        return [{"added": store.add_questions(a.hash, a.questions, now())}]
    if a.verb == "keep":
        store.keep(a.hash, now())
        return [{"kept": a.hash}]
    if a.verb == "forget":
        return [{"forgotten": store.forget(a.hashes, now(), a.last)}]
    if a.verb == "ingest":
        if a.paths == ["-"]:
            if a.format != "jsonl":
                raise ValueError("standard input must be jsonl")
            entries = jsonl(spark.createDataFrame([(line,) for line in sys.stdin], "value string"))
            entries = entries if a.at is None else entries.withColumn("at", F.lit(a.at))
        else:
            entries = ingest(spark, a.format, a.paths, a.at)
        return [{"read": entries.count(), "past_horizon": entries.filter(past_horizon(F.col("text"))).count(), "added": store.append(entries, a.infer)}]
    if a.verb == "ask":
        readable, warnings = store.readable()
        names = in_scope(list(readable), store.name, a.only, tuple(a.exclude))
        logs = [readable[n].log().withColumn("store", F.lit(n)) for n in names]
        pool = logs[0]
        for x in logs[1:]:
            pool = pool.unionByName(x)
        q = question_vector(a.question, store.config, slots_of(a.slot))
        found = ask(pool, store.vectors(pool), q, a.question, store.config, a.top, warnings, as_of=a.as_of, current_only=a.current)
        return [{"support": found.support, "verdict": found.verdict, "warnings": found.warnings}, *found.hits, *({"hit": i, **r} for i, rs in enumerate(found.related) for r in rs)]
    log = store.log()
    if a.verb == "show":
        readable, _ = store.readable()
        logs = [s.log().withColumn("store", F.lit(n)) for n, s in readable.items()]
        pool = reduce(lambda x, y: x.unionByName(y), logs)
        out = []
        for prefix in a.hashes:
            found = L.by_prefix(pool, prefix).orderBy("h").limit(20).collect()
            if len(found) != 1:
                out.append({"hash": prefix, "matches": [{"store": r["store"], "h": r["h"], "text": (r["text"] or "")[:80]} for r in found]})
                continue
            r = found[0]
            own = pool.filter(F.col("store") == r["store"])
            mine = lambda df, c: [x.asDict() for x in df.filter(F.col(c) == r[c]).collect()]  # noqa: B023, E731
            asked = [x["text"] for x in own.filter((F.col("kind") == "alias") & (F.col("target") == r["h"])).select("text").collect()]
            out.append({**r.asDict(recursive=True), "displaced": mine(L.displaced(own), "h"), "superseded": mine(L.superseded(own), "seq"), "questions": asked})
        return out
    if a.verb == "log":
        rows = L.newest(log, None if a.all else a.top).select("at", "kind", "topic", "h", "superseded_by", "displaced", truncated(F.col("text")).alias("text"))
        return [r.asDict() for r in rows.orderBy(F.desc("at")).collect()]
    if a.verb == "topics":
        return [r.asDict() for r in L.topic_listing(log).orderBy("topic").collect()]
    if a.verb == "stats":
        g = gauges(fold(operations(log, store.vectors(log)), store.config.dim, store.config.beta))
        return [r.asDict() for r in L.stats(log).join(g, "store", "left").collect()]
    if a.verb == "others":
        if a.action == "add":
            return [store.add_other(a.addr, a.name)]
        return [{"removed": store.remove_other(a.addr)}] if a.action == "remove" else store.others()
    if a.verb == "merge":
        other = Store(spark, a.other)
        bad = store.config.mismatch(other.config)
        if bad:
            raise ValueError(f"the stores differ in {', '.join(bad)}")
        out = Store.create(spark, a.out, store.config)
        both = log.withColumn("store", F.lit("0")).unionByName(other.log().withColumn("store", F.lit("1")))
        L.merge_logs(both, F.lit(out.name), F.col("source")).select(*log.columns).write.parquet(out.table)
        return [{"entries": out.log().count()}]
    if a.verb == "recompile":
        # vectors and state are derived when they are read: another model is the same log under another configuration
        cfg = StoreConfig(**{**store.config.to_dict(), "model": a.model, "dim": a.dim or store.config.dim, "d_embed": a.dim or store.config.d_embed})
        out, backup = store.recompiled(cfg, a.out)
        return [{"entries": out.log().count(), "backup": backup}]
    store.publish()
    return [{"published": str(store.path)}]


def main() -> None:
    for row in run():
        print(json.dumps(row, default=str, ensure_ascii=False))


if __name__ == "__main__":
    main()
