"""Translators, stores, the command line, and catching up by stream."""

import json

import pytest
from pyspark.sql import functions as F

from verbatrix.cli import run
from verbatrix.operators import log as L
from verbatrix.schema import LOG
from verbatrix.sources import translate as T
from verbatrix.sources.embed import embed_distinct, embed_missing
from verbatrix.sources.stores import Disk, Store, reader
from verbatrix.streaming.catchup import DerivedTables, catch_up


def test_jsonl_and_ledger(spark):
    lines = spark.createDataFrame([('{"text": "a", "topic": "t", "slots": {"x": "1"}}',), ("",), ("# no",), ('{"text": "b", "at": "2024", "kind": "doc"}',)], "value string")
    got = T.jsonl(lines).collect()
    assert [(r["text"], r["topic"], r["kind"], r["slots"]) for r in got] == [("a", "t", "note", {"x": "1"}), ("b", None, "doc", {})]
    for bad in ('{"text": ', '{"topic": "t"}'):
        with pytest.raises(Exception):
            T.jsonl(spark.createDataFrame([(bad,)], "value string")).collect()
    led = spark.createDataFrame([('{"_tag": "Note", "at": "1", "node": "n", "text": "x"}',), ('{"_tag": "ForkRuled", "at": "2", "node": "n", "choice": "c"}',), ('{"_tag": "Other", "at": "3"}',), ("{broken",)], "value string")
    assert [(r["text"], r["kind"]) for r in T.ledger(led).collect()] == [("x", "Note"), ("fork n ruled: c", "ForkRuled")]


def test_sections_and_chunks():
    long = "word " * 30
    text = f"{long}\n# One Two\n{long}\n## Contents\n{long}\n### Three\nshort\n#### no heading\n"
    assert [s for s, _ in T.sections(text)] == ["intro", "one-two", "contents"]
    assert list(T.sections(text))[1][1].startswith("One Two\nword")
    paper = "# A\n" + "\n\n".join(["w " * 200, "w " * 150, "w " * 400, "tiny"]) + "\n# Index\n" + long
    got = list(T.chunks(paper))
    assert [s for s, _ in got] == ["a", "a/2", "a/3"]
    assert T.packed(["a b", "c"], 3) == ["a b\n\nc"] and T.packed(["a b c d"], 3) == ["a b c d"] and T.packed([], 3) == []
    assert list(T.chunks("")) == [] and list(T.sections("")) == []


def test_files(spark, tmp_path):
    (tmp_path / "x.md").write_text("# H\n" + "word " * 20)
    got = T.ingest(spark, "markdown", str(tmp_path), at="2024").collect()
    assert len(got) == 1 and got[0]["topic"].endswith("x.md#h") and got[0]["at"] == "2024" and got[0]["kind"] == "doc"
    with pytest.raises(ValueError):
        T.ingest(spark, "none", str(tmp_path))


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "text string")
    cache = embed_distinct(texts.limit(2), "hashed", 16)
    assert cache.count() == 1
    assert embed_missing(texts, cache, embedder="hashed", dim=16).count() == 1


def test_store_and_command_line(spark, tmp_path):
    at = str(tmp_path / "mine")
    do = lambda *a: run(["--store", at, *a], spark)
    do("init", "--dim", "32")
    with pytest.raises(FileExistsError):
        do("init")
    assert do("remember", "the retry budget is three", "--topic", "retry", "--at", "2024-01-01T00:00:00Z", "--question", "how many retries?")[0]["added"] == 1
    assert do("remember", "the retry budget is three", "--topic", "retry", "--at", "2024-01-01T00:00:00Z")[0]["added"] == 0
    do("remember", "the retry budget is five", "--topic", "retry", "--at", "2024-01-02T00:00:00Z")
    do("remember", "roses need pruning", "--at", "2024-01-03T00:00:00Z", "--slot", "season=spring")
    h = {r["text"]: r["h"] for r in Store(spark, at).log().collect()}
    assert len(h) == 4
    assert do("remember", "roses need pruning", "--at", "2024-01-04T00:00:00Z", "--slot", "season=spring", "--infer")[0]["displaced"][0]["w"] == 0.9
    do("keep", h["roses need pruning"][:6])
    assert do("question", h["roses need pruning"], "when to prune?", "when to prune?")[0]["added"] == 1
    assert do("question", h["roses need pruning"], "when to prune?")[0]["added"] == 0
    topics = do("topics")
    assert {(r["topic"], r["writes"]) for r in topics} == {(None, 2), ("retry", 2)}
    shown = do("show", h["the retry budget is three"][:8])[0]
    assert shown["questions"] == ["how many retries?"] and shown["superseded"]
    found = do("ask", "what is the retry budget", "--top", "2")
    assert found[1]["h"] == h["the retry budget is five"]
    assert do("forget", h["the retry budget is five"])[0]["forgotten"] == 1
    assert do("ask", "what is the retry budget", "--top", "1")[1]["h"] == h["the retry budget is three"]
    with pytest.raises(ValueError):
        do("forget", "zzzz")
    # a topic held by something else is reported; several hashes are shown, and what is ambiguous is listed
    assert do("remember", "lunch is at noon", "--topic", "retry", "--at", "2024-01-05T00:00:00Z")[0]["collides"][0]["topic"] == "retry"
    shown = do("show", h["roses need pruning"], "", "zzzz")
    assert shown[0]["text"] == "roses need pruning" and len(shown[1]["matches"]) > 2 and shown[2]["matches"] == []
    kept = Disk(spark, at).names("embedded")
    do("ask", "lunch is at noon")
    assert Disk(spark, at).names("embedded") == kept  # every text has been through the model
    assert len(do("log", "--all")) >= 4 and do("stats")[0]["entries"] == Store(spark, at).log().count()

    other = str(tmp_path / "team")
    run(["--store", other, "init", "--dim", "32"], spark)
    run(["--store", other, "remember", 'the "team" retry budget is nine', "--at", "2024-02-01T00:00:00Z"], spark)
    run(["--store", other, "publish"], spark)
    do("others", "add", other)
    assert {r.get("store") for r in do("ask", "retry budget", "--top", "4")[1:]} >= {"mine", "team"}
    assert all(r["store"] == "mine" for r in do("ask", "retry budget", "--except", "team")[1:])
    assert do("merge", other, "--out", str(tmp_path / "both"))[0]["entries"] == Store(spark, at).log().count() + 1
    assert do("recompile", "--model", "hashed", "--dim", "64", "--out", str(tmp_path / "wide"))[0]["entries"] == Store(spark, at).log().count()
    again = do("recompile", "--model", "hashed", "--dim", "16")[0]
    assert Store(spark, at).config.dim == 16 and Store(spark, at).others() and Store(spark, str(tmp_path / again["backup"])).config.dim == 32
    assert do("others", "remove", "team")[0]["removed"] and not Store(spark, at).others()
    with pytest.raises(ValueError):
        reader(spark, "ipfs://x")


def test_lifted_and_bound(spark, tmp_path, monkeypatch):
    import io

    at = str(tmp_path / "s")
    do = lambda *a: run(["--store", at, *a], spark)
    do("init", "--dim", "256", "--d-embed", "64", "--sigma", "1.0")
    monkeypatch.setattr("sys.stdin", io.StringIO('{"text": "the gate opens at nine", "at": "2024-01-01", "slots": {"site": "north"}}\n# x\n\n{"text": "the gate opens at nine", "at": "2024-01-02", "slots": {"site": "south"}}\n'))
    assert do("ingest", "jsonl", "-")[0]["added"] == 2
    best = {site: do("ask", "the gate opens at nine", "--slot", f"site={site}", "--top", "1")[1] for site in ("north", "south")}
    assert best["north"]["at"] == "2024-01-01" and best["south"]["at"] == "2024-01-02"
    assert best["north"]["res"] > 0.99
    with pytest.raises(ValueError):
        do("ingest", "ledger", "-")


def test_mirror_heals(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for p, dim in ((a, "32"), (b, "16")):
        run(["--store", p, "init", "--dim", dim], spark)
    run(["--store", b, "remember", "x", "--at", "2024"], spark)
    run(["--store", b, "publish"], spark)
    run(["--store", a, "others", "add", b], spark)
    readable, warnings = Store(spark, a).readable()
    assert list(readable) == ["a"] and "dim" in warnings[0]
    cfg = json.loads((tmp_path / "b" / "config.json").read_text())
    (tmp_path / "b" / ".config.json.crc").unlink(missing_ok=True)
    (tmp_path / "b" / "config.json").write_text(json.dumps({**cfg, "dim": 32, "d_embed": 32}))
    assert list(Store(spark, a).readable()[0]) == ["a", "b"]
    # what can't be reached is as it was mirrored last; what never could be isn't there
    (tmp_path / "b" / "config.json").unlink()
    (tmp_path / "b" / ".config.json.crc").unlink(missing_ok=True)
    assert list(Store(spark, a).readable()[0]) == ["a", "b"]
    Disk(spark, f"{a}/mirrors/b").delete()
    assert "can't be read" in Store(spark, a).readable()[1][0]


def log_rows(spark):
    rows = [(i, "s", "note" if i % 5 else "retract", "t" if i % 3 == 0 else None, f"word{i} level-triggered", f"h{i - 3}" if i % 5 == 0 else None) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "seq bigint, store string, kind string, topic string, text string, target string")
    return df.select("seq", "store", F.concat(F.lit("h"), "seq").alias("h"), "text", "topic", F.lit("2024").alias("at"), "kind", F.create_map().cast("map<string,string>").alias("slots"), F.array().cast("array<struct<target_h:string,w:double>>").alias("displaces"), "target", F.array().cast("array<string>").alias("questions"))


def test_any_cutting_gives_the_same_tables(spark, tmp_path):
    log = log_rows(spark)
    got = []
    for n, cuts in enumerate(([40], [10, 25, 40], [1, 2, 40])):
        t, a = DerivedTables(spark, str(tmp_path / str(n))), 0
        for i, b in enumerate(cuts):
            t.advance(log.filter((F.col("seq") > a) & (F.col("seq") <= b)), i)
            t.advance(log.filter((F.col("seq") > a) & (F.col("seq") <= b)), i)  # a batch done again
            a = b
        got.append({tuple(r) for r in t.live("postings").select("seq", "term", "tf").collect()})
    assert got[0] == got[1] == got[2] and got[0]
    assert {r[0] for r in got[0]} == {r["seq"] for r in L.live_rows(log).collect()}


def test_stream_goes_on(spark, tmp_path):
    log, src, out = log_rows(spark), str(tmp_path / "log"), str(tmp_path / "out")
    log.filter("seq <= 20").coalesce(1).write.parquet(src)
    catch_up(spark, src, LOG, out)
    log.filter("seq > 20").coalesce(1).write.mode("append").parquet(src)
    t = catch_up(spark, src, LOG, out)
    assert t.live("lengths").count() == L.live_rows(log).count()


def test_append_numbers_on(spark):
    log = log_rows(spark)
    new = spark.createDataFrame([("x", None, "2024", "note", {}, [], None, ["q1", "q1", "q2"], "s", 1), ("x", None, "2024", "doc", {}, [], None, [], "s", 2), ("y", None, "2024", "note", {}, [], None, [], "s", 3)], "text string, topic string, at string, kind string, slots map<string,string>, displaces array<struct<target_h:string,w:double>>, target string, questions array<string>, store string, ord bigint")
    got = L.append(log, new).orderBy("seq").collect()
    assert [(r["seq"], r["kind"], r["text"]) for r in got] == [(40, "note", "x"), (41, "alias", "q1"), (42, "alias", "q2"), (43, "note", "y")]
    assert L.append(log.unionByName(spark.createDataFrame(got, log.schema)), new).count() == 0
