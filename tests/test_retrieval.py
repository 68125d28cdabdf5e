"""Lexical and dense arms, displacement and the relate hop against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from verbatrix.functions import text as X
from verbatrix.functions.vectors import Lift, bind_slots, unit_rows, without_direction
from verbatrix.operators import lexical as lex
from verbatrix.operators.infer import displacements, with_displacements
from verbatrix.operators.relate import hubness, mean_direction, relate
from verbatrix.operators.retrieve import coarse, nominated, resolution
from verbatrix.plans.ask import ask, in_scope, ranked
from verbatrix.schema import Params, StoreConfig
from verbatrix.sources.embed import HashedEmbedder

D = 16
LOG = "seq bigint, store string, h string, at string, kind string, topic string, text string, target string, displaces array<struct<target_h:string,w:double>>, slots map<string,string>, questions array<string>"


def rows_of(spark, n, stores=("a",), topic=lambda i: None, kind=lambda i: "note"):
    return spark.createDataFrame([(i, stores[i % len(stores)], f"h{i}", f"2024-01-01T00:00:{i % 60:02}Z", kind(i), topic(i), f"text {i}", None, None, None, None) for i in range(n)], LOG)


def vectors_of(spark, x, stores=("a",)):
    return spark.createDataFrame([(stores[i % len(stores)], f"h{i}", v.tolist(), v.tolist()) for i, v in enumerate(x)], "store string, h string, k array<double>, v array<double>")


def clustered(rng, n, centres):
    return unit_rows(unit_rows(rng.standard_normal((centres, D)))[rng.integers(0, centres, n)] + 0.12 * rng.standard_normal((n, D)))


def test_tokens_and_text(spark):
    df = spark.createDataFrame([("Level-Triggered Éa b2", "a/b.md#x-y"), (None, None), ("", "")], "t string, topic string")
    got = df.select(X.tokens(F.col("t")).alias("k"), X.gloss(F.col("topic"), F.col("t")).alias("g"), X.word_count(F.col("t")).alias("n")).collect()
    assert got[0]["k"] == ["level-triggered", "level", "triggered", "a", "b2"] and got[0]["g"] == "b.md#x-y" and got[0]["n"] == 3
    assert got[1]["k"] == [] and got[2]["n"] == 0
    s = spark.createDataFrame([(["a=1", "b=x=y", "c", "a=2"],)], "p array<string>").select(X.parse_slots(F.col("p")).alias("m")).first()["m"]
    assert s == {"a": "2", "b": "x=y", "c": ""}
    assert spark.createDataFrame([("## Été — x",), ("!!",)], "h string").select(X.heading_slug(F.col("h"))).collect()[1][0] == "intro"


def test_lift_and_slots():
    x = np.random.default_rng(0).standard_normal((5, 12))
    for lift in (Lift(12, 32, 7), Lift(12, 32, 7, 0.5)):
        assert np.allclose(np.linalg.norm(lift.keys(x), axis=1), 1) and np.allclose(np.linalg.norm(lift.values(x), axis=1), 1)
    k = Lift(12, 32, 7).keys(x)[0]
    assert np.array_equal(bind_slots(k, {}, 7), k) and np.allclose(bind_slots(k, {"a": "1", "b": "2"}, 7), bind_slots(k, {"b": "2", "a": "1"}, 7))
    assert abs(bind_slots(k, {"a": "1"}, 7) @ k) < 0.9
    assert not np.any(Lift(12, 32, 7).values(np.zeros((1, 12))))


def test_rank_fusion(spark):
    pool = spark.createDataFrame([(1, 0.9, 0.0, 1.0), (2, 0.8, 5.0, 1.0), (3, 0.7, 0.0, 1.0)], "seq int, res double, bm double, w double").withColumn("q", F.lit(1))
    got = {r["seq"]: r["fused"] for r in lex.fused(pool, ["q"], "res", "bm", "w", ["seq"]).collect()}
    assert np.isclose(got[1], 1 / 60) and np.isclose(got[2], 1 / 61 + 1 / 60) and np.isclose(got[3], 1 / 62)
    off = {r["seq"]: r["fused"] for r in lex.fused(pool.withColumn("w", F.lit(0.0)), ["q"], "res", "bm", "w", ["seq"]).collect()}
    assert off[1] > off[2] > off[3]


def test_displacements(spark):
    x = clustered(np.random.default_rng(1), 120, 9)
    log = rows_of(spark, 120, ("a", "b"), topic=lambda i: "t" if i % 7 == 0 else None, kind=lambda i: "alias" if i % 11 == 5 else "note")
    vec = vectors_of(spark, x, ("a", "b"))
    got = {(r["seq"], r["target_seq"], r["w"]) for r in displacements(log, vec, D, block=16).collect()}
    want = set()
    for i in range(120):
        if i % 7 == 0 or i % 11 == 5:
            continue
        before = [j for j in range(i) if j % 2 == i % 2 and j % 11 != 5]
        best = sorted(((round(float(x[i] @ x[j]), 9), -j) for j in before), reverse=True)[:3]
        want |= {(i, -j, round(min(0.9, c), 3)) for c, j in best if c >= 0.72}
    assert got == want and len(want) > 50
    assert with_displacements(log, displacements(log, vec, D)).filter(F.size("displaces") > 0).count() > 30
    assert displacements(log.limit(0), vec, D).count() == 0


def test_prefilter_is_exact_with_room(spark):
    x = clustered(np.random.default_rng(2), 200, 20)
    log, vec = rows_of(spark, 200), vectors_of(spark, x)
    few = nominated(coarse(vec, D, 7, Params(prefilter_dim=32)), x[3], D, 7, p=Params(prefilter_dim=32, prefilter_candidates=60))
    top = lambda c: [r["seq"] for r in resolution(log, vec, x[3], c).orderBy(F.desc("res"), "seq").limit(5).collect()]
    assert top(few) == top(None)


def test_alias_lends_its_key(spark):
    log = spark.createDataFrame([(1, "a", "p", "2024", "note", None, "x", None, None, None, None), (2, "a", "q", "2024", "alias", None, "?", "p", None, None, None)], LOG)
    e = np.eye(D)
    vec = spark.createDataFrame([("a", "p", e[0].tolist(), e[1].tolist()), ("a", "q", e[2].tolist(), e[1].tolist())], "store string, h string, k array<double>, v array<double>")
    assert resolution(log, vec, e[2]).collect()[0]["res"] == 1.0


def test_relate(spark):
    rng = np.random.default_rng(3)
    stores = ("a", "b", "c")
    x = clustered(rng, 300, 12)
    pool = spark.createDataFrame([(stores[i % 3], i, f"h{i}", f"t{i % 40}" if i % 2 else None, "2024", "note", v.tolist(), v.tolist()) for i, v in enumerate(x)], "source string, seq bigint, h string, topic string, at string, kind string, v array<double>, k array<double>")
    anchors = [{"source": "a", "h": f"h{i}", "v": x[i]} for i in (0, 3, 6)]
    got = [[r["seq"] for r in rs] for rs in relate(pool, anchors)]
    mu = x.sum(axis=0)
    mu /= np.linalg.norm(mu)
    assert np.allclose(mean_direction(pool), mu)
    y = without_direction(x, mu)
    seen, want = set(), []
    for a in (0, 3, 6):
        picks = []
        for s in (1, 2):
            rows = [i for i in range(300) if i % 3 == s]
            cand = [i for i in rows if x[i] @ x[a] >= 0.68]
            score = {i: 2 * y[i] @ y[a] - np.mean(sorted((y[i] @ y[j] for j in rows if j != i), reverse=True)[:10]) for i in cand}
            taken = []
            for i in sorted(cand, key=lambda i: (-round(score[i], 9), i)):
                key = f"t{i % 40}" if i % 2 else f"h{i}"
                if len(taken) < 2 and key not in taken and key not in seen:
                    taken.append(key)
                    picks.append((score[i], i, key))
        picks = sorted(picks, key=lambda p: (-round(p[0], 9), stores[p[1] % 3], p[1]))[:6]
        seen |= {p[2] for p in picks}
        want.append([p[1] for p in picks])
    assert got == want and sum(map(len, want)) > 6
    assert relate(pool, []) == []
    assert hubness(pool.filter("seq = 1"), pool.filter("seq = 1").select("source", "seq", "v"), None).count() == 0


def test_ask(spark):
    texts = ["the retry budget is three attempts", "lunch menu of the canteen", "the retry budget is five attempts now", "unrelated gardening notes about roses"]
    rows = [(i, "a" if i < 3 else "b", f"h{i}", f"2024-01-0{i + 1}", "note", "retry" if "retry" in t else None, t, None, None, None, None) for i, t in enumerate(texts)]
    rows.append((9, "b", "r", "2024-01-09", "retract", None, "retract", "none", None, None, None))
    log = spark.createDataFrame(rows, LOG)
    e = HashedEmbedder(64)
    v = e.passages(texts)
    k = e.passages([r[5] or r[6] for r in rows[:4]])
    vec = spark.createDataFrame([(r[1], r[2], y.tolist(), x.tolist()) for r, x, y in zip(rows, v, k)], "store string, h string, k array<double>, v array<double>")
    q = "what is the retry budget"
    a = ask(log, vec, e.passages([q])[0], q, StoreConfig("hashed", 64), top=4)
    assert a.hits[0]["seq"] == 2 and a.hits[0]["superseded_by"] is None and a.verdict in ("settled", "sparse", "unwritten")
    old = next(h for h in a.hits if h["seq"] == 0)
    assert old["superseded_by"] == "2024-01-03" and old["currency"] < 1
    then = ranked(log, vec, e.passages([q])[0], q, StoreConfig("hashed", 64), as_of="2024-01-01T12:00:00Z").collect()
    assert [r["seq"] for r in then] == [0]
    now = ranked(log, vec, e.passages([q])[0], q, StoreConfig("hashed", 64), current_only=True).collect()
    assert {r["seq"] for r in now} == {1, 2, 3}
    assert ask(log.filter("seq = 9"), vec, e.passages([q])[0], q, StoreConfig("hashed", 64)).verdict == "unwritten"
    assert in_scope(["a", "b"], "a", exclude=("b",)) == ["a"]
