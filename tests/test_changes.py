"""The change feed against a plain Python version, and its cases."""

import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from verbatrix.functions.time import instant_micros
from verbatrix.operators.changes import current_entries, merge_changes

SCHEMA = "seq bigint, store string, h string, at string, kind string, topic string, target string, displaces array<struct<target_h:string,w:double>>, text string"


def at_micros(s):
    if s is None:
        return -(2**63)
    d = datetime.fromisoformat(s)
    return round((d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp() * 1e6)


def plain(rows):
    seen, feed = set(), []
    for r in sorted(rows):
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            feed.append(r)
    gone = {(r[1], r[6]) for r in feed if r[4] == "retract"}
    live = [r for r in feed if r[4] not in ("keep", "retract", "alias") and (r[1], r[2]) not in gone]
    last = {}
    for r in live:
        slot = (r[1], r[5]) if r[5] else (r[1], r[2], r[0])
        if slot not in last or (at_micros(r[3]), r[2]) > (at_micros(last[slot][3]), last[slot][2]):
            last[slot] = r
    out = set()
    for r in last.values():
        kept = [at_micros(k[3]) for k in feed if k[4] == "keep" and k[1] == r[1] and k[6] == r[2]]
        by = [(-w, d[2]) for d in live if d[1] == r[1] for t, w in d[7] or [] if t == r[2] and not any(at_micros(d[3]) <= k for k in kept)]
        out.add((r[1], r[2], min(by)[1] if by else ""))
    return out


def test_random_feeds(spark):
    rng = random.Random(4)
    for _ in range(3):
        rows = []
        for i in range(150):
            kind = rng.choice(["note", "doc", None, "keep", "retract", "alias"] + ["note"] * 6)
            rows.append(
                (
                    i, rng.choice("ab"), f"h{rng.randrange(60):02}", rng.choice(["2024-03-01", "2024-03-01T02:00:00+02:00", "2024-03-01T00:00Z", f"2024-03-0{rng.randrange(1, 5)}T0{rng.randrange(9)}:00:00.{rng.randrange(999):03}Z"]),
                    kind, rng.choice([None, "", "t1", "t2", "t3"]), f"h{rng.randrange(70):02}" if kind in ("keep", "retract", "alias") else None,
                    rng.choice([None, [], [(f"h{rng.randrange(60):02}", rng.choice([0.8, 0.85, 0.9]))], [(f"h{rng.randrange(60):02}", 0.8), ("unknown", 0.9)]]), "x",
                )
            )
        got = {tuple(r)[:3] for r in current_entries(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == plain(rows)


def test_empty_feed_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert current_entries(empty).count() == 0
    one = spark.createDataFrame([(1, "s", "a", "2024-01-01", "note", None, None, None, "x")], SCHEMA).withColumn("_kept", F.lit(1)).withColumn("instant", F.lit("no"))
    assert [tuple(r)[:3] for r in current_entries(one).collect()] == [("s", "a", "")]


def test_nulls(spark):
    rows = [(1, None, None, None, None, None, None, None, None), (2, None, None, "no time", None, None, None, [(None, 0.9)], None), (3, "s", "a", None, "note", "t", None, None, ""), (4, "s", "b", "2024-01-01", "note", "t", None, [("b", None)], "")]
    got = sorted((r["seq"], r["h"], r["displaced_by"]) for r in current_entries(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, None, ""), (2, None, ""), (4, "b", "b")]


def test_hot_key(spark):
    rows = spark.range(3000).select(F.col("id").alias("seq"), F.lit("s").alias("store"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("h"), F.lit("2024-01-01").alias("at"), F.lit("note").alias("kind"),
                                    F.lit("t").alias("topic"), F.lit(None).cast("string").alias("target"), F.array(F.struct(F.lit("hot").alias("target_h"), F.lit(0.8).alias("w"))).alias("displaces"))
    got = current_entries(rows).collect()
    assert [(r["h"], r["displaced_by"]) for r in got] == [("hot", "1")]


def test_instants(spark):
    texts = ["2024-03-01", "2024-03-01T00:00Z", "2024-03-01T02:00:00+02:00", "2024-02-29T19:00:00.000-05:00", "2024-03-01T00:00:00.000000Z", "2024-03-01 00:00:00"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(instant_micros(F.col("t"))).collect()
    assert {r[0] for r in got} == {1709251200000000}
    assert spark.createDataFrame([("soon",), (None,), ("",)], "t string").select(instant_micros(F.col("t"))).distinct().collect()[0][0] is None


def test_merge_changes(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    feed = spark.createDataFrame(
        [("c1", 10, 1, "x", False), ("c2", 5, 1, "old", False), ("c1", 10, 1, "x", False), ("c3", 11, 2, None, True), ("c4", 12, 3, "new", None), ("c5", 13, None, "m", False), ("c6", 1, 4, "gone", True)],
        "cid string, lsn int, k int, v string, del boolean",
    )
    got = {(r["k"], r["v"]) for r in merge_changes(base, feed, ["k"], ["cid"], ["lsn"], F.col("del")).select("k", "v").collect()}
    assert got == {(1, "x"), (3, "new"), (None, "m")}
    assert merge_changes(None, feed.limit(0), ["k"], ["cid"], ["lsn"], F.col("del")).count() == 0
    again = merge_changes(base, feed.unionByName(feed), ["k"], ["cid"], ["lsn"], F.col("del")).select("k", "v")
    assert {tuple(r) for r in again.collect()} == got


def test_written_tables_are_cleared(spark):
    from verbatrix.session import clear_written, materialise

    df = materialise(spark.range(3))
    assert df.count() == 3 and clear_written(spark) >= 1 and clear_written(spark) == 0


def test_feed_as_a_stream(spark, tmp_path):
    from verbatrix.streaming.changes import COLUMNS, FeedTable, follow

    rng = random.Random(8)
    rows = [(i, "s", f"h{rng.randrange(30)}", f"2024-01-0{rng.randrange(1, 9)}", rng.choice(["note", "note", "retract", "keep"]), rng.choice([None, "t", "u"]), f"h{rng.randrange(30)}", [(f"h{rng.randrange(30)}", 0.8)], "x") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in current_entries(df).collect()}
    t = FeedTable(spark, str(tmp_path / "a"))
    for n, part in enumerate((df.filter("seq % 3 = 1"), df.filter("seq % 3 = 0"), df.filter("seq % 3 = 2"), df.limit(0))):
        t.advance(part, n)
        t.advance(part, n)
    assert {tuple(r) for r in t.current().collect()} == want
    src = str(tmp_path / "in")
    df.select(*COLUMNS).repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.select(*COLUMNS).schema).option("maxFilesPerTrigger", 1).parquet(src)
    assert {tuple(r) for r in follow(spark, stream, str(tmp_path / "b")).current().collect()} == want
