"""Near duplicates and batch checks against plain Python, with edits, copies, chains and hot lists."""

import json
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from verbatrix.llm.batches import AcceptedIndex, Scratch, admit, admit_all, in_one_task, in_rounds
from verbatrix.llm.components import components
from verbatrix.llm.neardup import IndexList, close_links, near_duplicate_groups
from verbatrix.session import Written


def shingles(text, size=3, least=8):
    w = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= least else frozenset()


def close(a, b, t=0.6):
    return bool(a and b) and len(a & b) / len(a | b) >= t


def edited(rng, words, n):
    """Texts of which many are others with small edits, or copies."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w).upper() if rng.random() < 0.2 else ", ".join(w) if rng.random() < 0.1 else " ".join(w))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randrange(4, 30))))
    return out


def groups(rows, t):
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, shingles(x)) for k, x in rows]
    for i, (k, a) in enumerate(sets):
        for m, b in sets[:i]:
            if close(a, b, t):
                x, y = root(k), root(m)
                parent[max(x, y)] = min(x, y)
    by = {}
    for k, _ in rows:
        by.setdefault(root(k), []).append(k)
    return {(r, k) for r, ks in by.items() if len(ks) > 1 for k in ks}


@pytest.mark.parametrize(("seed", "t", "size"), [(1, 0.6, 4000), (2, 0.8, 4000), (3, 0.6, 3)])
def test_groups(spark, words, seed, t, size):
    rng = random.Random(seed)
    rows = list(enumerate(edited(rng, words, 250))) + [(900, None), (901, ""), (902, "too short"), (903, "Ä ß 漢字 ١ x y z w q"), (904, "ä SS! 漢字 ١ x y z w q"), (905, "ä ß 漢字 ١ x y z w q")]
    df = spark.createDataFrame(rows, "seq bigint, text string").withColumn("cid", F.lit("clash")).withColumn("digest", F.lit(1))
    got = {tuple(r) for r in near_duplicate_groups(df, threshold=t, size=3, list_size=size).collect()}
    assert got == groups(rows, t) and len(got) > 50
    assert near_duplicate_groups(df.limit(0)).count() == 0


def test_lists_connect_what_is_close():
    rng = random.Random(7)
    for _ in range(60):
        base = [rng.randrange(40) for _ in range(30)]
        sets = sorted(({99, *(x if rng.random() < 0.85 else rng.randrange(200) for x in base[: rng.randrange(5, 30)])} for _ in range(25)), key=len)
        # position 0 for all: the shared gram is the first of each
        n = [len(s) for s in sets]
        links = IndexList(list(range(25)), n, [0] * 25, [0] * 25, [np.array(sorted(s)) for s in sets], False, 8, 3).links()
        got = groups_of(25, links)
        assert got == groups_of(25, [(i, j) for i in range(25) for j in range(i) if 8 * len(sets[i] & sets[j]) >= 3 * (n[i] + n[j])])
        assert len(links) < 25


def test_few_hash_tables(monkeypatch):
    """The same links where next to no hash tables are kept."""
    rng = random.Random(11)
    sets = sorted(({99, *rng.sample(range(30), 18)} for _ in range(30)), key=len)
    links = lambda: IndexList(list(range(30)), [len(s) for s in sets], [0] * 30, [0] * 30, [np.array(sorted(s)) for s in sets], False, 8, 3).links()
    want = links()
    monkeypatch.setattr("verbatrix.llm.neardup.MOST_HASHED", 20)
    assert links() == want and want


def groups_of(n, links):
    parent = list(range(n))
    for _ in range(n):
        for a, b in links:
            m = min(parent[a], parent[b])
            parent[a] = parent[b] = m
    return parent


def test_hot_list(spark):
    """A third of all rows is one text but for a number: linked without comparing all with all."""
    df = spark.range(900).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("the retry of the upload job to the far store has failed again at step "), "id")).otherwise(F.concat_ws(" ", *[F.md5(F.concat(F.lit(str(i)), F.col("id"))) for i in range(9)])).alias("text"))
    got = near_duplicate_groups(df, threshold=0.6, size=3, list_size=50).collect()
    assert {tuple(r) for r in got} == {(0, i) for i in range(0, 900, 3)}


def test_links_between_classes(spark):
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3, 4]), (3, [7, 8, 9]), (4, [5])], "cid bigint, grams array<bigint>")
    assert [tuple(r) for r in close_links(sets).collect()] == [(1, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame([*links, (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert components(df.limit(0)).count() == 0


# ------------------------------------------------------------------ batches


def accepted(rows, t=0.6):
    ok, out = [], {}
    for k, h, x in rows:
        s = shingles(x)
        hit = [m for m, g, b in ok if (h is not None and h == g) or close(s, b, t)]
        out[k] = min(hit, default=None)
        if not hit:
            ok.append((k, h, s))
    return out


def batch_rows(seed, words, n):
    rng = random.Random(seed)
    texts = edited(rng, words, n)
    return [(i + 1, rng.choice([None, f"h{rng.randrange(n)}", f"h{rng.randrange(n)}", "hot" if i % 3 == 0 else f"h{i}"]), rng.choice([x, x, x, x, None, "", "tiny"])) for i, x in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_admit_in_order(spark, words, seed):
    rows = batch_rows(seed, words, 240)
    df = spark.createDataFrame(rows, "row_id bigint, h string, text string").withColumn("kept", F.lit("clash")).withColumn("cid", F.lit(1))
    want = accepted(rows)
    index = AcceptedIndex(spark, threshold=0.6, size=3, buckets=3)
    got = {}
    assert index.manifest()["buckets"] == 3
    for a, b in ((0, 100), (100, 101), (101, 180), (180, 180), (180, 240)):  # batches, one of them empty
        if a == 180:  # another session goes on
            for t in [t for ts in index.tables.values() for t in ts]:
                spark.sql(f"DROP TABLE {t['name']}")
            index = AcceptedIndex.attach(spark, json.loads(json.dumps(index.manifest())))
        got |= {r["row_id"]: r["kept"] for r in admit(index, df.filter((F.col("row_id") > a) & (F.col("row_id") <= b))).collect()}
    assert got == want
    assert sum(v is not None for v in want.values()) > 60
    index.drop()
    at_once = AcceptedIndex(spark, threshold=0.6, size=3, buckets=2)
    parts = (df.filter((F.col("row_id") > a) & (F.col("row_id") <= b)) for a, b in ((0, 80), (80, 240)))
    assert {r["row_id"]: r["kept"] for got in admit_all(at_once, parts) for r in got.collect()} == want
    at_once.drop()


def test_hot_batch_is_halved(spark, words):
    """A third of the batch is close to each other: the same result, the batch in parts."""
    rng = random.Random(9)
    text = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(300):
        w = text.split()
        w[rng.randrange(30)] = f"n{i}"
        rows.append((i + 1, None, " ".join(w) if i % 3 == 0 else " ".join(rng.choices(words, k=12))))
    index = AcceptedIndex(spark, threshold=0.6, size=3, buckets=2)
    df = spark.createDataFrame(rows, "row_id bigint, h string, text string")
    got = {r["row_id"]: r["kept"] for r in admit(index, df, pairs_per_entry=0).collect()}
    assert got == accepted(rows)
    index.drop()


def test_chain_of_close_texts(spark):
    """Each text is close to the two before it only: decided in one task, and in ranges where that is too many."""
    rows = [(i + 1, None, " ".join(f"w{j}" for j in range(4 * i, 4 * i + 24))) for i in range(1200)]
    df = spark.createDataFrame(rows, "row_id bigint, h string, text string")
    sets = {k: shingles(x) for k, _, x in rows}
    want, ok = {}, []
    for k, s in sets.items():
        want[k] = min((m for m in ok[-3:] if close(s, sets[m], 0.6)), default=None)
        if want[k] is None:
            ok.append(k)
    assert 200 < len(ok) < 900
    for most in (200_000, 500):
        index = AcceptedIndex(spark, threshold=0.6, size=3, buckets=2)
        assert {r["row_id"]: r["kept"] for r in admit(index, df, task_rows=most).collect()} == want
        index.drop()


def test_rounds_equal_one_task(spark):
    rng = random.Random(5)
    nodes = [(i, rng.choice([None, f"h{rng.randrange(60)}"]), rng.choice([None, i, rng.randrange(1, i + 1)])) for i in range(1, 300)]
    near = {(a, b) for a, b in ((rng.randrange(1, 300), rng.randrange(1, 300)) for _ in range(250)) if a != b}
    n = spark.createDataFrame(nodes, "id bigint, h string, cid bigint")
    around = spark.createDataFrame(sorted(near | {(b, a) for a, b in near}), "cid bigint, near bigint")
    one = sorted(map(tuple, in_one_task(n, around).select("id", "kept").collect()))
    for most in (20, 100):
        assert sorted(map(tuple, in_rounds(n, around, most, Scratch()).select("id", "kept").collect())) == one


def test_new_template_in_later_batches(spark, words):
    """A footer that the history lacks is in every text of nine batches: its units rise, no list of the index grows with the batches, tables are
    compacted, and the result is that of plain Python."""
    rng = random.Random(4)
    rows, index, got = [], AcceptedIndex(spark, threshold=0.6, size=3, buckets=2), {}
    longest = []
    for n in range(10):
        new = [(1000 * n + i, None, " ".join(rng.choices(words, k=14)) + (" kept by the night watch" if n else "")) for i in range(60)]
        new += [(1000 * n + 500 + i, None, x) for i, (_, _, x) in enumerate(rng.sample(new, 3))]
        rows += new
        got |= {r["row_id"]: r["kept"] for r in admit(index, spark.createDataFrame(new, "row_id bigint, h string, text string")).collect()}
        longest.append(index.longest_list())
    assert got == accepted(rows)
    assert max(longest[1:]) < 64 and longest[-1] < 2 * longest[2] + 32  # 540 texts bear the footer
    assert all(t["appends"] <= 8 for ts in index.tables.values() for t in ts) and {t["tier"] for t in index.tables["sets"]} == {0, 1}
    # a group over all tables of a kind is one group, though they are bucketed by its key
    own = {r[0] for r in index.files("entries").select("key").collect()}
    both = index.joined("entries", spark.createDataFrame([(k,) for k in own], "key bigint"), ["key", "kept"])
    assert both.groupBy("key").count().count() == len(own)
    index.drop()


def test_written_is_read_without_a_job(spark):
    """A table written between stages is read with the schema it was written with, so no job looks for one."""
    kept = Scratch().keep(spark.range(5).withColumn("x", F.array("id")), "kept")
    spark.sparkContext.setJobGroup("looking", "")
    again = Written(spark, kept.inputFiles()[0].rsplit("/", 1)[0], kept.schema).df
    kept2 = Scratch().keep(again, "again")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("looking"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1 and sorted(kept2.collect()) == sorted(kept.collect())


def test_driver_gives_memory_back(spark, monkeypatch):
    """Between batches the driver collects its garbage and returns native memory; what is admitted is the same."""
    from verbatrix import session
    from verbatrix.llm import batches

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    block = spark.sparkContext._gateway.new_array(spark._jvm.byte, 64 << 20)
    before = runtime.totalMemory() - runtime.freeMemory()
    del block
    assert session.give_back(spark)
    assert runtime.totalMemory() - runtime.freeMemory() < before - (48 << 20)

    calls = []
    monkeypatch.setattr(batches, "give_back", lambda s: calls.append(session.give_back(s)))
    df = spark.createDataFrame([(i, "a" if i in (0, 3) else f"h{i}", None) for i in range(4)], "row_id bigint, h string, text string")
    index = batches.AcceptedIndex(spark, threshold=0.6, size=3)
    got = [r for out in batches.admit_all(index, [df.filter(f"row_id = {i}") for i in range(4)]) for r in out.collect()]
    index.drop()
    assert [(r["row_id"], r["kept"]) for r in got] == [(0, None), (1, None), (2, None), (3, 0)]
    assert calls == [True, True]
