"""A session with stores, through the command line's verbs, as a query with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import run
from ..operators import log as L
from ..session import Written, shared_dir
from ..sources.stores import Store


def store_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(verb, name, n): two stores are made and filled from files, one is published and mirrored by the other, they are merged and one is compiled
    anew; questions are attached and entries forgotten."""
    scratch = Written(spark, f"{shared_dir(spark)}/verbatrix/stores-{uuid.uuid4().hex[:10]}")
    a, b = f"{scratch.path}/a", f"{scratch.path}/b"
    out: list[tuple[str, str, int]] = []
    rows = spark.read.parquet(f"{sf_dir}/long_entries.parquet").filter("text is not null")
    for path, odd in ((a, 0), (b, 1)):
        some = rows.filter(F.pmod("entry_id", F.lit(2)) == odd).select(F.to_json(F.struct("text", "topic", "at", "kind")).alias("value"))
        some.write.text(f"{scratch.path}/lines{odd}")
        run(["--store", path, "init", "--dim", "64"], spark)
        said = run(["--store", path, "ingest", "jsonl", f"{scratch.path}/lines{odd}/part-*"], spark)[0]
        out += [("ingest", f"{path[-1]} {k}", said[k]) for k in ("read", "past_horizon", "added")]
    out += [("topics", r["topic"] or "", r["writes"]) for r in run(["--store", a, "topics"], spark)]
    out += [("stats", k, run_[k]) for run_ in run(["--store", a, "stats"], spark) for k in ("entries", "topics", "anonymous")]
    run(["--store", b, "publish"], spark)
    run(["--store", a, "others", "add", b], spark)
    out += [("others", o["name"], 1) for o in run(["--store", a, "others", "list"], spark)]
    out += [("mirror", name, s.log().count()) for name, s in Store(spark, a).readable()[0].items()]
    out.append(("merge", "entries", run(["--store", a, "merge", b, "--out", f"{scratch.path}/both"], spark)[0]["entries"]))
    out.append(("recompile", "entries", run(["--store", a, "recompile", "--model", "hashed", "--dim", "32", "--out", f"{scratch.path}/c"], spark)[0]["entries"]))
    h = Store(spark, b).log().agg(F.min("h")).first()[0]
    out += [("question", str(n), run(["--store", b, "question", h, "what is it?", "what is it?"], spark)[0]["added"]) for n in (1, 2)]
    out.append(("forget", "entries", run(["--store", b, "forget", "--last", "2"], spark)[0]["forgotten"]))
    out.append(("live", "entries", L.live_rows(Store(spark, b).log()).count()))
    scratch.drop()
    return spark.createDataFrame(out, "verb string, name string, n bigint")


QUERIES = {"store_session": store_session}
SQL = {
    "store_session": r"""
WITH r AS (SELECT *, CASE WHEN entry_id % 2 = 0 THEN 'a' ELSE 'b' END AS s, len(list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS words FROM long_entries WHERE text IS NOT NULL),
d AS (SELECT s, "at", topic, text FROM r GROUP BY ALL), n AS (SELECT s, count(*) AS n FROM d GROUP BY s)
SELECT 'ingest' AS verb, s || ' read' AS name, count(*) AS n FROM r GROUP BY s
UNION ALL SELECT 'ingest', s || ' past_horizon', count(*) FILTER (words > 350) FROM r GROUP BY s
UNION ALL SELECT 'ingest', s || ' added', n FROM n
UNION ALL SELECT 'topics', coalesce(topic, ''), count(*) FROM (SELECT * REPLACE (nullif(topic, '') AS topic) FROM d) WHERE s = 'a' GROUP BY topic
UNION ALL SELECT 'stats', 'entries', count(*) FROM d WHERE s = 'a'
UNION ALL SELECT 'stats', 'topics', count(DISTINCT nullif(topic, '')) FROM d WHERE s = 'a'
UNION ALL SELECT 'stats', 'anonymous', count(*) FILTER (coalesce(topic, '') = '') FROM d WHERE s = 'a'
UNION ALL SELECT 'others', 'b', 1
UNION ALL SELECT 'mirror', s, n FROM n
UNION ALL SELECT 'merge', 'entries', count(*) FROM (SELECT "at", topic, text FROM d GROUP BY ALL)
UNION ALL SELECT 'recompile', 'entries', n FROM n WHERE s = 'a'
UNION ALL VALUES ('question', '1', 1), ('question', '2', 0), ('forget', 'entries', 2)
UNION ALL SELECT 'live', 'entries', n - 1 FROM n WHERE s = 'b'
""",
}
