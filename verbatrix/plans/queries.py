"""Every operator as a query over the tables of a folder, with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import identity_column
from ..functions.time import instant_micros
from ..functions.vectors import Lift, bind_rows, cosine, usable
from ..operators import lexical as lex
from ..operators import log as L
from ..operators.changes import merge_changes
from ..operators.fold import fold, gauges, moments, operations
from ..operators.infer import collisions, displacements
from ..operators.relate import relate
from ..operators.retrieve import coarse, currency, families, nominated, resolution
from ..schema import Params, StoreConfig
from ..session import Written, materialise, shared_dir
from ..sources.embed import HashedEmbedder, embed_distinct, embed_missing, text_digest, with_vectors
from ..sources.lines import from_lines, to_lines
from ..sources.translate import chunks, ingest, ledger, sections
from .ask import ranked

DIM = 64
QUESTION = "which store keeps the expired ledger of the quorum"
CUTOFF = "2024-12-31T00:00:00Z"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def log(spark: SparkSession, d: str) -> DataFrame:
    return L.distinct_log(table(spark, d, "entry_log"))


def live_docs(spark: SparkSession, d: str) -> DataFrame:
    return L.live_rows(log(spark, d)).select("store", "seq", "h", X.entry_text(F.col("topic"), F.col("text")).alias("doc"))


# ------------------------------------------------------------------ SQL shared by several queries

INSTANT = r"""epoch_us(CAST(CASE WHEN length("at") = 10 THEN "at" || 'T00:00:00Z' ELSE regexp_replace("at", '^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-]|$)', '\1:00\2') END AS TIMESTAMPTZ))"""
BASE = f"""
WITH log AS (SELECT *, {INSTANT} AS instant FROM entry_log QUALIFY row_number() OVER (PARTITION BY store, h ORDER BY seq) = 1),
gone AS (SELECT DISTINCT store, target AS h FROM log WHERE kind = 'retract' AND target <> ''),
kept AS (SELECT DISTINCT store, target AS h FROM log WHERE kind = 'keep' AND target <> ''),
unretracted AS (SELECT l.* FROM log l ANTI JOIN gone g ON g.store = l.store AND g.h = l.h),
live AS (SELECT * FROM unretracted WHERE coalesce(kind, 'note') NOT IN ('keep', 'retract', 'alias')),
edges AS (SELECT e.store, e.seq, e.h, e.d.target_h AS target_h, e.d.w AS w FROM (SELECT store, seq, h, unnest(displaces) AS d FROM unretracted) e
          ANTI JOIN kept k ON k.store = e.store AND k.h = e.d.target_h)
"""
TOKENS = "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda w: CASE WHEN contains(w, '-') THEN list_concat([w], string_split(w, '-')) ELSE [w] END))"
DOC = "coalesce(topic, '') || ' ' || coalesce(text, '')"
POSTS = f"""
, docs AS (SELECT store, seq, {TOKENS.format(DOC)} AS toks FROM live)
, posts AS (SELECT store, seq, term, count(*) AS tf FROM (SELECT store, seq, unnest(toks) AS term FROM docs) GROUP BY ALL)
, sizes AS (SELECT store, seq, len(toks) AS doc_len FROM docs)
, pool AS (SELECT (SELECT count(*) FROM log) AS n, sum(doc_len) / (SELECT count(*) FROM log) AS avgdl FROM sizes)
, dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term)
, q AS (SELECT item_id, unnest(list_distinct({TOKENS.format("coalesce(text, '')")})) AS term FROM eval_items)
"""
BM25 = """
, scored AS (SELECT q.item_id, p.store, p.seq, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))) AS bm25
  FROM q JOIN posts p USING (term) JOIN dfs USING (term) JOIN sizes s ON s.store = p.store AND s.seq = p.seq CROSS JOIN pool GROUP BY ALL)
"""
GATE = ", gates AS (SELECT item_id, max(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) AS max_idf FROM q LEFT JOIN dfs USING (term) CROSS JOIN pool GROUP BY item_id)"
UNIT_V = "v IS NOT NULL AND len(v) = 64 AND list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0"
UNIT_K = UNIT_V.replace("v IS", "k IS").replace("len(v)", "len(k)").replace("(v,", "(k,")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ the log


@query("SELECT seq, h FROM entry_log")
def entry_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry_log").select("seq", identity_column().alias("h"))


@query("SELECT store, h, min(seq) AS seq FROM entry_log GROUP BY store, h")
def dedupe_append(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("store", "h", "seq")


@query(BASE + "SELECT store, seq, h FROM live")
def retract_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return L.live_rows(log(spark, d)).select("store", "seq", "h")


@query(BASE + "SELECT store, seq, h, target_h, w FROM edges")
def keep_revoke(spark: SparkSession, d: str) -> DataFrame:
    return L.standing_edges(log(spark, d))


@query(BASE + "SELECT store, target_h AS h, max(w) AS displaced FROM edges GROUP BY ALL")
def displaced_max(spark: SparkSession, d: str) -> DataFrame:
    return L.displaced(log(spark, d))


@query(BASE + "SELECT store, seq, h FROM live WHERE coalesce(topic, '') = '' UNION ALL SELECT store, max(seq), max_by(h, seq) FROM live WHERE topic <> '' GROUP BY store, topic")
def latest_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return L.latest_by_topic(log(spark, d)).select("store", "seq", "h")


@query(BASE + """SELECT store, seq, superseded_by FROM (SELECT store, seq, last_value("at") OVER w AS superseded_by, last_value(seq) OVER w AS last FROM live WHERE topic <> ''
  WINDOW w AS (PARTITION BY store, topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE seq <> last""")
def superseded_by(spark: SparkSession, d: str) -> DataFrame:
    return L.superseded(log(spark, d))


@query(BASE + "SELECT store, nullif(topic, '') AS topic, count(*) AS writes, max(seq) AS latest_seq, max_by(h, seq) AS latest_h FROM live GROUP BY store, nullif(topic, '')")
def topic_listing(spark: SparkSession, d: str) -> DataFrame:
    return L.topic_listing(log(spark, d))


@query(BASE + f"SELECT store, seq, h FROM live WHERE instant <= epoch_us(TIMESTAMPTZ '{CUTOFF}')")
def as_of_rows(spark: SparkSession, d: str) -> DataFrame:
    return L.as_of(log(spark, d), CUTOFF).select("store", "seq", "h")


@query(BASE + f"SELECT l.store, l.seq, l.h FROM live l WHERE instant <= epoch_us(TIMESTAMPTZ '{CUTOFF}') AND (coalesce(topic, '') = '' OR seq = (SELECT max(seq) FROM live m WHERE m.store = l.store AND m.topic = l.topic))")
def as_of_current(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    return L.as_of(rows, CUTOFF).join(L.latest_by_topic(rows).select("store", "seq"), ["store", "seq"], "left_semi").select("store", "seq", "h")


@query(BASE + """SELECT n.store, n.seq, n.place, s.superseded_by, x.displaced FROM (
    SELECT store, seq, h, row_number() OVER (PARTITION BY store ORDER BY instant DESC NULLS LAST, seq) AS place FROM unretracted WHERE coalesce(kind, 'note') NOT IN ('keep', 'retract') QUALIFY place <= 20) n
  LEFT JOIN (SELECT l.store, l.seq, m.last_at AS superseded_by FROM live l JOIN (SELECT store, topic, max(seq) AS last, max_by("at", seq) AS last_at FROM live WHERE topic <> '' GROUP BY ALL) m ON m.store = l.store AND m.topic = l.topic AND m.last <> l.seq) s ON s.store = n.store AND s.seq = n.seq
  LEFT JOIN (SELECT store, target_h, max(w) AS displaced FROM edges GROUP BY ALL) x ON x.store = n.store AND x.target_h = n.h""")
def log_newest(spark: SparkSession, d: str) -> DataFrame:
    return L.newest(log(spark, d)).select("store", "seq", "place", "superseded_by", "displaced")


@query(BASE + "SELECT store, count(*) AS entries, count(DISTINCT nullif(topic, '')) AS topics, count(*) FILTER (coalesce(topic, '') = '') AS anonymous FROM log GROUP BY store")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return L.stats(log(spark, d))


@query(BASE + "SELECT substr(h, 1, 5) AS prefix, min(h) AS h FROM live GROUP BY 1 HAVING count(DISTINCT h) = 1")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = L.live_rows(log(spark, d)).select(F.substring("h", 1, 5).alias("prefix"), "h").distinct()
    return rows.groupBy("prefix").agg(F.count("*").alias("c"), F.min("h").alias("h")).filter("c = 1").drop("c")


@query(BASE + "SELECT a.store, a.seq AS alias_seq, l.seq AS parent_seq FROM unretracted a JOIN live l ON l.store = a.store AND l.h = a.target WHERE a.kind = 'alias'")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    return L.alias_parents(log(spark, d))


@query(BASE + """, asked AS (SELECT store, h, unnest(questions) AS question FROM log UNION SELECT store, h, 'what of ' || topic FROM live WHERE topic <> '')
  SELECT store, h, question FROM asked a WHERE question IS NOT NULL AND NOT EXISTS (SELECT 1 FROM log l WHERE l.kind = 'alias' AND l.store = a.store AND l.target = a.h AND l.text = a.question)""")
def fresh_questions(spark: SparkSession, d: str) -> DataFrame:
    """Of the questions that entries came with, all attached, and one about each topic: those that are new."""
    rows = log(spark, d)
    asked = L.question_rows(rows).select("store", "target", "text")
    more = L.live_rows(rows).filter("topic <> ''").select("store", F.col("h").alias("target"), F.concat(F.lit("what of "), "topic").alias("text"))
    return L.fresh_questions(rows, asked.unionByName(more)).select("store", F.col("target").alias("h"), F.col("text").alias("question"))


@query("SELECT e.store, e.seq, q.question FROM (SELECT store, seq, questions FROM entry_log QUALIFY row_number() OVER (PARTITION BY store, h ORDER BY seq) = 1) e, (SELECT unnest(e.questions) AS question) q WHERE q.question IS NOT NULL GROUP BY ALL")
def question_addresses(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).select("store", "seq", F.explode(F.array_distinct("questions")).alias("question")).filter("question is not null")


@query(f"""WITH cfg AS (SELECT name, md5(concat_ws('|', model, dim, seed, coalesce(CAST(sigma AS VARCHAR), ''), d_embed, CAST(beta AS DECIMAL(10, 4)))) AS cfg FROM stores),
  tagged AS (SELECT e.*, c.cfg, {INSTANT} AS instant FROM entry_log e JOIN cfg c ON c.name = e.store),
  one AS (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY cfg, h ORDER BY store, seq) = 1)
  SELECT cfg, store AS source, seq AS source_seq, h, row_number() OVER (PARTITION BY cfg ORDER BY instant, h) AS ordinal FROM one""")
def merge_stores(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("model"), F.col("dim").cast("string"), F.col("seed").cast("string"), F.coalesce(F.col("sigma").cast("string"), F.lit("")), F.col("d_embed").cast("string"), F.col("beta").cast("decimal(10,4)").cast("string")]
    cfg = table(spark, d, "stores").select(F.col("name").alias("store"), F.md5(F.concat_ws("|", *parts)).alias("cfg"))
    rows = table(spark, d, "entry_log").join(cfg, "store")
    out = L.merge_logs(rows, F.col("cfg"), F.col("source"))
    return out.select("cfg", "source", "source_seq", "h", F.col("seq").alias("ordinal"))


@query("""WITH me AS (SELECT * FROM stores ORDER BY name LIMIT 1)
  SELECT s.name, (s.model = me.model AND s.dim = me.dim AND s.seed = me.seed AND s.sigma IS NOT DISTINCT FROM me.sigma AND s.d_embed = me.d_embed AND s.beta = me.beta) AS readable FROM stores s CROSS JOIN me""")
def config_compatible(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "stores")
    keys = ["model", "dim", "seed", "sigma", "d_embed", "beta"]
    me = s.orderBy("name").limit(1).select(*(F.col(k).alias(f"my_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"my_{k}"))
    return s.crossJoin(F.broadcast(me)).select("name", same.alias("readable"))


@query(BASE + """, me AS (SELECT * FROM stores ORDER BY name LIMIT 1), ok AS (SELECT s.name FROM stores s, me WHERE s.model = me.model AND s.dim = me.dim AND s.seed = me.seed AND s.sigma IS NOT DISTINCT FROM me.sigma AND s.d_embed = me.d_embed AND s.beta = me.beta)
  SELECT store, seq, h FROM live WHERE store IN (SELECT name FROM ok)""")
def federated_union(spark: SparkSession, d: str) -> DataFrame:
    ok = config_compatible(spark, d).filter("readable").select(F.col("name").alias("store"))
    return L.live_rows(log(spark, d)).join(ok, "store", "left_semi").select("store", "seq", "h")


# ------------------------------------------------------------------ text


@query("""SELECT seq, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) > 20 AS past FROM entry_log""".replace("\\\\", "\\"))
def past_horizon(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry_log").select("seq", X.past_horizon(F.col("text"), 20).alias("past"))


@query(r"""SELECT seq, CASE WHEN coalesce(topic, '') = '' THEN NULL WHEN trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'intro' ELSE trim(regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
  regexp_replace(store, '[^A-Za-z0-9._-]', '-', 'g') AS store_slug FROM entry_log""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.coalesce("topic", F.lit("")) != "", F.col("topic"))
    return table(spark, d, "entry_log").select("seq", F.when(t.isNotNull(), X.heading_slug(t)).alias("slug"), X.name_slug(F.col("store")).alias("store_slug"))


@query(r"""WITH w AS (SELECT entry_id, topic, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM long_entries)
  SELECT entry_id, CASE WHEN coalesce(topic, '') = '' THEN array_to_string(ws[1:15], ' ') || CASE WHEN len(ws) > 15 THEN '…' ELSE '' END
    WHEN contains(topic, '#') THEN regexp_replace(regexp_replace(topic, '#[^#]*$', ''), '^.*/', '') || '#' || string_split(topic, '#')[-1] ELSE topic END AS gloss FROM w""")
def glosses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "long_entries").select("entry_id", X.gloss(F.col("topic"), F.col("text")).alias("gloss"))


@query(BASE + ", s AS (SELECT store, max(w) AS w FROM edges GROUP BY store) SELECT store, w, CASE WHEN w >= 0.88 THEN 'near-restatement' WHEN w >= 0.80 THEN 'strong overlap' ELSE 'borderline' END AS reading, CASE WHEN w >= 0.65 THEN 'settled' WHEN w < 0.55 THEN 'unwritten' ELSE 'sparse' END AS verdict FROM s")
def reading_bands(spark: SparkSession, d: str) -> DataFrame:
    s = L.standing_edges(log(spark, d)).groupBy("store").agg(F.max("w").alias("w"))
    return s.withColumn("reading", X.attenuation_reading(F.col("w"))).withColumn("verdict", X.verdict(F.col("w")))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'Note' ELSE 'ForkRuled' END AS kind, CAST(user_id AS VARCHAR) AS topic, CASE WHEN event_type = 'click' THEN props ELSE 'fork ' || user_id || ' ruled: ' || event_type END AS text FROM events WHERE event_type IN ('click', 'purchase')""")
def ledger_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tag = F.when(F.col("event_type") == "click", F.lit("Note")).when(F.col("event_type") == "purchase", F.lit("ForkRuled")).otherwise(F.col("event_type"))
    lines = e.select(F.to_json(F.struct(tag.alias("_tag"), F.col("event_id").cast("string").alias("at"), F.col("user_id").cast("string").alias("node"), F.col("props").alias("text"), F.col("event_type").alias("choice"))).alias("value"))
    return ledger(lines).select(F.col("at").cast("bigint").alias("event_id"), "kind", "topic", "text")


def _cut(spark: SparkSession, d: str, how) -> DataFrame:  # noqa: ANN001
    from ..sources.translate import _by_file

    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("at").cast("string").alias("at"), "text")
    return _by_file(files, how).select("topic", "text")


WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PARTS = rf"""
WITH lines AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM documents WHERE text IS NOT NULL))),
marked AS (SELECT *, regexp_matches(line, '^#{{1,3}}{WS}') AS head, sum(CASE WHEN regexp_matches(line, '^#{{1,3}}{WS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM lines),
parts AS (SELECT doc_id, part, coalesce(max(CASE WHEN head THEN regexp_replace(regexp_replace(line, '^#{{1,3}}{WS}+', ''), '{WS}+$', '') END), 'intro') AS heading,
  regexp_replace(regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^{WS}+', ''), '{WS}+$', '') AS body FROM marked GROUP BY doc_id, part)
"""


@query(PARTS + r"""SELECT doc_id || '#' || CASE WHEN trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'intro' ELSE trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') END AS topic,
  CASE WHEN heading = 'intro' THEN body ELSE heading || chr(10) || body END AS text FROM parts WHERE length(body) >= 50""")
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, sections)


@query(PARTS.replace("WITH lines", "WITH RECURSIVE lines") + rf"""
, slugged AS (SELECT *, CASE WHEN trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'intro' ELSE trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM parts),
ps AS (SELECT doc_id, part, j, regexp_replace(regexp_replace(qs[j], '^{WS}+', ''), '{WS}+$', '') AS p FROM (SELECT doc_id, part, qs, unnest(range(1, len(qs) + 1)) AS j FROM (SELECT doc_id, part, regexp_split_to_array(body, '\n{WS}*\n') AS qs FROM slugged
    WHERE slug NOT IN ('contents', 'table-of-contents', 'list-of-tables', 'list-of-figures', 'index')))),
pn AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id, part ORDER BY j) AS j, p, len(list_filter(regexp_split_to_array(p, '{WS}+'), lambda x: x <> '')) AS n FROM ps WHERE p <> ''),
packed AS (SELECT doc_id, part, j, p, 1 AS chunk, 300 - n AS room FROM pn WHERE j = 1
  UNION ALL SELECT x.doc_id, x.part, x.j, x.p, CASE WHEN x.n <= k.room THEN k.chunk ELSE k.chunk + 1 END, CASE WHEN x.n <= k.room THEN k.room - x.n ELSE 300 - x.n END FROM packed k JOIN pn x ON x.doc_id = k.doc_id AND x.part = k.part AND x.j = k.j + 1),
made AS (SELECT doc_id, part, chunk, string_agg(p, chr(10) || chr(10) ORDER BY j) AS c FROM packed GROUP BY ALL),
kept_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id, part ORDER BY chunk) AS no FROM made WHERE length(c) >= 50)
SELECT doc_id || '#' || slug || CASE WHEN no = 1 THEN '' ELSE '/' || no END AS topic, CASE WHEN heading = 'intro' THEN c ELSE heading || chr(10) || c END AS text FROM kept_ JOIN slugged USING (doc_id, part)""")
def paper_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d, chunks)


# ------------------------------------------------------------------ lexical


@query(BASE + POSTS + "SELECT store, seq, term, tf FROM posts")
def tf_postings(spark: SparkSession, d: str) -> DataFrame:
    return lex.postings(live_docs(spark, d), ["store", "seq"], F.col("doc"))


@query(BASE + POSTS + "SELECT term, df FROM dfs")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tf_postings(spark, d).groupBy("term").agg(F.count("*").alias("df"))


@query(BASE + POSTS + "SELECT count(*) AS n, round(sum(coalesce(doc_len, 0)) / count(*), 9) AS avgdl FROM log LEFT JOIN sizes USING (store, seq)")
def doc_stats(spark: SparkSession, d: str) -> DataFrame:
    return lex.pool_stats(_all_lengths(log(spark, d), live_docs(spark, d))).withColumn("avgdl", F.round("avgdl", 9))


def _all_lengths(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(store, seq, doc_len) of every row of the log; rows that aren't searched are empty."""
    size = rows.select("store", "seq").join(lex.lengths(docs, ["store", "seq"], F.col("doc")), ["store", "seq"], "left")
    return size.withColumn("doc_len", F.coalesce("doc_len", F.lit(0)))


def _questions(spark: SparkSession, d: str) -> tuple:
    docs = materialise(live_docs(spark, d), "docs")
    key = ["store", "seq"]
    return lex.question_terms(table(spark, d, "eval_items"), "item_id", F.col("text")), materialise(lex.postings(docs, key, F.col("doc")), "postings"), _all_lengths(log(spark, d), docs), key


@query(BASE + POSTS + BM25 + "SELECT item_id, store, seq, round(bm25, 6) AS bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, store, seq) AS rank FROM scored) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    terms, posts, size, key = _questions(spark, d)
    return lex.top_documents(lex.bm25(terms, "item_id", posts, size, key), "item_id", key, "bm25", 10).withColumn("bm25", F.round("bm25", 6))


@query(BASE + POSTS + GATE + "SELECT item_id, round(max_idf, 6) AS max_idf, round(least(1, greatest(0, (max_idf - 3) / 3)), 6) AS gate FROM gates")
def idf_gate(spark: SparkSession, d: str) -> DataFrame:
    terms, posts, size, _ = _questions(spark, d)
    return lex.gate(terms, "item_id", posts, size).withColumn("max_idf", F.round("max_idf", 6)).withColumn("gate", F.round("gate", 6))


# ------------------------------------------------------------------ dense

HASHED = f"""
, words AS (SELECT DISTINCT term, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % {DIM} AS bucket, CASE WHEN ('0x' || substr(sha256(term), 9, 1))::UBIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign
    FROM (SELECT unnest({TOKENS.format("t")}) AS term FROM (SELECT DISTINCT t FROM (SELECT text AS t FROM log UNION ALL SELECT topic FROM log UNION ALL SELECT '{QUESTION}')) WHERE t IS NOT NULL))
, qv AS (SELECT bucket, sum(sign) AS x FROM (SELECT unnest({TOKENS.format(f"'{QUESTION}'")}) AS term) JOIN words USING (term) GROUP BY bucket)
, vv AS (SELECT store, seq, bucket, sum(sign) AS x FROM (SELECT store, seq, unnest({TOKENS.format("coalesce(text, '')")}) AS term FROM live) JOIN words USING (term) GROUP BY ALL)
, kv AS (SELECT store, seq, bucket, sum(sign) AS x FROM (SELECT store, seq, unnest({TOKENS.format("CASE WHEN topic <> '' THEN topic ELSE coalesce(text, '') END")}) AS term FROM live) JOIN words USING (term) GROUP BY ALL)
, cv AS (SELECT store, seq, sum(vv.x * qv.x) / nullif(sqrt(sum(vv.x * vv.x)) * (SELECT sqrt(sum(x * x)) FROM qv), 0) AS c FROM vv LEFT JOIN qv USING (bucket) GROUP BY ALL)
, ck AS (SELECT store, seq, sum(kv.x * qv.x) / nullif(sqrt(sum(kv.x * kv.x)) * (SELECT sqrt(sum(x * x)) FROM qv), 0) AS c FROM kv LEFT JOIN qv USING (bucket) GROUP BY ALL)
, av AS (SELECT a.store, l.seq, a.seq AS alias_seq, a.text FROM unretracted a JOIN live l ON l.store = a.store AND l.h = a.target WHERE a.kind = 'alias' AND a.text IS NOT NULL)
, at_ AS (SELECT store, seq, alias_seq, bucket, sum(sign) AS x FROM (SELECT store, seq, alias_seq, unnest({TOKENS.format("text")}) AS term FROM av) JOIN words USING (term) GROUP BY ALL)
, ca AS (SELECT store, seq, max(c) AS c FROM (SELECT store, seq, alias_seq, sum(at_.x * qv.x) / nullif(sqrt(sum(at_.x * at_.x)) * (SELECT sqrt(sum(x * x)) FROM qv), 0) AS c FROM at_ LEFT JOIN qv USING (bucket) GROUP BY ALL) GROUP BY ALL)
, res AS (SELECT l.store, l.seq, greatest(coalesce(cv.c, 0), coalesce(ck.c, 0), ca.c) AS res FROM live l LEFT JOIN cv USING (store, seq) LEFT JOIN ck USING (store, seq) LEFT JOIN ca USING (store, seq) WHERE l.text IS NOT NULL)
"""


def hashed_vectors(rows: DataFrame) -> DataFrame:
    """(store, h, k, v) by the built-in embedder; distinct texts are embedded once."""
    r = rows.select("store", "h", "text", F.when(F.col("topic") != "", F.col("topic")).otherwise(F.col("text")).alias("address"))
    e = materialise(embed_distinct(r.select("text").unionByName(r.select(F.col("address").alias("text"))), "hashed", DIM), "embedded")
    return with_vectors(with_vectors(r, "text", "v", e), "address", "k", e).select("store", "h", "k", "v")


def question_vector() -> np.ndarray:
    return HashedEmbedder(DIM).passages([QUESTION])[0]


def spoken(rows: DataFrame) -> DataFrame:
    """The rows that have vectors: entries and aliases."""
    return rows.filter(~F.coalesce("kind", F.lit("note")).isin("keep", "retract"))


@query(BASE + HASHED + "SELECT store, seq, round(res, 5) AS res FROM res ORDER BY round(res, 5) DESC, store, seq LIMIT 50")
def resolution_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    res = resolution(rows, hashed_vectors(spoken(rows)), question_vector())
    return res.select("store", "seq", F.round("res", 5).alias("res")).orderBy(F.desc("res"), "store", "seq").limit(50)


@query(BASE + HASHED + "SELECT store, round(max(res), 2) AS support, CASE WHEN max(res) >= 0.65 THEN 'settled' WHEN max(res) < 0.55 THEN 'unwritten' ELSE 'sparse' END AS verdict FROM res GROUP BY store")
def support_verdict(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    best = resolution(rows, hashed_vectors(spoken(rows)), question_vector()).groupBy("store").agg(F.max("res").alias("s"))
    return best.select("store", F.round("s", 2).alias("support"), X.verdict(F.col("s")).alias("verdict"))


ONE = f"""
, docs AS (SELECT store, seq, {TOKENS.format(DOC)} AS toks FROM live)
, posts AS (SELECT store, seq, term, count(*) AS tf FROM (SELECT store, seq, unnest(toks) AS term FROM docs) GROUP BY ALL)
, sizes AS (SELECT store, seq, len(toks) AS doc_len FROM docs)
, pool AS (SELECT (SELECT count(*) FROM log) AS n, sum(doc_len) / (SELECT count(*) FROM log) AS avgdl FROM sizes)
, dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term)
, q AS (SELECT DISTINCT unnest({TOKENS.format(f"'{QUESTION}'")}) AS term)
, weight AS (SELECT least(1, greatest(0, (max(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) - 3) / 3)) AS gate FROM q LEFT JOIN dfs USING (term) CROSS JOIN pool)
, scored AS (SELECT p.store, p.seq, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))) AS bm25
  FROM q JOIN posts p USING (term) JOIN dfs USING (term) JOIN sizes s ON s.store = p.store AND s.seq = p.seq CROSS JOIN pool GROUP BY ALL)
, both_ AS (SELECT r.store, r.seq, round(r.res, 5) AS res, round(coalesce(s.bm25, 0), 9) AS bm25 FROM res r LEFT JOIN scored s USING (store, seq))
, placed AS (SELECT *, row_number() OVER (ORDER BY res DESC, store, seq) AS r1, row_number() OVER (ORDER BY bm25 DESC, store, seq) AS r2 FROM both_)
"""


@query(BASE + HASHED + ONE + "SELECT store, seq, round(1.0 / (59 + r1) + CASE WHEN bm25 > 0 AND gate > 0 THEN gate / (59 + r2) ELSE 0 END, 9) AS fused FROM placed CROSS JOIN weight")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Both arms fused by rank, for every live row."""
    rows = log(spark, d)
    key = ["store", "seq"]
    docs = materialise(live_docs(spark, d), "docs")
    posts, size = materialise(lex.postings(docs, key, F.col("doc")), "postings"), _all_lengths(rows, docs)
    terms = lex.question_terms(spark.createDataFrame([(1, QUESTION)], "qid int, text string"), "qid", F.col("text"))
    res = resolution(rows, hashed_vectors(spoken(rows)), question_vector()).withColumn("res", F.round("res", 5))
    pool = res.join(lex.bm25(terms, "qid", posts, size, key).drop("qid"), key, "left").crossJoin(F.broadcast(lex.gate(terms, "qid", posts, size).select("gate")))
    out = lex.fused(pool.withColumn("all_", F.lit(1)).withColumn("bm25", F.coalesce("bm25", F.lit(0.0))), ["all_"], "res", "bm25", "gate", key)
    return out.select("store", "seq", F.round("fused", 9).alias("fused"))


@query(BASE + HASHED + "SELECT store, seq, round(res, 5) AS res FROM res ORDER BY round(res, 5) DESC, store, seq LIMIT 50")
def prefilter_rescore(spark: SparkSession, d: str) -> DataFrame:
    """The best by a coarse scan of half the width, with the rows that have the question's rare terms, rescored exactly."""
    rows = log(spark, d)
    vec = materialise(hashed_vectors(spoken(rows)), "vec")
    q, p = question_vector(), Params(prefilter_dim=DIM // 2)
    posts = lex.postings(live_docs(spark, d), ["store", "seq", "h"], F.col("doc"))
    terms = lex.question_terms(spark.createDataFrame([(1, QUESTION)], "qid int, text string"), "qid", F.col("text"))
    few = nominated(materialise(coarse(vec, DIM, 7, p), "coarse"), q, DIM, 7, lex.rare_rows(terms, posts, p), p)
    return resolution(rows, vec, q, few).select("store", "seq", F.round("res", 5).alias("res")).orderBy(F.desc("res"), "store", "seq").limit(50)


@query("SELECT substr(sha256(text), 1, 32) AS digest, count(*) AS uses FROM entry_log WHERE text IS NOT NULL GROUP BY 1")
def embedding_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entry_log").filter("text is not null").groupBy(text_digest().alias("digest")).agg(F.count("*").alias("uses"))


@query("SELECT lang, count(DISTINCT text) AS misses FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entry_log e WHERE e.text = d.text) GROUP BY lang")
def embedding_misses(spark: SparkSession, d: str) -> DataFrame:
    """What embedding the documents adds to a cache of the log's texts, by language."""
    cache = embed_distinct(table(spark, d, "entry_log").select("text"), "hashed", DIM)
    docs = table(spark, d, "documents").filter("text is not null").select("lang", "text")
    new = embed_missing(docs.select("text"), cache, embedder="hashed", dim=DIM).select("digest")
    return docs.withColumn("digest", text_digest()).join(new, "digest").groupBy("lang").agg(F.countDistinct("digest").alias("misses"))


@query(f"""WITH u AS (SELECT store, list_transform(k, lambda x: x / sqrt(list_aggregate(list_transform(k, lambda y: y::DOUBLE * y::DOUBLE), 'sum'))) AS k FROM vectors WHERE {UNIT_K}),
  e AS (SELECT store, unnest(k) AS x, generate_subscripts(k, 1) AS i FROM u), s AS (SELECT store, i, sum(x) AS sum, sum(x * x) AS sq, count(*) AS n FROM e GROUP BY ALL)
  SELECT store, max(n) AS n, round(sum(sq), 4) AS trace, round(sqrt(sum(sum * sum)) / max(n), 5) AS mean_length FROM s GROUP BY store""")
def second_moment(spark: SparkSession, d: str) -> DataFrame:
    m = moments(table(spark, d, "vectors"), "k", DIM)
    return m.withColumn("trace", F.round("trace", 4)).withColumn("mean_length", F.round("mean_length", 5))


@query(BASE + f""", keyed AS (SELECT l.store, l.seq, l.h, coalesce(l.topic, '') = '' AS asks, list_transform(v.k, lambda x: x::DOUBLE) AS k FROM live l JOIN (SELECT DISTINCT ON (store, h) store, h, k FROM vectors WHERE {UNIT_K}) v USING (store, h))
  SELECT store, seq, h, target_h, round(least(0.9, c), 3) AS w FROM (SELECT a.store, a.seq, a.h, b.seq AS target_seq, b.h AS target_h, round(list_cosine_similarity(a.k, b.k), 9) AS c FROM keyed a JOIN keyed b ON a.store = b.store AND b.seq < a.seq AND a.asks)
  WHERE c >= 0.72 QUALIFY row_number() OVER (PARTITION BY store, seq ORDER BY c DESC, target_seq) <= 3""")
def causal_displacement(spark: SparkSession, d: str) -> DataFrame:
    return displacements(table(spark, d, "entry_log"), table(spark, d, "vectors"), DIM).select("store", "seq", "h", "target_h", "w")


@query(BASE + f""", held AS (SELECT store, topic, max(seq) AS seq, max_by(h, seq) AS prior_h FROM live WHERE topic <> '' GROUP BY store, topic), vv AS (SELECT DISTINCT ON (store, h) store, h, v FROM vectors WHERE {UNIT_V})
  SELECT n.store, n.h, n.topic, x.prior_h, round(list_cosine_similarity(list_transform(a.v, lambda x: x::DOUBLE), list_transform(b.v, lambda x: x::DOUBLE)), 6) AS cosine,
    list_cosine_similarity(list_transform(a.v, lambda x: x::DOUBLE), list_transform(b.v, lambda x: x::DOUBLE)) < 0.55 AS unrelated
  FROM live n JOIN held x ON x.store = n.store AND x.topic = n.topic JOIN vv a ON a.store = n.store AND a.h = n.h JOIN vv b ON b.store = n.store AND b.h = x.prior_h""")
def topic_collisions(spark: SparkSession, d: str) -> DataFrame:
    rows = log(spark, d)
    vec = table(spark, d, "vectors").filter(usable(F.col("v"), DIM)).dropDuplicates(["store", "h"])
    new = L.live_rows(rows).filter("topic <> ''").select("store", "h", "topic").join(vec.select("store", "h", "v"), ["store", "h"])
    return collisions(rows, new, vec).withColumn("cosine", F.round("cosine", 6))


# ------------------------------------------------------------------ the fold


def _one_hot(spark: SparkSession, d: str) -> DataFrame:
    """Events as writes: the key is the event type's axis (8 of them), the value (value, 1, 0 ...)."""
    axis = F.array(*[F.when(F.pmod(F.col("a"), F.lit(8)) == i, 1.0).otherwise(0.0) for i in range(8)])
    e = table(spark, d, "events").withColumn("a", F.length("event_type"))
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("store"), F.col("event_id").alias("seq"), F.lit(0).cast("bigint").alias("sub"), F.lit("write").alias("op"),
        axis.alias("k"), F.array(F.col("value"), F.lit(1.0), *[F.lit(0.0)] * 6).alias("v"), F.lit(0.0).alias("w"), "a",
    )


def _columns(states: DataFrame) -> DataFrame:
    """(store, axis, x, y): the first two numbers of each column of S."""
    s = states.select("store", "s", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("axis"))
    return s.select("store", "axis", F.round(F.element_at("s", F.col("axis") + 1), 6).alias("x"), F.round(F.element_at("s", F.col("axis") + 9), 6).alias("y"))


HOT = "WITH e AS (SELECT 'u' || (user_id % 7) AS store, event_id AS seq, length(event_type) % 8 AS axis, value FROM events), axes AS (SELECT store, unnest(range(8))::INT AS axis FROM (SELECT DISTINCT store FROM e))"


@query(HOT + " SELECT a.store, a.axis, round(coalesce(max_by(e.value, e.seq), 0), 6) AS x, CASE WHEN count(e.seq) > 0 THEN 1.0 ELSE 0.0 END AS y FROM axes a LEFT JOIN e ON e.store = a.store AND e.axis = a.axis GROUP BY a.store, a.axis")
def fold_last_write(spark: SparkSession, d: str) -> DataFrame:
    return _columns(fold(_one_hot(spark, d).drop("a"), 8, 1.0, unit=False))


@query(HOT + """, w AS (SELECT *, 0.5 * power(0.5, row_number() OVER (PARTITION BY store, axis ORDER BY seq DESC) - 1) AS f FROM e)
  SELECT a.store, a.axis, round(coalesce(sum(w.value * w.f), 0), 6) AS x, round(coalesce(sum(w.f), 0), 6) AS y FROM axes a LEFT JOIN w ON w.store = a.store AND w.axis = a.axis GROUP BY a.store, a.axis""")
def fold_soft_beta(spark: SparkSession, d: str) -> DataFrame:
    return _columns(fold(_one_hot(spark, d).drop("a"), 8, 0.5, unit=False))


@query(HOT + """, last AS (SELECT store, axis, max(seq) AS seq, max_by(value, seq) AS value FROM e GROUP BY ALL), erased AS (SELECT l.store, l.axis, l.value, power(0.75, (SELECT count(*) FROM e x WHERE x.store = l.store AND x.axis = l.axis + 1 AND x.seq > l.seq)) AS f FROM last l)
  SELECT a.store, a.axis, round(coalesce(w.value * w.f, 0), 6) AS x, round(coalesce(w.f, 0), 6) AS y FROM axes a LEFT JOIN erased w ON w.store = a.store AND w.axis = a.axis""")
def fold_erase(spark: SparkSession, d: str) -> DataFrame:
    """Every write first takes a quarter off what stands at the axis before its own."""
    ops = _one_hot(spark, d)
    before = F.array(*[F.when(F.pmod(F.col("a"), F.lit(8)) - 1 == i, 1.0).otherwise(0.0) for i in range(8)])
    erase = ops.withColumn("k", before).withColumn("op", F.lit("erase")).withColumn("w", F.lit(0.25)).withColumn("sub", F.lit(-1).cast("bigint"))
    return _columns(fold(ops.unionByName(erase).drop("a"), 8, 1.0, unit=False))


# ------------------------------------------------------------------ the fold in SQL

#: From vv_ (store, h, k, v as doubles): the fold's operations in order and every store's state after each of them.
UNIT = "list_transform({0}, lambda x: x / CASE WHEN list_inner_product({0}, {0}) > 0 THEN sqrt(list_inner_product({0}, {0})) ELSE 1 END)"
STATES = f"""
, unit_ AS (SELECT store, h, {UNIT.format("k")} AS k, {UNIT.format("v")} AS v FROM vv_)
, ops_ AS (
  SELECT store, seq, NULL::VARCHAR AS target_h, k, v, 0.0::DOUBLE AS w FROM written JOIN unit_ USING (store, h)
  UNION ALL SELECT e.store, e.seq, e.target_h, u.k, NULL::DOUBLE[], e.w FROM edges e JOIN unretracted t ON t.store = e.store AND t.h = e.target_h JOIN unit_ u ON u.store = e.store AND u.h = e.target_h
    WHERE (e.store, e.seq) IN (SELECT (store, seq) FROM written)
)
, placed_ops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq, target_h NULLS LAST) AS rn FROM ops_)
, st AS (
  SELECT store, 0::BIGINT AS rn, list_transform(range({DIM * DIM}), lambda x: 0.0::DOUBLE) AS s FROM (SELECT DISTINCT store FROM placed_ops)
  UNION ALL
  SELECT store, rn, list_transform(range({DIM * DIM}), lambda x: s[x + 1] + r[x // {DIM} + 1] * k[x % {DIM} + 1]) FROM (
    SELECT st.store, o.rn, st.s, o.k, list_transform(range({DIM}), lambda i: (CASE WHEN o.v IS NULL THEN -o.w * list_inner_product(st.s[i * {DIM} + 1 : i * {DIM} + {DIM}], o.k) ELSE o.v[i + 1] - list_inner_product(st.s[i * {DIM} + 1 : i * {DIM} + {DIM}], o.k) END)) AS r
    FROM st JOIN placed_ops o ON o.store = st.store AND o.rn = st.rn + 1)
)
, states AS (SELECT store, arg_max(s, rn) AS s FROM st GROUP BY store)
"""
RECURSIVE = BASE.replace("WITH log", "WITH RECURSIVE log")
GIVEN = f", vv_ AS (SELECT DISTINCT ON (store, h) store, h, list_transform(k, lambda x: x::DOUBLE) AS k, list_transform(v, lambda x: x::DOUBLE) AS v FROM vectors WHERE k IS NOT NULL AND v IS NOT NULL AND len(k) = {DIM} AND len(v) = {DIM})"
SHOWN = f"""
, counted AS (SELECT store, count(*) AS n, list(k) AS ks FROM written JOIN unit_ USING (store, h) GROUP BY store)
, gram AS (SELECT a.store, sum(list_inner_product(a.k, b.k)) AS ksum, sum(list_inner_product(a.k, b.k) * list_inner_product(a.k, b.k)) AS lam FROM (SELECT * FROM written JOIN unit_ USING (store, h)) a JOIN (SELECT * FROM written JOIN unit_ USING (store, h)) b ON a.store = b.store GROUP BY a.store)
SELECT store, n, round(list_sum(list_transform(range({DIM}), lambda i: s[i * {DIM + 1} + 1])), 6) AS trace, round(list_inner_product(s, s), 6) AS energy,
  round(list_sum(list_transform(range({DIM * DIM}), lambda i: s[i + 1] * (i % 7 + 1))), 5) AS mixed, round(lam, 5) AS lam_energy, round(sqrt(ksum), 6) AS ksum_length
FROM states JOIN counted USING (store) JOIN gram USING (store)
"""


def _shown(states: DataFrame) -> DataFrame:
    """Figures that together say what a state is: of S its trace, its energy and a weighted sum, the second moment's energy, the keys' sum."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    energy = lambda c: total(F.transform(c, lambda x: x * x))
    return states.select(
        "store", "n", F.round(total(F.filter("s", lambda x, i: i % (DIM + 1) == 0)), 6).alias("trace"), F.round(energy("s"), 6).alias("energy"),
        F.round(total(F.transform("s", lambda x, i: x * (i % 7 + 1))), 5).alias("mixed"), F.round(energy("lam"), 5).alias("lam_energy"), F.round(F.sqrt(energy("ksum")), 6).alias("ksum_length"),
    )


@query(RECURSIVE + GIVEN + ", written AS (SELECT * FROM live)" + STATES + SHOWN)
def fold_state(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fold(operations(log(spark, d), table(spark, d, "vectors")), DIM))


@query(RECURSIVE + GIVEN + f", written AS (SELECT * FROM live WHERE instant <= epoch_us(TIMESTAMPTZ '{CUTOFF}'))" + STATES + SHOWN)
def fold_time_travel(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fold(operations(log(spark, d), table(spark, d, "vectors"), CUTOFF), DIM))


@query(BASE + GIVEN + """, written AS (SELECT * FROM live), unit_ AS (SELECT store, h, """ + UNIT.format("k") + """ AS k FROM vv_)
SELECT store, seq, 'write' AS op, NULL::VARCHAR AS target_h, 0.0::DOUBLE AS w FROM written JOIN unit_ USING (store, h)
UNION ALL SELECT e.store, e.seq, 'erase', e.target_h, e.w FROM edges e JOIN unretracted t ON t.store = e.store AND t.h = e.target_h JOIN unit_ u ON u.store = e.store AND u.h = e.target_h WHERE (e.store, e.seq) IN (SELECT (store, seq) FROM written)""")
def fold_operations(spark: SparkSession, d: str) -> DataFrame:
    """What the log compiles to: each live row's erases, then its write."""
    rows = log(spark, d)
    ops = operations(rows, table(spark, d, "vectors").filter((F.size("k") == DIM) & (F.size("v") == DIM)))
    return ops.select("store", "seq", "op", "target_h", "w")


@query(RECURSIVE + GIVEN + ", written AS (SELECT * FROM live)" + STATES + f"""
, mine AS (SELECT store, h, k FROM written JOIN unit_ USING (store, h))
, mu AS (SELECT store, count(*) AS n, list_transform(range({DIM}), lambda i: list_sum(list_transform(list(k), lambda x: x[i + 1])) / count(*)) AS m FROM mine GROUP BY store)
, cen AS (SELECT store, n, list_transform(range({DIM}), lambda i: k[i + 1] - m[i + 1]) AS c FROM mine JOIN mu USING (store))
, tr AS (SELECT store, any_value(n) AS n, sum(list_inner_product(c, c)) AS t FROM cen GROUP BY store)
, en AS (SELECT a.store, sum(list_inner_product(a.c, b.c) * list_inner_product(a.c, b.c)) AS e FROM cen a JOIN cen b ON a.store = b.store GROUP BY a.store)
SELECT store, n, round(CASE WHEN e > 1e-12 THEN t * t / e ELSE 0 END, 5) AS live_estimate, round(greatest(0, 1 - CASE WHEN e > 1e-12 THEN t * t / e ELSE 0 END / {DIM}), 6) AS headroom, round(list_inner_product(s, s), 5) AS energy
FROM tr JOIN en USING (store) JOIN states USING (store)
""")
def spectral_gauge(spark: SparkSession, d: str) -> DataFrame:
    g = gauges(fold(operations(log(spark, d), table(spark, d, "vectors")), DIM))
    return g.select("store", "n", F.round("live_estimate", 5).alias("live_estimate"), F.round("headroom", 6).alias("headroom"), F.round("energy", 5).alias("energy"))


FAMILIES = """, many AS (SELECT store, topic FROM live WHERE topic <> '' GROUP BY ALL HAVING count(*) > 1),
  known AS (SELECT e.*, t.seq AS target_seq FROM edges e JOIN unretracted t ON t.store = e.store AND t.h = e.target_h),
  fam AS (SELECT store, 't' || topic AS family, seq, h FROM live JOIN many USING (store, topic)
    UNION ALL SELECT store, 'e:' || seq || ':' || target_seq, seq, h FROM known UNION ALL SELECT store, 'e:' || seq || ':' || target_seq, target_seq, target_h FROM known)"""
CURRENCY = f"""
, agreed AS (SELECT f.store, f.family, f.seq, greatest(1e-6, list_sum(list_transform(range({DIM}), lambda i: u.v[i + 1] * list_inner_product(s.s[i * {DIM} + 1 : i * {DIM} + {DIM}], u.k)))) AS agree
    FROM fam f JOIN unit_ u ON u.store = f.store AND u.h = f.h JOIN states s ON s.store = f.store)
, cur AS (SELECT store, seq, min(agree / best) AS currency FROM (SELECT *, max(agree) OVER (PARTITION BY store, family) AS best FROM agreed) GROUP BY store, seq)
"""


@query(BASE + FAMILIES + " SELECT store, family, seq, h FROM fam")
def supersession_families(spark: SparkSession, d: str) -> DataFrame:
    return families(table(spark, d, "entry_log")).select("store", "family", "seq", "h")


@query(RECURSIVE + GIVEN + ", written AS (SELECT * FROM live)" + STATES + FAMILIES + CURRENCY + "SELECT store, seq, round(currency, 5) AS currency FROM cur")
def fused_currency(spark: SparkSession, d: str) -> DataFrame:
    rows, vec = log(spark, d), table(spark, d, "vectors")
    return currency(rows, vec, materialise(fold(operations(rows, vec), DIM), "states")).withColumn("currency", F.round("currency", 5))


#: The built-in embedder's vectors as lists, for the fold.
DENSE = f"""
, dv AS (SELECT store, seq, map(list(bucket), list(x)) AS m FROM vv GROUP BY ALL), dk AS (SELECT store, seq, map(list(bucket), list(x)) AS m FROM kv GROUP BY ALL)
, vv_ AS (SELECT l.store, l.h, list_transform(range({DIM}), lambda i: coalesce(dk.m[i::UBIGINT], 0)::DOUBLE) AS k, list_transform(range({DIM}), lambda i: coalesce(dv.m[i::UBIGINT], 0)::DOUBLE) AS v
    FROM live l LEFT JOIN dv USING (store, seq) LEFT JOIN dk USING (store, seq) WHERE l.text IS NOT NULL)
, written AS (SELECT * FROM live)
"""


@query(RECURSIVE + HASHED + ONE + DENSE + STATES + FAMILIES + CURRENCY + """
, ranked_ AS (SELECT p.store, p.seq, p.res, (1.0 / (59 + r1) + CASE WHEN bm25 > 0 AND gate > 0 THEN gate / (59 + r2) ELSE 0 END) * coalesce(c.currency, 1) AS final FROM placed p CROSS JOIN weight LEFT JOIN cur c USING (store, seq))
SELECT store, seq, round(res, 5) AS res, round(final, 7) AS final FROM ranked_ ORDER BY round(final, 9) DESC, store, seq LIMIT 20""")
def ask_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The answer to a question over all stores: both arms, aliases, the gate and currency."""
    rows = log(spark, d)
    vec = materialise(hashed_vectors(spoken(rows)), "vec")
    out = ranked(rows, vec, question_vector(), QUESTION, StoreConfig("hashed", DIM))
    return out.orderBy(F.round("final", 9).desc(), "store", "seq").limit(20).select("store", "seq", F.round("res", 5).alias("res"), F.round("final", 7).alias("final"))


RELATE_FLOOR = 0.3
RELATED = f"""
, uv AS (SELECT DISTINCT ON (store, h) store, h, {UNIT.format("k_")} AS k, {UNIT.format("v_")} AS v FROM (SELECT *, list_transform(k, lambda x: x::DOUBLE) AS k_, list_transform(v, lambda x: x::DOUBLE) AS v_ FROM vectors WHERE {UNIT_V} AND {UNIT_K}))
, p AS MATERIALIZED (SELECT l.store AS source, l.seq, l.h, l.topic, l.instant, u.k, u.v FROM live l JOIN uv u USING (store, h))
, total AS (SELECT list_transform(range({DIM}), lambda i: list_sum(list_transform(list(k), lambda x: x[i + 1]))) AS t FROM p)
, mu AS (SELECT {UNIT.format("t")} AS m FROM total)
, c0 AS (SELECT p.*, list_transform(range({DIM}), lambda i: v[i + 1] - list_inner_product(v, m) * m[i + 1]) AS y FROM p, mu)
, c AS MATERIALIZED (SELECT * EXCLUDE (y), {UNIT.format("y")} AS y FROM c0)
, first_ AS (SELECT source FROM p GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)
, anchors AS (SELECT row_number() OVER (ORDER BY instant DESC, seq) - 1 AS hit, * FROM c WHERE source = (SELECT source FROM first_) QUALIFY hit < 3)
, cand AS (SELECT a.hit, x.source, x.seq, coalesce(nullif(x.topic, ''), x.h) AS slot, list_inner_product(a.v, x.v) AS cosine, list_inner_product(a.y, x.y) AS centred FROM anchors a JOIN c x ON x.source <> a.source
    WHERE list_inner_product(a.v, x.v) >= {RELATE_FLOOR} AND x.h NOT IN (SELECT h FROM anchors))
, wanted AS (SELECT DISTINCT x.source, x.seq, x.y FROM c x JOIN cand USING (source, seq))
, hub AS (SELECT source, seq, avg(d) AS hubness FROM (SELECT w.source, w.seq, list_inner_product(w.y, o.y) AS d FROM wanted w JOIN c o ON o.source = w.source AND o.seq <> w.seq
    QUALIFY row_number() OVER (PARTITION BY w.source, w.seq ORDER BY list_inner_product(w.y, o.y) DESC) <= 10) GROUP BY ALL)
, scored AS (SELECT cand.*, 2 * centred - coalesce(hubness, 0) AS score FROM cand LEFT JOIN hub USING (source, seq))
, one AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY hit, source, slot ORDER BY round(score, 9) DESC, seq) = 1)
""" + "".join(f"""
, t{n} AS (SELECT * FROM one WHERE hit = {n}{"".join(f" AND slot NOT IN (SELECT slot FROM h{i})" for i in range(n))} QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, seq) <= 2)
, h{n} AS MATERIALIZED (SELECT * FROM t{n} QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, source, seq) <= least(6, 12{"".join(f" - (SELECT count(*) FROM h{i})" for i in range(n))}))""" for n in range(3)) + """
SELECT hit::INT AS hit, source, seq, round(cosine, 6) AS cosine, round(score, 6) AS score FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""


@query(BASE + RELATED)
def relate_cross_store(spark: SparkSession, d: str) -> DataFrame:
    """What other stores hold near the three newest entries of the store with most rows."""
    vec = table(spark, d, "vectors").filter(usable(F.col("v"), DIM) & usable(F.col("k"), DIM)).dropDuplicates(["store", "h"]).select("store", "h", "k", "v")
    rows = L.live_rows(log(spark, d)).select("store", "seq", "h", "topic", "at", "kind").join(vec, ["store", "h"])
    pool = materialise(rows.withColumnRenamed("store", "source"), "pool")
    first = pool.groupBy("source").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "source").first()[0]
    anchors = [r.asDict() for r in pool.filter(F.col("source") == first).orderBy(instant_micros(F.col("at")).desc(), "seq").limit(3).collect()]
    found = [(i, r["source"], r["seq"], round(r["cosine"], 6), round(r["score"], 6)) for i, rs in enumerate(relate(pool, anchors, Params(relate_floor=RELATE_FLOOR))) for r in rs]
    return spark.createDataFrame(found, "hit int, source string, seq bigint, cosine double, score double")


@query(f"""WITH p AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  SELECT a.label, a.vec_id, b.vec_id AS near_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM p a JOIN p b ON a.label = b.label AND b.vec_id < a.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) <= 3""")
def earlier_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Of every vector whose id is divisible by 50 the three nearest before it with its label."""
    from pyspark.sql.window import Window

    p = table(spark, d, "embeddings")
    a = p.filter("vec_id % 50 = 0").select("label", "vec_id", "embedding")
    b = p.select("label", F.col("vec_id").alias("near_id"), F.col("embedding").alias("other"))
    pairs = a.join(b, "label").filter("near_id < vec_id").select("label", "vec_id", "near_id", cosine(F.col("embedding"), F.col("other")).alias("cosine"))
    w = Window.partitionBy("vec_id").orderBy(F.round("cosine", 9).desc(), "near_id")
    return pairs.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").drop("rn").withColumn("cosine", F.round("cosine", 6))


# ------------------------------------------------------------------ streaming


@query(BASE + POSTS + "SELECT store, seq, term, tf FROM posts")
def stream_catch_up(spark: SparkSession, d: str) -> DataFrame:
    """The postings of live rows, by micro-batches over the log in twelve files: seven come first, the others after a restart."""
    from ..streaming.catchup import catch_up

    src = table(spark, d, "entry_log")
    scratch = Written(spark, f"{shared_dir(spark)}/verbatrix/stream-{uuid.uuid4().hex[:10]}")
    parts = src.withColumn("part", F.pmod(F.floor(F.col("seq") / 97), F.lit(12)))
    for some in ("part < 7", "part >= 7"):
        parts.filter(some).repartition("part").drop("part").write.mode("append").parquet(f"{scratch.path}/log")
        tables = catch_up(spark, f"{scratch.path}/log", src.schema, f"{scratch.path}/tables", files_per_batch=2)
    out = materialise(tables.live("postings").select("store", "seq", "term", "tf"), "caught_up")
    scratch.drop()
    return out


# ------------------------------------------------------------------ files


@query("""SELECT h, coalesce(kind, 'note') AS kind, "at", topic, text, target, (SELECT count(*) FROM (SELECT unnest(map_keys(e.slots)))) AS slots, coalesce(list_sum(list_transform(displaces, lambda d: round(d.w, 6))), 0) AS weights, coalesce(len(questions), 0) AS questions, count(*) AS n
  FROM (SELECT * EXCLUDE target, nullif(target, '') AS target FROM entry_log) e GROUP BY ALL""")
def wire_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The log written as lines and read again; identities are computed from what was read."""
    rows = table(spark, d, "entry_log").withColumn("at", F.col("at"))
    written = Written(spark, f"{shared_dir(spark)}/verbatrix/lines-{uuid.uuid4().hex[:10]}")
    to_lines(rows).write.text(written.path)
    back = from_lines(spark, written.path, "all")
    weights = F.coalesce(F.aggregate("displaces", F.lit(0.0), lambda a, x: a + F.round(x["w"], 6)), F.lit(0.0))
    out = back.select("h", "kind", "at", "topic", "text", "target", F.size("slots").alias("slots"), weights.alias("weights"), F.size("questions").alias("questions"))
    out = materialise(out.groupBy(*out.columns).agg(F.count("*").alias("n")), "read_again")
    written.drop()
    return out


@query("""SELECT text, topic, kind, count(*) AS n, '2024-05-06T07:08:09.000Z' AS "at" FROM (SELECT text, CASE WHEN lang <> '' THEN lang END AS topic, CASE WHEN kind IS NULL THEN 'note' ELSE kind END AS kind FROM documents WHERE text IS NOT NULL) GROUP BY ALL""")
def ingest_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """All documents through JSON lines in several files, among comments and blank lines, under one stamp."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.to_json(F.struct("text", F.when(F.col("lang") != "", F.col("lang")).alias("topic"), "kind")).alias("value"))
    written = Written(spark, f"{shared_dir(spark)}/verbatrix/jsonl-{uuid.uuid4().hex[:10]}")
    docs.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.concat(F.lit("\t"), "value"))).alias("value")).repartition(3).write.text(written.path)
    got = ingest(spark, "jsonl", [f"{written.path}/part-*"], "2024-05-06T07:08:09.000Z")
    out = materialise(got.groupBy("text", "topic", "kind", "at").agg(F.count("*").alias("n")), "ingested")
    written.drop()
    return out


# ------------------------------------------------------------------ changes, vectors


@query("""WITH c AS (SELECT store, seq, coalesce(topic, '') AS topic, h, kind, seq % 3 = 0 AS late FROM entry_log), b AS (SELECT store, topic, max_by(h, seq) AS h FROM c WHERE NOT late GROUP BY ALL),
  n AS (SELECT store, topic, max_by(h, seq) AS h, max_by(coalesce(kind, '') = 'retract', seq) AS gone FROM c WHERE late GROUP BY ALL)
  SELECT coalesce(n.store, b.store) AS store, coalesce(n.topic, b.topic) AS topic, CASE WHEN n.store IS NULL THEN b.h ELSE n.h END AS h FROM b FULL JOIN n ON b.store = n.store AND b.topic = n.topic WHERE n.store IS NULL OR NOT n.gone""")
def merged_feed(spark: SparkSession, d: str) -> DataFrame:
    """A base table of each topic's last entry, and the changes that came since, twice, merged into it; retracts delete."""
    rows = table(spark, d, "entry_log").select("store", "seq", F.coalesce("topic", F.lit("")).alias("topic"), "h", "kind")
    base = rows.filter("seq % 3 <> 0").groupBy("store", "topic").agg(F.max_by("h", "seq").alias("h"))
    late = rows.filter("seq % 3 = 0")
    return merge_changes(base, late.unionByName(late).drop("kind").join(late.select("seq", "kind").distinct(), "seq"), ["store", "topic"], ["seq"], ["seq"], F.col("kind") == "retract").select("store", "topic", "h")


@query(f"""SELECT v.seq, CASE WHEN list_inner_product(k, k) > 0 THEN 1.0 ELSE 0.0 END AS linear, 1.0 AS waves, CASE WHEN list_inner_product(k, k) > 0 THEN 1.0 ELSE 0.0 END AS bound, coalesce(len(map_keys(e.slots)), 0) = 0 AS same
  FROM (SELECT seq, list_transform(k, lambda x: x::DOUBLE) AS k FROM vectors WHERE k IS NOT NULL AND len(k) = {DIM}) v JOIN entry_log e ON e.seq = v.seq""")
def lifted_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Every key lifted both ways and bound to its entry's slots: all of unit length, zeros stay zero where nothing else is added, keys without slots as they are."""
    rows = table(spark, d, "vectors").filter(F.size("k") == DIM).select("seq", "k").join(table(spark, d, "entry_log").select("seq", "slots"), "seq")

    def run(batches):  # noqa: ANN001, ANN202
        linear, waves = Lift(DIM, 128, 7), Lift(DIM, 128, 7, 0.8)
        for b in batches:
            if len(b):
                x = np.stack(b["k"]).astype(np.float64)
                y = linear.keys(x)
                z = bind_rows(y, [dict(zip(n, v)) if n is not None else None for n, v in zip(b["names"], b["given"])], 7)
                length = lambda m: np.round(np.linalg.norm(m, axis=1), 6)
                yield b[["seq"]].assign(linear=length(y), waves=length(waves.keys(x)), bound=length(z), same=[n is None or len(n) == 0 for n in b["names"]])

    return rows.select("seq", "k", F.map_keys("slots").alias("names"), F.map_values("slots").alias("given")).mapInPandas(run, "seq bigint, linear double, waves double, bound double, same boolean")
