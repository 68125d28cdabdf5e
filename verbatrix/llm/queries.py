"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_out
from .batches import AcceptedIndex, admit_all
from .encode import encode_corpus
from .knn import nearest
from .leak import find_leaks
from .mojibake import find_garbled
from .neardup import near_duplicate_groups
from .split import split_oversized


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "vectors").select(F.col("seq").alias("id"), F.explode(F.array(F.struct(F.lit("v").alias("space"), F.col("v").alias("vec")), F.struct(F.lit("k").alias("space"), F.col("k").alias("vec")))).alias("x"))
    found = nearest(rows.select("x.space", "id", "x.vec"), k=5, min_cosine=0.85)
    return found.select("space", F.least("id", "neighbour").alias("seq_a"), F.greatest("id", "neighbour").alias("seq_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches are admitted one by one, as they arrive: the history makes the index, each later one is checked against it and appended."""
    arrived = write_out(_table(spark, sf_dir, "entry_batches").select("row_id", "h", "text", F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no")), "arrived", by=["batch_no"])
    index = AcceptedIndex(spark, threshold=0.6, size=3)
    numbers = [r[0] for r in arrived.df.select("batch_no").distinct().orderBy("batch_no").collect()]
    decided = None
    for got in admit_all(index, (arrived.df.filter(F.col("batch_no") == no) for no in numbers)):
        decided = got if decided is None else decided.unionByName(got)
    index.drop()  # what was decided is written
    arrived.drop()
    if decided is None:
        return spark.createDataFrame([], "kept_id bigint, dup_id bigint")
    return decided.filter("kept is not null").select(F.col("kept").alias("kept_id"), F.col("row_id").alias("dup_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "entry_log").filter(~F.coalesce("kind", F.lit("")).isin("keep", "retract", "alias"))
    return near_duplicate_groups(rows, key="seq", threshold=0.6, size=3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_table(spark, sf_dir, "long_entries"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_found, p5_found, p6_ids, p7_found, p8_found)}
SQL: dict[str, str] = {
    "p2_found": """
WITH x AS (SELECT seq, 'v' AS space, v AS e FROM vectors UNION ALL SELECT seq, 'k', k FROM vectors),
u AS (SELECT space, seq, list_transform(e, lambda y: y::DOUBLE) AS e FROM x WHERE e IS NOT NULL AND len(e) = 64 AND list_aggregate(list_transform(e, lambda y: abs(y)), 'sum') > 0),
p AS (SELECT a.space, a.seq AS s, b.seq AS t, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM u a JOIN u b ON a.space = b.space AND a.seq <> b.seq),
r AS (SELECT * FROM p WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY space, s ORDER BY c DESC, t) <= 5)
SELECT DISTINCT space, least(s, t) AS seq_a, greatest(s, t) AS seq_b FROM r
""",
    "p3_found": r"""
WITH RECURSIVE w AS (SELECT row_id, h, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM entry_batches),
g AS (SELECT DISTINCT row_id, array_to_string(ws[i : i + 2], ' ') AS gram FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 8)),
n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
o AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS o FROM g x JOIN g y ON x.gram = y.gram AND x.row_id < y.row_id GROUP BY 1, 2),
near AS (SELECT a, b FROM o JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE 8 * o >= 3 * (x.n + y.n) UNION SELECT x.row_id, y.row_id FROM w x JOIN w y ON x.h = y.h AND x.row_id < y.row_id),
st(id, ok) USING KEY (id) AS (
  SELECT row_id, TRUE FROM w WHERE row_id NOT IN (SELECT b FROM near)
  UNION
  SELECT b, NOT hit FROM (SELECT n.b, bool_or(coalesce(s.ok, FALSE)) AS hit, bool_and(s.id IS NOT NULL) AS known FROM near n LEFT JOIN recurring.st s ON s.id = n.a
    WHERE n.b NOT IN (SELECT id FROM recurring.st) GROUP BY n.b) WHERE hit OR known
)
SELECT min(n.a) AS kept_id, n.b AS dup_id FROM near n JOIN st s ON s.id = n.a AND s.ok GROUP BY n.b
""",
    "p4_found": r"""
WITH RECURSIVE w AS (SELECT seq, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM entry_log WHERE text IS NOT NULL AND coalesce(kind, '') NOT IN ('keep', 'retract', 'alias')),
c AS (SELECT array_to_string(ws, ' ') AS words, min(seq) AS cid, any_value(ws) AS ws FROM w WHERE len(ws) >= 8 GROUP BY 1),
g AS (SELECT DISTINCT cid, array_to_string(ws[i : i + 2], ' ') AS gram FROM (SELECT cid, ws, unnest(range(1, len(ws) - 1)) AS i FROM c)),
n AS (SELECT cid, count(*) AS n FROM g GROUP BY cid),
o AS (SELECT a.cid AS a, b.cid AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.cid <> b.cid GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.cid = a JOIN n y ON y.cid = b WHERE 8 * o >= 3 * (x.n + y.n)),
r AS (SELECT cid AS node, cid AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
rows_ AS (SELECT root AS group_seq, w.seq FROM w JOIN c ON c.words = array_to_string(w.ws, ' ') JOIN m ON m.node = c.cid WHERE len(w.ws) >= 8)
SELECT group_seq, seq FROM rows_ QUALIFY count(*) OVER (PARTITION BY group_seq) > 1
""",
    "p5_found": r"""
WITH RECURSIVE t AS (SELECT entry_id, coalesce(topic, '') AS topic, topic IS NULL AS bare, text, length(text) AS n FROM long_entries WHERE length(text) > 1500),
c AS (SELECT entry_id, text, unnest(range(1, n + 1)) AS e FROM t),
m AS (SELECT entry_id, e, text, substr(text, e, 1) AS x, substr(text, e - 1, 1) AS y FROM c),
b AS (SELECT entry_id, e, CASE WHEN x = chr(10) AND regexp_matches(substr(text, 1, e - 1), '\n[ \t\r]*$') THEN 1 WHEN x = chr(10) THEN 2
        WHEN x IN ('。', '！', '？') OR (e > 1 AND x IN (' ', chr(9), chr(13)) AND y IN ('.', '!', '?')) THEN 3 WHEN x IN (' ', chr(9), chr(13)) THEN 4 ELSE 5 END AS kind FROM m),
p AS (
  SELECT entry_id, 1 AS piece_no, 0::BIGINT AS s, (SELECT min_by(b.e, b.kind * 100000000 - b.e) FROM b WHERE b.entry_id = t.entry_id AND b.e > 750 AND b.e <= 1500 AND (b.kind < 5 OR b.e = 1500)) AS e, n FROM t
  UNION ALL
  SELECT p.entry_id, p.piece_no + 1, p.e - 150, CASE WHEN p.n - (p.e - 150) <= 1500 THEN p.n ELSE q.e END, p.n
  FROM p LEFT JOIN b AS q ON q.entry_id = p.entry_id AND q.e > p.e + 600 AND q.e <= least(p.e + 1350, p.n) WHERE p.e < p.n
  QUALIFY row_number() OVER (PARTITION BY p.entry_id ORDER BY CASE WHEN q.kind = 5 AND q.e < p.e + 1350 THEN 6 ELSE q.kind END, q.e DESC) = 1
)
SELECT p.entry_id, p.piece_no, p.s::INT AS start_pos, p.e::INT AS end_pos, CASE WHEN t.bare THEN '' WHEN p.piece_no = 1 THEN t.topic ELSE t.topic || '/' || p.piece_no END AS piece_topic FROM p JOIN t USING (entry_id)
""",
    "p7_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, k, array_to_string(ws[j : j + k - 1], ' ') AS gram FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(ws[j : j + k - 1], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM ig) WHERE len(ws) >= k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, gram)
""",
}
