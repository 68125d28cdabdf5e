"""The query of the change feed, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.changes import current_entries


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_entries(spark.read.parquet(f"{sf_dir}/entry_log.parquet")).select("store", "h", "displaced_by")


SQL = {
    "p1_found": r"""
WITH spelled AS (
  SELECT seq, store, h, kind, nullif(topic, '') AS topic, target, displaces,
         CASE WHEN length("at") = 10 THEN "at" || 'T00:00:00Z'
              ELSE regexp_replace("at", '^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-]|$)', '\1:00\2') END AS spelled_at
  FROM entry_log
  QUALIFY row_number() OVER (PARTITION BY store, h ORDER BY seq) = 1
), feed AS (
  SELECT *, epoch_us(CAST(spelled_at AS TIMESTAMPTZ)) AS instant FROM spelled
), live AS (
  SELECT * FROM feed e
  WHERE coalesce(kind, '') NOT IN ('keep', 'retract', 'alias')
    AND NOT EXISTS (SELECT 1 FROM feed r WHERE r.kind = 'retract' AND r.store = e.store AND r.target = e.h)
), kept AS (
  SELECT store, target, max(instant) AS kept_at FROM feed WHERE kind = 'keep' GROUP BY store, target
), edges AS (
  SELECT store, h, instant, d.target_h AS target, d.w AS w FROM (SELECT store, h, instant, unnest(displaces) AS d FROM live)
), strongest AS (
  SELECT e.store, e.target, e.h FROM edges e LEFT JOIN kept k ON k.store = e.store AND k.target = e.target
  WHERE k.kept_at IS NULL OR e.instant > k.kept_at
  QUALIFY row_number() OVER (PARTITION BY e.store, e.target ORDER BY e.w DESC, e.h) = 1
), standing AS (
  SELECT store, h FROM live WHERE topic IS NULL
  UNION ALL
  SELECT store, h FROM (SELECT store, h FROM live WHERE topic IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY store, topic ORDER BY instant DESC, h DESC) = 1)
)
SELECT s.store, s.h, coalesce(x.h, '') AS displaced_by
FROM standing s LEFT JOIN strongest x ON x.store = s.store AND x.target = s.h
""",
}
QUERIES = {"p1_found": p1_found}
