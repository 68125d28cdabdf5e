"""The lexical arm: postings, BM25, the rarity gate, and rank fusion.

Statistics are those of the whole pool a question sees, over all stores: rarity and rank mean nothing within one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..schema import DEFAULTS, Params
from ..session import materialise
from .log import with_ordinal


def postings(docs: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, term, tf) of every document. Worth writing, sorted by term, where many questions come: a filter on terms then
    skips row groups, while one above this never reaches the scan."""
    return docs.select(*key, F.explode(tokens(text)).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key, doc_len): numbers of tokens, 0 for documents without."""
    return docs.select(*key, F.size(tokens(text)).alias("doc_len"))


def pool_stats(doc_len: DataFrame) -> DataFrame:
    """One row (n, avgdl); rows outside the corpus (length 0) count."""
    return doc_len.agg(F.count("*").alias("n"), (F.coalesce(F.sum("doc_len"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))


def question_terms(questions: DataFrame, key: str, text: Column) -> DataFrame:
    return questions.select(F.col(key), F.explode(F.array_distinct(tokens(text))).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def bm25(q_terms: DataFrame, q_key: str, posts: DataFrame, doc_len: DataFrame, key: list[str], p: Params = DEFAULTS) -> DataFrame:
    """(q_key, key, bm25) of every document that has a term of the question; a sum over the question's distinct terms.

    Only postings of the questions' terms are joined (a semi-join before anything else); the pool's statistics are one row.
    """
    wanted = posts.join(q_terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    weighted = wanted.join(df, "term").join(doc_len, key).crossJoin(F.broadcast(pool_stats(doc_len)))
    tf = F.col("tf").cast("double")
    part = idf(F.col("n"), F.col("df")) * tf * (p.bm25_k1 + 1) / (tf + p.bm25_k1 * (1 - p.bm25_b + p.bm25_b * F.col("doc_len") / F.col("avgdl")))
    scored = weighted.select("term", *key, part.alias("part"))
    return q_terms.join(scored, "term").groupBy(q_key, *key).agg(F.sum("part").alias("bm25"))


def rare_rows(q_terms: DataFrame, posts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(store, h) of the rows that have a term of the questions which at most 4 x prefilter_candidates rows have: a coarse scan of vectors may
    not see them, however well they answer."""
    wanted = posts.join(q_terms.select("term").distinct(), "term", "left_semi")
    rare = wanted.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= 4 * p.prefilter_candidates)
    return wanted.join(rare.select("term"), "term", "left_semi").select("store", "h").distinct()


def gate(q_terms: DataFrame, q_key: str, posts: DataFrame, doc_len: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(q_key, max_idf, gate): how much the lexical arm counts, by the question's rarest term; a term nobody has is the rarest."""
    df = posts.join(q_terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = q_terms.join(df, "term", "left").crossJoin(F.broadcast(pool_stats(doc_len))).groupBy(q_key).agg(F.max(idf(F.col("n"), F.coalesce("df", F.lit(0)))).alias("max_idf"))
    return rare.withColumn("gate", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("max_idf") - p.gate_floor) / p.gate_span)))


def top_documents(scored: DataFrame, q_key: str, key: list[str], score: str, k: int) -> DataFrame:
    w = Window.partitionBy(q_key).orderBy(F.round(score, 9).desc(), *key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fused(pool: DataFrame, by: list[str], primary: str, secondary: str, weight: str, ties: list[str], p: Params = DEFAULTS) -> DataFrame:
    """pool with `fused`: reciprocal rank of the primary score, plus the weighted one of the secondary where that is above 0 (a zero
    is no evidence, not a rank). Ranks are over the whole pool of each `by`, found by range partitions and offsets, so that no pool is
    one task. Scores are rounded before they are ranked, so that the last bits of a sum decide nothing."""
    scores = pool.withColumn("_p", -F.round(primary, 9)).withColumn("_s", -F.round(F.coalesce(secondary, F.lit(0.0)), 9))
    scores = materialise(scores, "scores")  # a range partitioning reads its input twice
    first = with_ordinal(scores, by, ["_p", *ties], "_r1")
    both = with_ordinal(first, by, ["_s", *ties], "_r2")
    lex = F.when((F.col("_s") < 0) & (F.col(weight) > 0), F.col(weight) / (p.rrf_k + F.col("_r2") - 1)).otherwise(0.0)
    return both.withColumn("fused", F.lit(1.0) / (p.rrf_k + F.col("_r1") - 1) + lex).drop("_p", "_s", "_r1", "_r2")
