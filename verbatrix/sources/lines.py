"""The log's wire form: JSON lines, optional fields left out when empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import identity_column
from ..operators.log import with_ordinal

WIRE = "at string, kind string, topic string, text string, h string, slots map<string,string>, displaces array<array<string>>, target string, questions array<string>"


def to_lines(log: DataFrame) -> DataFrame:
    """(value) one JSON line per row, in the log's order."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    pairs = F.transform("displaces", lambda d: F.to_json(F.array(d["target_h"])).substr(F.lit(2), F.length(d["target_h"]) + 2))
    weights = F.transform("displaces", lambda d: d["w"].cast("string"))
    shown = F.when(F.size("displaces") > 0, F.concat(F.lit("["), F.array_join(F.zip_with(pairs, weights, lambda p, w: F.concat(F.lit("["), p, F.lit(", "), w, F.lit("]"))), ", "), F.lit("]")))
    base = F.to_json(
        F.struct("at", "kind", "topic", "text", "h", some("slots").alias("slots"), F.when(F.col("target") != "", F.col("target")).alias("target"), some("questions").alias("questions"))
    )
    return log.select(F.when(shown.isNotNull(), F.concat(base.substr(F.lit(1), F.length(base) - 1), F.lit(', "displaces": '), shown, F.lit("}"))).otherwise(base).alias("value"))


def from_lines(spark: SparkSession, path: str, store: str) -> DataFrame:
    """LOG's columns from files of lines, in the order of their names; blank lines are skipped, missing fields get their defaults, the identity is computed."""
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))
    r = raw.select("_file", "_at", F.from_json("value", WIRE, {"mode": "FAILFAST"}).alias("r"))
    out = r.select(
        "_file", "_at", F.lit(store).alias("store"), "r.text", "r.topic", "r.at", F.coalesce("r.kind", F.lit("note")).alias("kind"),
        F.coalesce("r.slots", F.create_map().cast("map<string,string>")).alias("slots"),
        F.coalesce(F.transform("r.displaces", lambda d: F.struct(d[0].alias("target_h"), d[1].cast("double").alias("w"))), F.array().cast("array<struct<target_h:string,w:double>>")).alias("displaces"),
        F.col("r.target").alias("target"), F.coalesce("r.questions", F.array().cast("array<string>")).alias("questions"),
    ).withColumn("h", identity_column())
    return with_ordinal(out, ["store"], ["_file", "_at"], "seq").select("seq", "store", "h", "text", "topic", "at", "kind", "slots", "displaces", "target", "questions")
