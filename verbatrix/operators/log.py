"""The log's own relations: which rows live, what supersedes and displaces what, and appends, which are its only mutations.

A log has LOG's columns; seq is the order of writing. Rows of several stores may be in one log: everything is within a store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import identity_column
from ..functions.time import instant_micros
from ..schema import SPECIAL
from ..session import materialise
from .changes import first_by

KEY = ["store", "h"]


def is_entry(kind: Column | str = "kind") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return ~F.coalesce(kind, F.lit("note")).isin(*SPECIAL)


def distinct_log(log: DataFrame) -> DataFrame:
    """The log without repeats: of rows with one identity in a store that with the smallest seq."""
    return first_by(log, KEY, [F.col("seq").asc()])


def targets(log: DataFrame, kind: str) -> DataFrame:
    """(store, h) that events of this kind name."""
    return log.filter((F.col("kind") == kind) & F.col("target").isNotNull() & (F.col("target") != "")).select("store", F.col("target").alias("h")).distinct()


def unretracted(log: DataFrame) -> DataFrame:
    return log.join(targets(log, "retract"), KEY, "left_anti")


def live_rows(log: DataFrame) -> DataFrame:
    """Entries that no retract names."""
    return unretracted(log).filter(is_entry())


def standing_edges(log: DataFrame, known: bool = False) -> DataFrame:
    """(store, seq, h, target_h, w): displacements by rows that aren't retracted, of targets that no keep names; with known, only of
    targets that are in the log and not retracted (those that change the state)."""
    edges = unretracted(log).select("store", "seq", "h", F.explode("displaces").alias("d")).select("store", "seq", "h", F.col("d.target_h").alias("target_h"), F.col("d.w").alias("w"))
    out = edges.join(targets(log, "keep").withColumnRenamed("h", "target_h"), ["store", "target_h"], "left_anti")
    if known:
        there = unretracted(log).select("store", F.col("h").alias("target_h"), F.col("seq").alias("target_seq")).distinct()
        out = out.join(there, ["store", "target_h"])
    return out


def displaced(log: DataFrame) -> DataFrame:
    """(store, h, displaced): the strongest standing displacement of each target."""
    return standing_edges(log).groupBy("store", F.col("target_h").alias("h")).agg(F.max("w").alias("displaced"))


def topic_or_self() -> Column:
    """A topic's rows are one slot; a row without topic is a slot of its own."""
    return F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit("t"), "topic")).otherwise(F.concat(F.lit("s"), F.col("seq")))


def latest_by_topic(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The last live row of each topic in the order of writing, and every live row without topic."""
    rows = live_rows(log).select("store", "seq", "h", "topic", "at", *(keep or [])).withColumn("slot", topic_or_self())
    return first_by(rows, ["store", "slot"], [F.col("seq").desc()]).drop("slot")


def superseded(log: DataFrame) -> DataFrame:
    """(store, seq, superseded_by): live rows that aren't their topic's last, with the `at` of the last."""
    rows = live_rows(log).filter(F.coalesce("topic", F.lit("")) != "").select("store", "seq", "topic", "at")
    last = rows.groupBy("store", "topic").agg(F.max_by("at", "seq").alias("superseded_by"), F.max("seq").alias("last"))
    return rows.join(last, ["store", "topic"]).filter("seq <> last").select("store", "seq", "superseded_by")


def topic_listing(log: DataFrame) -> DataFrame:
    """(store, topic, writes, latest_seq, latest_h) of live topics; the row with null topic is of all entries without one."""
    rows = live_rows(log).select("store", F.when(F.col("topic") != "", F.col("topic")).alias("topic"), "seq", "h")
    return rows.groupBy("store", "topic").agg(F.count("*").alias("writes"), F.max("seq").alias("latest_seq"), F.max_by("h", "seq").alias("latest_h"))


def as_of(log: DataFrame, when: str) -> DataFrame:
    """Live rows written at or before an instant."""
    return live_rows(log).filter(instant_micros(F.col("at")) <= instant_micros(F.lit(when)))


def newest(log: DataFrame, top: int | None = 20) -> DataFrame:
    """Rows that aren't retracted (aliases included), newest first within a store, with what supersedes or displaces them."""
    rows = unretracted(log).filter(~F.coalesce("kind", F.lit("note")).isin("keep", "retract")).withColumn("instant", instant_micros(F.col("at")))
    w = Window.partitionBy("store").orderBy(F.col("instant").desc_nulls_last(), F.col("seq"))
    if top is not None:
        rows = rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
    return rows.join(superseded(log), ["store", "seq"], "left").join(displaced(log), KEY, "left")


def stats(log: DataFrame) -> DataFrame:
    """(store, entries, topics, anonymous) over all rows, events included."""
    named = F.coalesce("topic", F.lit("")) != ""
    return log.groupBy("store").agg(F.count("*").alias("entries"), F.countDistinct(F.when(named, F.col("topic"))).alias("topics"), F.sum(F.when(named, 0).otherwise(1)).alias("anonymous"))


def by_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """The rows whose identity starts with a prefix, copies in several stores once; a caller that needs one row uses exactly_one."""
    rows = log.filter(F.col("h").startswith(prefix) & ~F.coalesce("kind", F.lit("note")).isin("keep", "retract"))
    return first_by(rows, ["h"], [F.col("store").asc(), F.col("seq").asc()])


def exactly_one(rows: DataFrame, what: str):  # noqa: ANN201
    """The only row; ValueError if there is none or another."""
    got = rows.limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"{what}: {'no match' if not got else 'ambiguous'}")
    return got[0]


def alias_parents(log: DataFrame) -> DataFrame:
    """(store, alias_seq, parent_seq): aliases, not retracted, of entries in the log that live."""
    parents = live_rows(log).select("store", F.col("h").alias("target"), F.col("seq").alias("parent_seq"))
    return unretracted(log).filter("kind = 'alias'").select("store", "target", F.col("seq").alias("alias_seq")).join(parents, ["store", "target"]).select("store", "alias_seq", "parent_seq")


# ------------------------------------------------------------------ appends


def question_rows(entries: DataFrame) -> DataFrame:
    """The alias rows that entries' questions stand for: the question is the text, the entry the target."""
    q = entries.select("store", "h", "at", F.explode(F.array_distinct("questions")).alias("text")).filter(F.col("text").isNotNull())
    made = q.select(
        "store", "text", F.lit(None).cast("string").alias("topic"), "at", F.lit("alias").alias("kind"), F.create_map().cast("map<string,string>").alias("slots"),
        F.array().cast("array<struct<target_h:string,w:double>>").alias("displaces"), F.col("h").alias("target"), F.array().cast("array<string>").alias("questions"),
    )
    return made.withColumn("h", identity_column())


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows that appending entries (ENTRY's columns, store, and ord, their order) adds to the log: those whose identity is neither in the log nor
    earlier among them, each followed by the aliases of its questions; seq goes on from the store's last."""
    new = entries.withColumn("h", identity_column()).withColumn("sub", F.lit(0))
    fresh = first_by(new, KEY, [F.col("ord").asc()]).join(log.select(*KEY), KEY, "left_anti")
    fresh = materialise(fresh, "append")
    asked = question_rows(fresh).join(fresh.select("store", F.col("h").alias("target"), "ord"), ["store", "target"]).withColumn("sub", F.lit(1))
    asked = first_by(asked, KEY, [F.col("ord").asc()]).join(log.select(*KEY), KEY, "left_anti").join(fresh.select(*KEY), KEY, "left_anti")
    both = fresh.unionByName(asked)
    start = log.groupBy("store").agg(F.max("seq").alias("start"))
    return with_ordinal(both, ["store"], ["ord", "sub", "text"], "place").join(start, "store", "left").withColumn("seq", F.coalesce("start", F.lit(0)) + F.col("place")).select("seq", "store", "h", *ENTRY_COLUMNS)


ENTRY_COLUMNS = ["text", "topic", "at", "kind", "slots", "displaces", "target", "questions"]


def event(spark, store: str, kind: str, target: str, at: str, text: str | None = None) -> DataFrame:  # noqa: ANN001
    """A keep, retract or alias as one row to append."""
    row = [(store, text or f"{kind} {target}", None, at, kind, {}, [], target, [], 1)]
    return spark.createDataFrame(row, "store string, text string, topic string, at string, kind string, slots map<string,string>, displaces array<struct<target_h:string,w:double>>, target string, questions array<string>, ord bigint")


def retract_events(log: DataFrame, prefixes: list[str], store: str, at: str) -> DataFrame:
    """The rows to append to forget the entries with these prefixes; every prefix must name exactly one row that isn't retracted
    before anything is made."""
    rows = unretracted(log.filter(F.col("store") == store))
    found = [exactly_one(by_prefix(rows, p), f"hash prefix {p}")["h"] for p in prefixes]
    out = None
    for n, h in enumerate(found):
        e = event(log.sparkSession, store, "retract", h, at).withColumn("ord", F.lit(n).cast("bigint"))
        out = e if out is None else out.unionByName(e)
    if out is None:
        raise ValueError("nothing to forget")
    return out


def keep_event(log: DataFrame, prefix: str, store: str, at: str) -> DataFrame:
    """The row to append to restore what displacements took from the one target with this prefix."""
    named = log.filter(F.col("store") == store).select(F.explode("displaces.target_h").alias("h")).filter(F.col("h").startswith(prefix)).distinct()
    return event(log.sparkSession, store, "keep", exactly_one(named, f"displaced {prefix}")["h"], at)


def fresh_questions(log: DataFrame, asked: DataFrame) -> DataFrame:
    """Of (store, target, text) those that aren't attached yet, once each."""
    have = log.filter("kind = 'alias'").select("store", "target", "text")
    return asked.select("store", "target", "text").distinct().join(have, ["store", "target", "text"], "left_anti")


def last_live(log: DataFrame, n: int) -> DataFrame:
    """Each store's last n rows that aren't retracted (aliases included), to be forgotten."""
    rows = unretracted(log).filter(~F.coalesce("kind", F.lit("note")).isin("keep", "retract"))
    w = Window.partitionBy("store").orderBy(F.col("seq").desc())
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


# ------------------------------------------------------------------ order and merge


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Number the rows of each key from 1 in the given order, without gathering a key in one task: rows are range-partitioned and
    sorted, numbered within their partition, and shifted by the counts of the partitions before (one row a key and partition)."""
    by = [*keys, *order]
    parted = materialise(df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in by)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in by)).withColumn("_part", F.spark_partition_id()), "ordered")
    within = Window.partitionBy("_part", *keys).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    counts = parted.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    shift = shift.select(F.col("_part").alias("_in"), "_before", *(F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)))
    cond = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_of{i}"))
    return parted.withColumn("_rn", F.row_number().over(within)).join(shift, cond, "left").select(*df.columns, (F.col("_rn") + F.coalesce("_before", F.lit(0))).alias(name))


def merge_logs(log: DataFrame, into: Column, rank: Column) -> DataFrame:
    """Logs of several stores as one per value of `into`: distinct by identity (the store of the smallest `rank` wins), in order of
    instant and identity, numbered anew; source and source_seq say where a row came from."""
    rows = log.withColumn("source", F.col("store")).withColumn("source_seq", F.col("seq")).withColumn("_rank", rank).withColumn("store", into)
    one = first_by(rows, KEY, [F.col("_rank").asc(), F.col("source_seq").asc()]).drop("_rank", "seq").withColumn("_instant", instant_micros(F.col("at")))
    return with_ordinal(one, ["store"], ["_instant", "h"], "seq").drop("_instant")
