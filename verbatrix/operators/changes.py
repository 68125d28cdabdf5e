"""Applying a feed of inserts, updates and deletes that arrives repeated and out of order.

Two operators. `merge_changes` is the plain one: key, order, delete flag. `current_entries` applies the entry log's own
changes (kind, target, displaces, at) and gives each store's current entries with the displacement in force on each.

Both rank with row_number() = 1. Spark plans that as a WindowGroupLimit below the exchange, so of a hot key at most one
row a task is shuffled; no group is collected, nothing is broadcast by us.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.time import instant_micros
from ..session import materialise

SPECIAL_KINDS = ("keep", "retract", "alias")
LONG_AGO = -(2**63)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_changes(base: DataFrame | None, changes: DataFrame, key: list[str], change_id: list[str], order: list[str], delete: Column) -> DataFrame:
    """The table `base` after `changes`.

    change_id: names a change; of rows with one identifier the first in `order` counts, so repeats do nothing.
    order: columns that order the changes of one key; the last wins, base rows come before every change.
    delete: true on a change that deletes its key (null counts as false).

    A key with null parts is a key like any other (nulls are equal). Ties in `order` are broken by the change identifier.
    Empty tables give base or the empty table. Columns of base that the changes lack are null in changed rows; columns that
    only the changes have (order and identifier aside) are added.
    """
    of = lambda c: F.col(f"`{c}`")
    once = first_by(changes, change_id, [of(c).asc_nulls_first() for c in order])
    rank = [of(c).desc_nulls_last() for c in [*order, *change_id]]
    last = first_by(once.withColumn("_gone", F.coalesce(delete, F.lit(False))), key, rank).withColumn("_new", F.lit(1))
    helper = [c for c in [*order, *change_id] if c not in key and (base is None or c not in base.columns)]
    last = last.drop(*helper)
    if base is not None:
        # the full set of columns of base, then one row a key: the change if there is one
        last = base.withColumns({"_gone": F.lit(False), "_new": F.lit(0)}).unionByName(last, allowMissingColumns=True)
        last = first_by(last, key, [F.col("_new").desc()])
    return last.filter(~F.col("_gone")).drop("_gone", "_new")


def feed_rows(log: DataFrame) -> DataFrame:
    """The feed's changes once each: of rows with one (store, h) that with the smallest seq. Text and other payload stay
    behind in the scan; a row without h names no entry and is a change of its own, known by its seq."""
    narrow = log.select(
        "store",
        "h",
        "kind",
        F.coalesce(instant_micros(F.col("at")), F.lit(LONG_AGO)).alias("instant"),
        F.when(F.col("topic") != "", F.col("topic")).alias("topic"),
        "target",
        "displaces",
        "seq",
        F.when(F.col("h").isNull(), F.col("seq")).alias("_lone"),
    )
    return first_by(narrow, ["store", "h", "_lone"], [F.col("seq").asc()])


def current_entries(log: DataFrame) -> DataFrame:
    """(store, h, displaced_by, seq) of every entry current in its store.

    log: seq, store, h, at, kind, topic, target, displaces; other columns are ignored, whatever their names.
    Repeats of a (store, h) count once (smallest seq). Kinds keep, retract and alias are no entries, null is one. A retract
    removes its target whenever it is delivered. Of the entries of a topic the last by (instant, h) is current; one with null
    or empty topic stands alone. displaced_by is the h of the entry, not removed, that names this one with the largest weight
    (ties: smaller h; a null weight is the smallest), without those not later than a keep of this entry; '' if none.
    Unknown or null targets do nothing. A null or unreadable `at` is before every other instant. A row with null h is an
    entry that nothing can name. A null store is a store. An empty log gives no rows.

    Plan: one shuffle of the narrow columns to drop repeats, written once; then an anti join, a left join of edges with
    keeps and a left join back, all on (store, h), and one shuffle by (store, topic). Hot keys: ranks and maxima are
    reduced before they are shuffled; a hot side of a join is split by adaptive execution.
    """
    rows = materialise(feed_rows(log), "feed")
    store = F.col("store")
    same = lambda a, b, c: a["store"].eqNullSafe(b["store"]) & (a[c] == b["_target"])

    special = rows.filter(F.col("target").isNotNull())
    gone = special.filter("kind = 'retract'").select("store", F.col("target").alias("_target")).distinct()
    entries = rows.filter(~F.coalesce(F.col("kind"), F.lit("")).isin(*SPECIAL_KINDS))
    live = entries.join(gone, same(entries, gone, "h"), "left_anti")

    kept = special.filter("kind = 'keep'").groupBy("store", F.col("target").alias("_target")).agg(F.max("instant").alias("_kept"))
    edges = live.select("store", "h", "instant", F.explode("displaces").alias("d")).select(
        "store", F.col("d.target_h").alias("to"), F.coalesce(-F.col("d.w"), F.lit(float("inf"))).alias("nw"), "h", "instant"
    ).filter(F.col("to").isNotNull())
    standing = edges.join(kept, same(edges, kept, "to"), "left").filter(F.col("_kept").isNull() | (F.col("instant") > F.col("_kept")))
    strongest = standing.groupBy(edges["store"], F.col("to").alias("_target")).agg(F.min(F.struct("nw", "h")).alias("_by"))

    last = first_by(
        live.select(store, "h", "instant", "seq", F.when(F.col("topic").isNotNull(), F.concat(F.lit("t"), "topic")).otherwise(F.concat(F.lit("s"), "seq")).alias("_slot")),
        ["store", "_slot"],
        [F.col("instant").desc(), F.col("h").desc(), F.col("seq").desc()],
    )
    return last.join(strongest, same(last, strongest, "h"), "left").select(
        last["store"], last["h"], F.coalesce(F.col("_by.h"), F.lit("")).alias("displaced_by"), "seq"
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """One frame of several with the same columns."""
    return reduce(DataFrame.unionByName, frames)
