"""Groups of records that differ by small edits.

Method: an exact set similarity join with skipping by set relations. Every set's rare grams are indexed in lists (a gram's
sets, ordered by size and position); a list is cut into blocks of one size and position, and for a probing set whole blocks
are skipped whose position or size rules closeness out. Within a list, a set close to one whose overlaps are known has its
own overlaps bounded by those: they are accepted or skipped without looking at the sets, unless the bounds leave it open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components
from .shingles import Closeness, prefix_sets, prefixes, shingled


#: Elements of hash tables that a list keeps (some 150 MB); the sets themselves take eight bytes an element, as they came.
MOST_HASHED = 2_000_000


class IndexList:
    """One gram's list; links() gives pairs that connect all of its close sets."""

    def __init__(self, ids: list[int], n: list[int], pos: list[int], slot: list[int], sets: list[np.ndarray], across: bool, over: int, under: int):
        self.ids, self.n, self.pos, self.slot, self.across = ids, n, pos, slot, across
        self.arrays, self.sets, self.hashed = sets, {}, 0
        self.over, self.under = over, under
        # entries come ordered by size and position: a block is a slice
        cut = [0, *(i for i in range(1, len(n)) if (n[i], pos[i]) != (n[i - 1], pos[i - 1])), len(n)]
        self.blocks = [(n[s], pos[s], s, e) for s, e in zip(cut, cut[1:])]

    def set_of(self, i: int) -> frozenset[int]:
        """A set's hash table, made when it is looked at; tables of more than MOST_HASHED elements in all aren't kept."""
        got = self.sets.get(i)
        if got is None:
            if self.hashed > MOST_HASHED:
                self.sets.clear()
                self.hashed = 0
            got = self.sets[i] = frozenset(self.arrays[i].tolist())
            self.hashed += len(got)
        return got

    def links(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        group = list(range(len(self.ids)))
        members: dict[int, list[int]] = {i: [i] for i in group}
        known: dict[int, dict[int, int]] = {}  # overlaps of a set that has been probed
        like: dict[int, tuple[int, int]] = {}  # of a set a probed one close to it, and their overlap
        over, under = self.over, self.under
        for x in range(len(self.ids)):
            if len(members) == 1:
                break
            nx, px, own = self.n[x], self.pos[x], {}
            model, shared = like.get(x, (None, 0))
            answers = known.get(model, {})
            gain, loss = nx - shared, (self.n[model] - shared if model is not None else 0)
            for nb, pb, s, e in self.blocks:
                if e <= x + 1:
                    continue
                if nx * (over - under) < under * nb:
                    break  # this and all larger ones are too large
                if min(nx - px, nb - pb) * over < under * (nx + nb):
                    continue
                for y in range(max(s, x + 1), e):
                    if group[y] == group[x] or (self.across and self.slot[x] == self.slot[y]):
                        continue
                    o = answers.get(y)
                    if o is not None and (o + gain) * over < under * (nx + nb):
                        continue  # even the upper bound isn't enough
                    if o is None or (o - loss) * over < under * (nx + nb):
                        o = own[y] = len(self.set_of(x) & self.set_of(y))
                        if o * over < under * (nx + nb):
                            continue
                        like[y] = (x, o)
                    out.append((self.ids[x], self.ids[y]))
                    keep, gone = (group[x], group[y]) if len(members[group[x]]) >= len(members[group[y]]) else (group[y], group[x])
                    for z in members[gone]:
                        group[z] = keep
                    members[keep] += members.pop(gone)
            if own:
                known[x] = own
        return out


def close_links(sets: DataFrame, key: str = "cid", threshold: float = 0.6, list_size: int = 4000) -> DataFrame:
    """(a, b): pairs of close sets that connect every group of close sets (not all its pairs).

    sets: key BIGINT, grams ARRAY<BIGINT> (distinct). A list of more than list_size entries is dealt into parts, and every pair
    of parts is a list of its own: nothing is left out, no task holds more than two parts.
    """
    close = Closeness(threshold)
    frequency = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = prefix_sets(sets, key, frequency, close, shared_only=True).withColumn("all", F.col("o.gram"))
    entries = prefixes(ordered, key, close, ["all"]).withColumn("parts", F.ceil(F.col("df") / list_size).cast("int")).withColumn("slot", F.pmod(F.hash(key), F.col("parts")))
    entries = entries.select(F.col("gram"), F.explode(F.expr("sequence(0, parts - 1)")).alias("other"), "slot", F.col(key).alias("cid"), "n", "pos", "all")
    entries = entries.select("gram", F.least("slot", "other").alias("p"), F.greatest("slot", "other").alias("q"), "n", "pos", "cid", "slot", "all")
    over, under = close.over, close.under

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        now = None
        out: list[tuple[int, int]] = []

        def ended() -> None:
            if len(held) > 1:
                n, pos, ids, slot, sets_ = zip(*held)
                out.extend(IndexList(ids, n, pos, slot, sets_, now[1] != now[2], over, under).links())

        def batch() -> pa.RecordBatch:
            ab = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        for b in batches:
            keys = zip(b.column("gram").to_pylist(), b.column("p").to_pylist(), b.column("q").to_pylist())
            grams, at = b.column("all").flatten().to_numpy(), b.column("all").offsets.to_numpy()
            at = at - at[0]
            rest = zip(*(b.column(c).to_pylist() for c in ("n", "pos", "cid", "slot")))
            for i, (k, r) in enumerate(zip(keys, rest)):
                if k != now:
                    ended()
                    held.clear()
                    now = k
                held.append((*r, grams[at[i] : at[i + 1]]))
            if out:
                yield batch()
        ended()
        if out:
            yield batch()

    lists = entries.repartition("gram", "p", "q").sortWithinPartitions("gram", "p", "q", "n", "pos", "cid")
    return lists.mapInArrow(probe, "a bigint, b bigint").distinct()


def near_duplicate_groups(df: DataFrame, key: str = "seq", text: str = "text", threshold: float = 0.8, size: int = 5, least_words: int = 8, list_size: int = 4000) -> DataFrame:
    """(group_<key>, <key>): one row of every row in a group of two or more; a group is what a chain of close texts links, named by
    its smallest key.

    Texts are close if their sets of runs of `size` consecutive words have a Jaccard similarity of at least `threshold`; null texts
    and those with fewer than `least_words` words are close to nothing. Texts with the same words are one class, compared once.
    key must be unique and not null. Ties need no rule. An empty table gives none; other columns are ignored whatever their names.

    Plan: words and hashes in the JVM, written once; a shuffle by digest to classes; gram counts and their join back; a shuffle of
    prefix entries to lists; components. A hot digest is pre-aggregated, a hot gram comes last in every set's order and its list
    is split. Exact: no sampling, no cap on candidates.
    """
    src = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = materialise(shingled(src, ["id"], "text", size, least_words), "shingles").filter(F.col("digest").isNotNull())
    classes = materialise(rows.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("copies"), F.first("grams").alias("grams")), "classes")
    linked = components(close_links(classes, "cid", threshold, list_size))
    named = classes.join(linked, classes["cid"] == linked["node"], "left").filter("copies > 1 or root is not null").select("digest", F.coalesce("root", "cid").alias("group"))
    return rows.join(named, "digest").select(F.col("group").alias(f"group_{key}"), F.col("id").alias(key))
