"""Deduplicating new batches against everything accepted before, without reading that again.

What has been accepted is kept as an index of tables bucketed by hash: one of entries, by the hash of an identity, of a content (the normalised
words) or of a unit, and one of sets. A batch is hashed, and bucket-local joins find full copies (content hash) and texts that share
units; their coverage is verified exactly; what is accepted is appended. The units are the runs of words by which closeness is defined:
hashes of whole paragraphs, as the method has them, would miss close texts, since an edit changes the paragraph's hash. Only some units
of a text are indexed, enough that close texts share one (prefix filter).

Which units come first in that order may change at any time. A unit has a level: 0 until it is in LIST texts of a batch or of its list in the
index, then one more for every GROWTH-fold; units of a higher level come later. Units only rise. When some do, the sets
that are listed under them get new prefixes, and what was listed under a former level is never met again (entries and lookups must agree in
the level), so a template that appears in later batches soon leads no prefix. Lists are thinned when tables are compacted.

Acceptance is sequential by definition: a row is refused if it repeats a row *accepted* before it. The batch's own conflicts are decided in
order in one task as long as they are few enough for it; more of them first in rounds, in each of which every row accepted
is first among its undecided neighbours, and then range by range.
"""

from __future__ import annotations

import math
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Written, give_back, shared_dir, write_out
from .shingles import Closeness, prefix_sets, prefixes, shingled

#: A unit in fewer texts has level 0; of every GROWTH times as many, one more.
LIST, GROWTH = 16, 4
#: Lists of this level (16 384 texts or more) are joined by a shuffle, in which hot keys are split.
HOT = 6
#: The levels of entries that aren't units.
IDENTITY, CONTENT = -2, -1
#: After so many appends a table is rewritten into the one of the next tier; after so many batches the lengths of lists are looked at.
FAN, RENEW = 8, 8
#: After so many batches the driver gives back what planning them took.
TIDY = 2
#: While a batch and all before it have fewer nodes, generated code would take longer to compile than to run, and fill the driver's memory.
SMALL = 20_000
#: Up to so many units of a batch (some 10 MB a bucket) are hashed in the tasks that look them up, so that the index needn't be sorted.
HASHED = 1_000_000


def level(count: Column) -> Column:
    return F.when(count < LIST, 0).otherwise(F.floor(F.log(count / LIST) / math.log(GROWTH) + 1e-9) + 1).cast("int")


class Scratch:
    """Tables written while a batch is decided."""

    def __init__(self) -> None:
        self.written: list[Written] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(write_out(df, name))
        return self.written[-1].df

    def drop(self) -> None:
        for w in self.written:
            w.drop()


@dataclass
class AcceptedIndex:
    """The accepted rows' entries and sets, and the units' levels: tables bucketed into `buckets` by their hash.

    Each kind has one table a tier; a batch appends one file a bucket to the lowest, and FAN appends are rewritten as one of the next, so
    a kind has a few tables however many batches there were."""

    spark: SparkSession
    threshold: float = 0.8
    size: int = 5
    least_words: int = 8
    buckets: int | None = None
    name: str = field(default_factory=lambda: f"accepted_{uuid.uuid4().hex[:10]}")
    tables: dict[str, list[dict]] = field(default_factory=dict)
    folder: str = ""
    batches: int = 0
    nodes: int = 0
    highest: int = 0

    SCHEMAS = {
        "entries": ("key", "key bigint, kname string, klvl int, kept bigint, kn int, kpos int"),
        "sets": ("kept", "kept bigint, kgrams array<bigint>"),
        "levels": ("key", "key bigint, lvl int"),
    }

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = self.folder or f"{shared_dir(self.spark)}/verbatrix"
        self.tables = {kind: self.tables.get(kind, []) for kind in self.SCHEMAS}
        self.close = Closeness(self.threshold)
        # with it, Spark 4.1 takes a union of bucketed tables for one that is bucketed, and a group comes out once a table
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")

    def manifest(self) -> dict:
        """What another session needs to go on with this index (plain data); its files stay in `folder`."""
        return {k: getattr(self, k) for k in ("threshold", "size", "least_words", "buckets", "name", "tables", "folder", "batches", "nodes", "highest")}

    @classmethod
    def attach(cls, spark: SparkSession, manifest: dict) -> "AcceptedIndex":
        """The index of a manifest: its tables are declared over the files that are there."""
        index = cls(spark, **{**manifest, "tables": {k: [dict(t) for t in v] for k, v in manifest["tables"].items()}})
        for kind, tables in index.tables.items():
            key, schema = cls.SCHEMAS[kind]
            for t in tables:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {t['name']} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {index.buckets} BUCKETS LOCATION '{index.path(t)}'")
        return index

    def path(self, table: dict) -> str:
        return f"{self.folder}/{table['name']}"

    def append(self, kind: str, rows: DataFrame, tier: int = 0) -> None:
        """Write rows into the table of this kind and tier; one file a bucket."""
        key = self.SCHEMAS[kind][0]
        table = next((t for t in self.tables[kind] if t["tier"] == tier), None)
        if table is None:
            table = {"name": f"{self.name}_{kind}_{uuid.uuid4().hex[:8]}", "tier": tier, "appends": 0}
            self.tables[kind].append(table)
        rows.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("path", self.path(table)).format("parquet").mode("append").saveAsTable(table["name"])
        table["appends"] += 1

    def remove(self, kind: str, table: dict) -> None:
        self.tables[kind].remove(table)
        self.spark.sql(f"DROP TABLE IF EXISTS {table['name']}")
        Written(self.spark, self.path(table)).drop()

    def files(self, kind: str, tables: list[dict] | None = None) -> DataFrame:
        """The rows of a kind's tables as plain files, without their buckets."""
        schema = self.SCHEMAS[kind][1]
        paths = [self.path(t) for t in (self.tables[kind] if tables is None else tables)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def levels(self) -> DataFrame:
        return self.spark.table(self.tables["levels"][0]["name"]) if self.tables["levels"] else self.spark.createDataFrame([], self.SCHEMAS["levels"][1])

    def joined(self, kind: str, rows: DataFrame, columns: list[str], within: dict[str, DataFrame] | None = None) -> DataFrame:
        """rows joined with all of the index' tables of this kind on its hash, each bucket for itself; or with other rows of the kind."""
        key, schema = self.SCHEMAS[kind]
        others = [within[kind]] if within is not None else [self.spark.table(t["name"]) for t in self.tables[kind]] or [self.spark.createDataFrame([], schema)]
        out = [rows.join(o, key).select(*columns) for o in others]
        df = out[0]
        for o in out[1:]:
            df = df.unionByName(o)
        return df

    def prefixes_of(self, sets: DataFrame, key: str) -> DataFrame:
        """(gram, lvl, key, n, pos): the units under which sets (key, grams) are listed, in the order of now."""
        ordered = prefix_sets(sets, key, self.levels().toDF("gram", "df"), self.close, shared_only=False)
        return prefixes(ordered, key, self.close, []).withColumnRenamed("df", "lvl")

    def raise_units(self, rose: DataFrame) -> None:
        """Give units (key, was, lvl) their new level; the sets listed under them are listed anew."""
        scratch = Scratch()
        top = rose.agg(F.max("lvl")).first()[0]
        if top is not None:
            rose = scratch.keep(rose, "rose")
            self.highest = max(self.highest, top)
            old = list(self.tables["levels"])
            now = self.files("levels").join(rose.select("key"), "key", "left_anti").unionByName(rose.select("key", "lvl")) if old else rose.select("key", "lvl")
            now = scratch.keep(now, "levels")
            for t in old:
                self.remove("levels", t)
            self.append("levels", now)
            if self.tables["entries"]:
                listed = self.joined("entries", rose.select("key", "was"), ["kept", "klvl", "was"]).filter("klvl = was").select("kept").distinct()
                sets = scratch.keep(self.joined("sets", listed, ["kept", "kgrams"]).toDF("kept", "grams"), "listed")
                again = self.prefixes_of(sets, "kept")
                self.append("entries", again.select(F.col("gram").alias("key"), F.lit(None).cast("string").alias("kname"), F.col("lvl").alias("klvl"), "kept", F.col("n").alias("kn"), F.col("pos").alias("kpos")))
        scratch.drop()

    def renew(self) -> None:
        """Raise the units whose lists have become long. Each table counts its own lists, bucket by bucket; only long ones are put together."""
        tables = self.tables["entries"]
        long = [self.spark.table(t["name"]).filter("klvl >= 0").groupBy("key", "klvl").agg(F.count("*").alias("c")).filter(F.col("c") * len(tables) >= LIST) for t in tables]
        if long:
            lists = reduce(DataFrame.unionByName, long).groupBy("key", "klvl").agg(F.sum("c").alias("c")).join(self.files("levels"), "key", "left")
            self.raise_units(lists.filter("klvl = coalesce(lvl, 0)").select("key", F.col("klvl").alias("was"), level(F.col("c")).alias("lvl")).filter("lvl > was"))

    def met(self) -> DataFrame:
        """The entries that lookups can meet: those of former levels are left out, and of a set's under one unit the last stays."""
        return self.of_now(self.files("entries"))

    def of_now(self, entries: DataFrame) -> DataFrame:
        once = entries.groupBy("key", "kname", "klvl", "kept", "kn").agg(F.min("kpos").alias("kpos"))
        return once.join(self.files("levels"), "key", "left").filter("klvl < 0 or klvl = coalesce(lvl, 0)").drop("lvl")

    def longest_list(self) -> int:
        """The number of sets in the longest list that lookups can meet."""
        return self.met().filter("klvl >= 0").groupBy("key").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]

    def compact(self) -> None:
        """Rewrite tables of FAN appends into the next tier, without what lookups can't meet."""
        for kind in ("entries", "sets"):
            while full := next((t for t in self.tables[kind] if t["appends"] >= FAN), None):
                rows = self.files(kind, [full])
                self.append(kind, self.of_now(rows) if kind == "entries" else rows, full["tier"] + 1)
                self.remove(kind, full)

    def drop(self) -> None:
        """Delete the index' tables and files."""
        for kind, tables in self.tables.items():
            for t in list(tables):
                self.remove(kind, t)


@dataclass
class _Batch:
    """A batch's nodes (id, h, digest, cid), classes of equal texts (cid, grams), and keys (key, name, lvl, owner, n, pos): of a node its
    identity, of a class its content and the units it is listed under. few_pairs: whether these units have few pairs."""

    index: AcceptedIndex
    nodes: DataFrame
    classes: DataFrame
    keys: DataFrame
    few_pairs: bool
    hashed: bool
    count: int
    pairs_per_entry: int
    task_rows: int
    scratch: Scratch

    def possible(self, a: str, i: str, b: str, j: str) -> Column:
        """Whether sets of sizes a and b whose first common unit is at i and j can be close."""
        return F.expr(self.index.close.close(f"least({a} - {i}, {b} - {j})", a, b))

    def verified(self, x: str, y: str) -> Column:
        return F.expr(self.index.close.close(f"size(array_intersect({x}, {y}))", f"size({x})", f"size({y})"))

    @staticmethod
    def handles(nodes: DataFrame, *keep: str) -> DataFrame:
        """(keep, owner, own): every node under its own id, where its identity is, and under its class."""
        both = F.array(F.struct(F.col("id").alias("owner"), F.lit(True).alias("own")), F.struct(F.col("cid").alias("owner"), F.lit(False).alias("own")))
        return nodes.select(*keep, F.explode(both).alias("_o")).select(*keep, "_o.owner", "_o.own").filter("owner is not null")

    def entries(self, taken: DataFrame) -> dict[str, DataFrame]:
        """What accepted nodes (id, h, cid) add to the index."""
        of = self.handles(taken.withColumn("kept", F.col("id")), "kept")
        keys = self.keys.withColumn("own", F.col("lvl") == IDENTITY).join(of, ["owner", "own"])
        return {
            "entries": keys.select("key", F.col("name").alias("kname"), F.col("lvl").alias("klvl"), "kept", F.col("n").alias("kn"), F.col("pos").alias("kpos")),
            "sets": taken.select(F.col("id").alias("kept"), "cid").join(self.classes, "cid", "left").select("kept", F.coalesce("grams", F.array().cast("array<bigint>")).alias("kgrams")),
        }

    def near_accepted(self, nodes: DataFrame | None = None, within: dict[str, DataFrame] | None = None) -> DataFrame:
        """(owner, own, kept): the accepted rows that the batch, or some of its nodes, repeats, in the index or within other entries."""
        index, keys = self.index, self.keys
        if nodes is not None:
            keys = keys.withColumn("own", F.col("lvl") == IDENTITY).join(self.handles(nodes).distinct(), ["owner", "own"], "left_semi").drop("own")
        columns = ["owner", "lvl", "klvl", "name", "kname", "n", "pos", "kept", "kn", "kpos"]
        hot = within is None and index.highest >= HOT
        cold = keys.filter(F.col("lvl") < HOT) if hot else keys
        met = index.joined("entries", cold.hint("shuffle_hash") if self.hashed else cold, columns, within)
        if hot:
            met = met.unionByName(keys.filter(F.col("lvl") >= HOT).join(index.files("entries").filter(F.col("klvl") >= HOT), "key").select(*columns))
        # sizes and positions of a shared unit first; what they leave is verified once a pair
        met = met.filter(F.col("lvl") == F.col("klvl")).filter(F.col("name").eqNullSafe(F.col("kname"))).filter((F.col("lvl") < 0) | self.possible("n", "pos", "kn", "kpos"))
        met = met.groupBy("owner", (F.col("lvl") == IDENTITY).alias("own"), "kept").agg(F.max(F.col("lvl") < 0).alias("sure"))
        met = met.join(self.classes.withColumnRenamed("cid", "owner"), "owner", "left")
        return index.joined("sets", met, ["owner", "own", "kept", "sure", "grams", "kgrams"], within).filter(F.col("sure") | self.verified("grams", "kgrams")).select("owner", "own", "kept")

    def near_each_other(self, units: DataFrame) -> DataFrame:
        """(cid, near): close classes of the batch, both ways; units are those of the classes in question."""
        left, right = units.alias("x"), units.alias("y")
        pairs = left.join(right, (F.col("x.key") == F.col("y.key")) & (F.col("x.owner") < F.col("y.owner")) & self.possible("x.n", "x.pos", "y.n", "y.pos"))
        pairs = pairs.select(F.col("x.owner").alias("a"), F.col("y.owner").alias("b")).distinct()
        pairs = pairs.join(self.classes.toDF("a", "ga"), "a").join(self.classes.toDF("b", "gb"), "b").filter(self.verified("ga", "gb")).select("a", "b")
        both = F.array(F.struct(F.col("a").alias("cid"), F.col("b").alias("near")), F.struct(F.col("b").alias("cid"), F.col("a").alias("near")))
        return pairs.select(F.explode(both).alias("p")).select("p.cid", "p.near")

    def all_decided(self) -> DataFrame:
        """(id, h, cid, kept) of all nodes; kept is null for the accepted."""
        units = self.keys.filter("lvl >= 0")
        if self.few_pairs and self.count <= self.task_rows:
            near = self.near_accepted().withColumn("near", F.lit(None).cast("bigint"))
            each = self.near_each_other(units).select(F.col("cid").alias("owner"), F.lit(False).alias("own"), F.lit(None).cast("bigint").alias("kept"), "near")
            rows = self.handles(self.nodes, "id", "h", "cid").join(near.unionByName(each), ["owner", "own"], "left")
            return self.scratch.keep(in_order(rows), "decided")
        known = self.looked_up(self.nodes)
        return known.filter("kept is not null").select("id", "h", "cid", "kept").unionByName(self.decided(known.filter("kept is null").drop("kept")))

    def looked_up(self, nodes: DataFrame, within: dict[str, DataFrame] | None = None) -> DataFrame:
        """nodes (id, h, cid) with kept: the accepted row of the smallest key that each repeats, in the index or within other entries."""
        near = self.near_accepted(nodes, within).groupBy("owner", "own").agg(F.min("kept").alias("kept"))
        known = self.handles(nodes, "id", "h", "cid").join(near, ["owner", "own"], "left").groupBy("id", "h", "cid").agg(F.min("kept").alias("kept"))
        return self.scratch.keep(known, "known")

    def decided(self, nodes: DataFrame) -> DataFrame:
        """(id, h, cid, kept) of nodes (id, h, cid) that repeat nothing accepted before them but, maybe, each other; kept is null for the accepted."""
        open_ = nodes.filter("cid is not null").select(F.col("cid").alias("owner")).distinct()
        free = self.scratch.keep(self.keys.filter("lvl >= 0").join(open_, "owner", "left_semi"), "free")
        if many_pairs(free, self.pairs_per_entry):
            middle = nodes.approxQuantile("id", [0.5], 0.05)[0]
            first, rest = nodes.filter(F.col("id") <= middle), nodes.filter(F.col("id") > middle)
            if not first.isEmpty() and not rest.isEmpty():
                done = self.decided(first)
                known = self.looked_up(rest, self.entries(done.filter("kept is null")))
                return done.unionByName(known.filter("kept is not null")).unionByName(self.decided(known.filter("kept is null").drop("kept")))
        around = self.scratch.keep(self.near_each_other(free), "around")
        few = nodes.limit(self.task_rows + 1).count() <= self.task_rows
        return self.scratch.keep(in_one_task(nodes, around) if few else in_rounds(nodes, around, self.task_rows, self.scratch), "decided")


@contextmanager
def interpreted(spark: SparkSession, small: bool) -> Iterator[None]:
    """Plan without whole-stage code generation meanwhile, if what is to be done is small."""
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false" if small else before)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def many_pairs(units: DataFrame, pairs_per_entry: int) -> bool:
    """Whether lists of units hold so many pairs that they had better not be compared all with all."""
    load = units.groupBy("key").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("entries")).first()
    return (load["pairs"] or 0) > pairs_per_entry * (load["entries"] or 0) + 1_000_000 * (pairs_per_entry > 0)


@dataclass
class _Prepared:
    """What a batch is hashed to, whatever the index holds: rows (id, h, digest, grams), nodes (id, h, digest, cid, and a class' grams), the units that
    are in LIST or more of its texts (key, c), the numbers of nodes and of units, and at least how many pairs lists of those units have."""

    key: str
    rows: DataFrame
    nodes: DataFrame
    often: DataFrame
    count: int
    units: int
    pairs: int
    scratch: Scratch


def prepared(index: AcceptedIndex, batch: DataFrame, key: str = "row_id", h: str = "h", text: str = "text") -> _Prepared:
    """A batch, hashed; it may be done while earlier ones are being admitted."""
    scratch = Scratch()
    src = batch.select(F.col(key).cast("bigint").alias("id"), F.col(h).alias("h"), F.col(text).alias("text"))
    rows = scratch.keep(shingled(src, ["id", "h"], "text", index.size, index.least_words), "batch")
    # one node a (h, words), known by its first row; the first node of equal words is their class and keeps their set
    apart = F.coalesce("digest", F.md5("h"))
    nodes = rows.filter("h is not null or digest is not null").groupBy("h", "digest").agg(F.min("id").alias("id"), F.first("grams").alias("grams"))
    first = F.min("id").over(Window.partitionBy("digest", apart))
    nodes = nodes.select("id", "h", "digest", F.when(F.col("digest").isNotNull(), first).alias("cid"), "grams").withColumn("grams", F.when(F.col("id") == F.col("cid"), F.col("grams")))
    nodes = scratch.keep(nodes, "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("grams")), F.lit(0)).alias("units")).first()
    often = nodes.select(F.explode("grams").alias("key")).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= LIST)
    often = scratch.keep(often, "often")
    pairs = often.agg(F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0))).first()[0]
    return _Prepared(key, rows, nodes, often, size["n"], size["units"], pairs, scratch)


def admit(index: AcceptedIndex, batch: DataFrame, key: str = "row_id", h: str = "h", text: str = "text", pairs_per_entry: int = 100, task_rows: int = 200_000) -> DataFrame:
    """(key, kept): for every row of the batch the accepted row of the smallest key that it repeats, null if it is accepted itself;
    the accepted rows are appended to the index.

    Rows are taken in order of key (unique, larger than every key of earlier batches). A row repeats an accepted row that has the
    same non-null h or a close text (Jaccard of the word runs at least the threshold). Null texts and those of fewer than least_words
    words are close to nothing; a row with neither h nor such a text is always accepted. Texts with the same words are copies:
    they are compared once. An empty batch gives no rows; other columns are ignored whatever their names.

    A group of close texts that a third of the batch belongs to isn't compared all with all: where the lists of shared units hold more than
    pairs_per_entry pairs an entry (and a million), the batch is halved in order, so that the first half's few accepted rows refuse most of
    the second. Conflicts among up to task_rows rows are decided in one task, in order; more of them first in rounds. Both
    bounds only choose a way: the result is the same.

    Plan: words and hashes once (written); rows with the same (h, words) collapse to one node by a pre-aggregated shuffle; the batch is
    shuffled to the index' buckets, the index never is (but its lists of HOT level). Nothing is collected.
    """
    return _admitted(index, prepared(index, batch, key, h, text), pairs_per_entry, task_rows)


def admit_all(index: AcceptedIndex, batches: Iterable[DataFrame], key: str = "row_id", h: str = "h", text: str = "text", ahead: int = 2, **bounds: int) -> Iterator[DataFrame]:
    """What admit says of each batch, one after the other; meanwhile up to `ahead` of the next ones are hashed."""
    with ThreadPoolExecutor(1) as hashing:
        waiting: deque = deque()
        for batch in batches:
            waiting.append(hashing.submit(prepared, index, batch, key, h, text))
            if len(waiting) > ahead:
                yield _admitted(index, waiting.popleft().result(), **bounds)
        while waiting:
            yield _admitted(index, waiting.popleft().result(), **bounds)


def _admitted(index: AcceptedIndex, batch: _Prepared, pairs_per_entry: int = 100, task_rows: int = 200_000) -> DataFrame:
    rows, scratch, key = batch.rows, batch.scratch, batch.key
    classes = batch.nodes.filter("id = cid").select("digest", "cid", "grams")
    nodes = batch.nodes.drop("grams")
    index.nodes += batch.count
    with interpreted(index.spark, index.nodes <= SMALL):
        if batch.pairs:  # else no unit is in LIST texts
            index.raise_units(batch.often.join(index.levels(), "key", "left").select("key", F.coalesce("lvl", F.lit(0)).alias("was"), level(F.col("c")).alias("lvl")).filter("lvl > was"))
        named = lambda df, name, of, owner: df.filter(F.col(name).isNotNull()).select(F.xxhash64(F.lit(of), name).alias("key"), F.col(name).alias("name"), F.lit(of).alias("lvl"), F.col(owner).alias("owner"), F.lit(0).alias("n"), F.lit(0).alias("pos"))
        units = index.prefixes_of(classes.select("cid", "grams"), "cid").select(F.col("gram").alias("key"), F.lit(None).cast("string").alias("name"), "lvl", F.col("cid").alias("owner"), "n", "pos")
        keys = scratch.keep(named(nodes, "h", IDENTITY, "id").unionByName(named(classes, "digest", CONTENT, "cid")).unionByName(units), "keys")

        # lists of units that aren't often have fewer than LIST entries; the others' pairs are counted only if there may be too many
        few = (batch.pairs <= 1_000_000 and pairs_per_entry >= LIST) or not many_pairs(keys.filter("lvl >= 0"), pairs_per_entry)
        it = _Batch(index, nodes, classes.select("cid", "grams"), keys, few, batch.units <= HASHED, batch.count, pairs_per_entry, task_rows, scratch)
        decided = it.all_decided()
        # a row that isn't the first of its node repeats that, if it was accepted
        node = nodes.join(decided.select("id", "kept"), "id").select(F.col("h").alias("nh"), F.col("digest").alias("nd"), F.col("id").alias("first"), "kept")
        match = rows["h"].eqNullSafe(node["nh"]) & rows["digest"].eqNullSafe(node["nd"])
        out = rows.select("id", "h", "digest").join(node, match, "left").select(F.col("id").alias(key), F.coalesce("kept", F.when(F.col("first") != F.col("id"), F.col("first"))).alias("kept"))

        new = it.entries(decided.filter("kept is null").drop("kept"))
        with ThreadPoolExecutor(len(new) + 1) as at_once:
            written = at_once.submit(write_out, out, "admitted")
            list(at_once.map(lambda kind: index.append(kind, new[kind]), new))
            out = written.result().df
        index.batches += 1
        if index.batches % RENEW == 0:
            index.renew()
        index.compact()
    scratch.drop()
    if index.batches % TIDY == 0:
        give_back(index.spark)
    return out


def in_one_task(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """(id, h, cid, kept) of nodes taken in order of id: kept is the smallest accepted node before it that shares its h, its cid, or is of a class
    `around` (cid, near) its own; null if there is none, and it is accepted. For a bounded number of nodes: one task takes them."""
    return in_order(nodes.join(around, "cid", "left").select("id", "h", "cid", F.lit(None).cast("bigint").alias("kept"), "near"))


def in_order(rows: DataFrame) -> DataFrame:
    """The same of rows (id, h, cid, kept, near), one for each thing that is near a node: an accepted row of the index, or a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_h: dict[str, int] = {}
        of_c: dict[int, int] = {}
        now = None
        found: list[int] = []
        out: list[tuple] = []

        def ended() -> None:
            i, h, c = now
            kept = min(found + [x for x in (of_h.get(h), of_c.get(c)) if x is not None], default=None)
            if kept is None:
                if h is not None:
                    of_h[h] = i
                if c is not None:
                    of_c[c] = i
            out.append((i, h, c, kept))

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["id", "h", "cid", "kept"])
            out.clear()
            return got

        for b in batches:
            for i, h, c, kept, near in zip(*(b.column(x).to_pylist() for x in ("id", "h", "cid", "kept", "near"))):
                if now is None or i != now[0]:
                    if now is not None:
                        ended()
                    now = i, h, c
                    found.clear()
                if kept is not None:
                    found.append(kept)
                if near in of_c:
                    found.append(of_c[near])
            if out:
                yield batch()
        if now is not None:
            ended()
            yield batch()

    return rows.select("id", "h", "cid", "kept", "near").repartition(1).sortWithinPartitions("id").mapInArrow(run, "id bigint, h string, cid bigint, kept bigint")


def in_rounds(nodes: DataFrame, around: DataFrame, task_rows: int, scratch: Scratch) -> DataFrame:
    """The same for any number of nodes. Nodes that share nothing are accepted at once. Rounds accept every node that is the
    first undecided one around; while they decide little, the first task_rows nodes are taken in order in one task instead, so it ends after
    at most nodes / task_rows such steps."""
    no = F.lit(2**63 - 1)
    h_many = nodes.filter("h is not null").groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select("h", F.lit(1).alias("m1"))
    c_many = nodes.filter("cid is not null").groupBy("cid").agg(F.count("*").alias("k")).filter("k > 1").select("cid", F.lit(1).alias("m2"))
    c_near = around.select("cid").distinct().withColumn("m3", F.lit(1))
    marked = nodes.join(h_many, "h", "left").join(c_many, "cid", "left").join(c_near, "cid", "left")
    state = scratch.keep(marked.select("id", "h", "cid", F.coalesce("m1", "m2", "m3").isNotNull().alias("open")), "rounds")
    taken = [state.filter("not open").select("id", "h", "cid")]
    u, slow = state.filter("open").select("id", "h", "cid"), False
    n = u.count()
    while n:
        if slow or n <= task_rows:
            last = u.agg(F.max("id")).first()[0] if n <= task_rows else int(u.approxQuantile("id", [task_rows / n], min(0.05, task_rows / n / 4))[0])
            done = scratch.keep(in_one_task(u.filter(F.col("id") <= last), around), "range")
            won, rest = done.filter("kept is null").select("id", "h", "cid"), u.filter(F.col("id") > last)
        else:
            m_h = u.filter("h is not null").groupBy("h").agg(F.min("id").alias("m_h"))
            m_c = u.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("m_c"))
            m_n = around.join(m_c.select(F.col("cid").alias("near"), F.col("m_c").alias("m")), "near").groupBy("cid").agg(F.min("m").alias("m_n"))
            first = u.join(m_h, "h", "left").join(m_c, "cid", "left").join(m_n, "cid", "left")
            step = scratch.keep(first.select("id", "h", "cid", (F.col("id") <= F.least(F.coalesce("m_h", no), F.coalesce("m_c", no), F.coalesce("m_n", no))).alias("in")), "rounds")
            won, rest = step.filter("in").select("id", "h", "cid"), step.filter("not in").select("id", "h", "cid")
        taken.append(won)
        # what repeats a winner is refused and leaves
        w_h = won.filter("h is not null").select("h", F.lit(1).alias("b1")).distinct()
        w_c = won.filter("cid is not null").select("cid", F.lit(1).alias("b2")).distinct()
        w_n = around.join(won.filter("cid is not null").select(F.col("cid").alias("near")), "near", "left_semi").select("cid").distinct().withColumn("b3", F.lit(1))
        u = scratch.keep(rest.join(w_h, "h", "left").join(w_c, "cid", "left").join(w_n, "cid", "left").filter("b1 is null and b2 is null and b3 is null").select("id", "h", "cid"), "undecided")
        before, n = n, u.count()
        slow = n > 0.8 * before
    accepted = taken[0]
    for t in taken[1:]:
        accepted = accepted.unionByName(t)
    accepted = scratch.keep(accepted, "accepted")
    # the smallest accepted neighbour of every refused node
    a_h = accepted.filter("h is not null").groupBy("h").agg(F.min("id").alias("in_h"))
    a_c = accepted.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("in_c"))
    a_n = around.join(a_c.select(F.col("cid").alias("near"), "in_c"), "near").groupBy("cid").agg(F.min("in_c").alias("in_n"))
    node = nodes.join(accepted.select("id", F.lit(True).alias("own")), "id", "left").join(a_h, "h", "left").join(a_c, "cid", "left").join(a_n, "cid", "left")
    return node.select("id", "h", "cid", F.when(F.col("own").isNull(), F.least("in_h", "in_c", "in_n")).alias("kept"))
