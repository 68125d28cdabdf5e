"""Stores: tables in a folder of any file system that Spark reads, a table of other stores, and mirrors of those.

Every read and write goes through Hadoop's file systems, so a store may lie on a disk, on HDFS or in an object store. What others fetch is
published as files of lines, many for a large log, with a list of them; web addresses are read by a reader of their own.
"""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as L
from ..schema import LOG, StoreConfig
from .lines import from_lines, to_lines

CONFIG, LINES, LIST, OTHERS, LOG_TABLE, EMBEDDED = "config.json", "log.jsonl", "lines.json", "others", "log.parquet", "embedded"
#: Seconds until a web address counts as unreachable.
PATIENCE = 15


class Disk:
    """A file system of Hadoop, by whole small files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        try:
            return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path
        except Exception as e:
            raise ValueError(f"no file system for {self.root}") from e

    def has(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def read(self, name: str) -> bytes:
        fs, path = self._at(name)
        if not fs.exists(path):
            raise FileNotFoundError(f"{self.root}/{name}")
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, content: bytes) -> None:
        """All or nothing: a new file takes the old one's place."""
        fs, path = self._at(name)
        _, new = self._at(f"{name}.{uuid.uuid4().hex[:8]}")
        stream = fs.create(new, True)
        stream.write(bytearray(content))
        stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        fs.rename(new, path)

    def names(self, folder: str) -> list[str]:
        fs, path = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isFile())

    def size(self, name: str) -> int:
        fs, path = self._at(name)
        return fs.getFileStatus(path).getLen()

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def rename(self, old: str, new: str) -> None:
        fs, path = self._at(old)
        fs.rename(path, self._at(new)[1])


def web_reader(spark: SparkSession, address: str) -> Callable[[str], bytes]:  # noqa: ARG001
    """The files under a web address."""

    def read(name: str) -> bytes:
        try:
            with urllib.request.urlopen("/".join((address.rstrip("/"), name)), timeout=PATIENCE) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise FileNotFoundError(f"{address}: {name}") from e
            raise

    return read


#: How the files of a store elsewhere are read, by the scheme of its address: (session, address) -> (name -> bytes, FileNotFoundError without it).
#: Users add theirs; whatever isn't listed is asked of Hadoop.
READERS: dict[str, Callable[[SparkSession, str], Callable[[str], bytes]]] = {"http": web_reader, "https": web_reader}


def reader(spark: SparkSession, address: str) -> Callable[[str], bytes]:
    """The reader of an address; ValueError if nothing reads its scheme."""
    scheme, _, rest = address.partition("://")
    if rest and scheme in READERS:
        return READERS[scheme](spark, address)
    disk = Disk(spark, address)
    disk._at("")
    return disk.read


class Store:
    """A store: its configuration, and its log as a table to which each append adds files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.disk = spark, path.rstrip("/"), Disk(spark, path)
        self.name = self.path.rsplit("/", 1)[-1]
        if not self.disk.has(CONFIG):
            raise FileNotFoundError(f"no store at {path}")
        self.config = StoreConfig(**json.loads(self.disk.read(CONFIG)))

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: StoreConfig) -> "Store":
        disk = Disk(spark, path)
        if disk.has(CONFIG):
            raise FileExistsError(f"there is a store at {path}")
        disk.write(CONFIG, json.dumps(config.to_dict(), indent=1).encode())
        return cls(spark, path)

    @property
    def table(self) -> str:
        return f"{self.path}/{LOG_TABLE}"

    def log(self) -> DataFrame:
        if not self.disk.has(LOG_TABLE):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(self.table)

    def vectors(self, log: DataFrame) -> DataFrame:
        """(store, h, k, v) of a log's rows, written. Texts go through the model once in a store's life: what it made of them is kept."""
        from ..session import materialise, write_out
        from .embed import embed_missing, fold_vectors, spoken_texts

        shape = "digest string, vec array<float>"
        kept = lambda: self.spark.read.schema(shape).parquet(f"{self.path}/{EMBEDDED}") if self.disk.has(EMBEDDED) else self.spark.createDataFrame([], shape)
        new = write_out(embed_missing(spoken_texts(log), kept(), embedder=self.config.model, dim=self.config.d_embed), "embedded")
        if not new.df.isEmpty():
            new.df.write.mode("append").parquet(f"{self.path}/{EMBEDDED}")
        new.drop()
        return materialise(fold_vectors(log, self.config, kept().dropDuplicates(["digest"])), "vectors")

    def append(self, entries: DataFrame, infer: bool = False) -> int:
        """Add entries (ENTRY's columns; in order of instant and identity) that the log lacks, and their questions; the number of entries added.
        With infer, those without topic displace what they are near to."""
        return self.add(entries, infer).filter(L.is_entry() | (F.col("kind") != "alias")).count()

    def add(self, entries: DataFrame, infer: bool = False) -> DataFrame:
        """The rows that append adds."""
        from ..functions.identity import identity_column
        from ..functions.time import instant_micros
        from ..operators.infer import displacements, with_displacements
        from ..session import materialise

        named = entries.withColumn("store", F.lit(self.name)).withColumn("_h", identity_column()).withColumn("_i", instant_micros(F.col("at")))
        ordered = L.with_ordinal(named, ["store"], ["_i", "_h"], "ord").drop("_h", "_i")
        log = self.log()
        new = materialise(L.append(log, ordered), "appended")
        if infer and not new.isEmpty():
            both = log.unionByName(new)
            found = displacements(both, self.vectors(both), self.config.dim, since=new.agg(F.min("seq")).first()[0])
            new = materialise(with_displacements(new, found).select(*log.columns), "inferred")
        new.write.mode("append").parquet(self.table)
        return new

    def collisions(self, entries: DataFrame) -> DataFrame:
        """Which topics of entries to be added are held by something else (see operators.infer)."""
        from ..functions.identity import identity_column
        from ..operators.infer import collisions

        log = self.log()
        new = entries.filter("topic <> ''").withColumn("store", F.lit(self.name)).withColumn("h", identity_column())
        made = new.withColumn("seq", F.lit(2**62)).select(*log.columns)
        vec = self.vectors(log.unionByName(made))
        return collisions(log, new.select("store", "h", "topic").join(vec.select("store", "h", "v"), ["store", "h"]), vec)

    def keep(self, prefix: str, at: str) -> None:
        self.append(L.keep_event(self.log(), prefix, self.name, at).drop("store", "ord"))

    def forget(self, prefixes: list[str], at: str, last: int = 0) -> int:
        named = list(prefixes) + ([r["h"] for r in L.last_live(self.log(), last).select("h").collect()] if last else [])
        return self.append(L.retract_events(self.log(), named, self.name, at).drop("store", "ord"))

    def add_questions(self, prefix: str, questions: list[str], at: str) -> int:
        """Attach questions to the one live entry with this prefix; those it has already are left out."""
        h = L.exactly_one(L.by_prefix(L.live_rows(self.log()), prefix), prefix)["h"]
        asked = self.spark.createDataFrame([(self.name, h, q) for q in questions], "store string, target string, text string")
        fresh = [r["text"] for r in L.fresh_questions(self.log(), asked).collect()]
        rows = None
        for q in fresh:
            e = L.event(self.spark, self.name, "alias", h, at, q).drop("store", "ord")
            rows = e if rows is None else rows.unionByName(e)
        if rows is not None:
            self.append(rows)
        return len(fresh)

    # ---------------------------------------------------------- other stores

    def _registered(self) -> DataFrame:
        """(name, addr, no): the table of other stores, one small file a change; of a name the last row counts, a null address takes it out."""
        if not self.disk.has(OTHERS):
            return self.spark.createDataFrame([], "name string, addr string, no bigint")
        return self.spark.read.schema("name string, addr string, no bigint").parquet(f"{self.path}/{OTHERS}")

    def _register(self, name: str, addr: str | None) -> None:
        no = (self._registered().agg(F.max("no")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, addr, no)], "name string, addr string, no bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/{OTHERS}")

    def others(self) -> list[dict]:
        last = self._registered().groupBy("name").agg(F.max_by("addr", "no").alias("addr"), F.max("no").alias("no"))
        return [{"name": r["name"], "addr": r["addr"]} for r in last.filter("addr is not null").orderBy("no").collect()]

    def add_other(self, addr: str, name: str | None = None) -> dict:
        """Register another store that answers with a configuration; ValueError if its name is taken."""
        from ..functions.text import name_slug

        if name is None:
            last = addr.rstrip("/").rsplit("/", 1)[-1]
            name = self.spark.range(1).select(name_slug(F.lit(last))).first()[0] or "store"
        if name == self.name or name in {o["name"] for o in self.others()}:
            raise ValueError(f"there is a store named {name}")
        StoreConfig(**json.loads(reader(self.spark, addr)(CONFIG)))
        self._register(name, addr)
        return {"name": name, "addr": addr}

    def remove_other(self, name: str) -> bool:
        known = name in {o["name"] for o in self.others()}
        if known:
            self._register(name, None)
        return known

    def recompiled(self, config: StoreConfig, out: str | None = None) -> tuple["Store", str | None]:
        """This store's log and register of others under another configuration, at `out`, or in its own place; then the old one is kept beside it,
        under the name returned."""
        where = out or f"{self.path}.{uuid.uuid4().hex[:8]}"
        new = Store.create(self.spark, where, config)
        self.log().write.parquet(new.table)
        if self.disk.has(OTHERS):
            self._registered().coalesce(1).write.parquet(f"{where}/{OTHERS}")
        if out:
            return new, None
        folder = self.path.rsplit("/", 1)[0] if "/" in self.path else "."
        beside, backup = Disk(self.spark, folder), f"{self.name}.before-{uuid.uuid4().hex[:8]}"
        beside.rename(self.name, backup)
        beside.rename(where.rsplit("/", 1)[-1], self.name)
        return Store(self.spark, self.path), backup

    def publish(self) -> None:
        """Write the log as files of lines in its order, for others to fetch, and then the list of them with their sizes. Older files go."""
        old = json.loads(self.disk.read(LIST))["folder"] if self.disk.has(LIST) else None
        folder = f"lines-{uuid.uuid4().hex[:8]}"
        to_lines(self.log().orderBy("seq")).write.text(f"{self.path}/{folder}")
        files = [{"name": f"{folder}/{n}", "bytes": self.disk.size(f"{folder}/{n}")} for n in self.disk.names(folder) if n.startswith("part-")]
        self.disk.write(LIST, json.dumps({"folder": folder, "files": files}).encode())
        if old:
            self.disk.delete(old)

    def mirror(self, other: dict) -> "Store":
        """A read-only copy of another store. It is brought up to date where the list of the other's files, or its one file of lines, has
        changed, byte by byte, and made anew where its configuration has. A store that can't be reached is as it was mirrored last."""
        disk = Disk(self.spark, f"{self.path}/mirrors/{other['name']}")
        try:
            read = reader(self.spark, other["addr"])
            config = read(CONFIG)
            try:
                said = read(LIST)
                names = [f["name"] for f in json.loads(said)["files"]]
            except FileNotFoundError:
                said, names = None, [LINES]
            first = None if said is not None else read(LINES)
            stamp = hashlib.sha256(config + b"\0" + (said if said is not None else first)).hexdigest().encode()
            if not (disk.has("stamp") and disk.read("stamp") == stamp):
                new = Disk(self.spark, f"{disk.root}-{uuid.uuid4().hex[:8]}")
                for n, name in enumerate(names):  # a file at a time
                    new.write(f"raw/{n:06}.jsonl", first if first is not None else read(name))
                if not names:
                    new.write("raw/000000.jsonl", b"")
                from_lines(self.spark, f"{new.root}/raw", other["name"]).write.parquet(f"{new.root}/{LOG_TABLE}")
                new.write(CONFIG, config)
                new.write("stamp", stamp)
                new.delete("raw")
                disk.delete()
                Disk(self.spark, f"{self.path}/mirrors").rename(new.root.rsplit("/", 1)[-1], other["name"])
        except (OSError, ValueError):
            if not disk.has("stamp"):
                raise
        return Store(self.spark, disk.root)

    def readable(self) -> tuple[dict[str, "Store"], list[str]]:
        """This store and the others that answer, or did, and have a matching configuration; warnings for the rest."""
        found, warnings = {self.name: self}, []
        for o in self.others():
            try:
                s = self.mirror(o)
            except (OSError, ValueError) as e:
                warnings.append(f"store {o['name']} can't be read: {e}")
                continue
            bad = self.config.mismatch(s.config)
            if bad:
                warnings.append(f"store {o['name']} skipped: other {', '.join(bad)}")
            else:
                found[o["name"]] = s
        return found, warnings
