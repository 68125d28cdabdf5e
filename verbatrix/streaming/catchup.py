"""Catching up: the log as a stream, the derived tables as what each micro-batch adds to them.

Postings and lengths of new live rows are appended, named by their batch so that a batch done again after a failure replaces its own
files. An event (keep or retract) acts on rows of any time: retracted rows are anti-joined when the tables are read, so nothing is patched
in place and any cutting of the log into batches gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entry_text
from ..operators.lexical import lengths, postings
from ..operators.log import is_entry, targets

KEY = ["store", "seq", "h"]


class DerivedTables:
    """postings, lengths and events in a folder, each written by batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """What one batch of log rows adds."""
        batch = batch.persist()
        docs = batch.filter(is_entry()).select(*KEY, entry_text(F.col("topic"), F.col("text")).alias("doc"))
        at = f"batch={batch_id}"
        postings(docs, KEY, F.col("doc")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/postings/{at}")
        lengths(docs, KEY, F.col("doc")).write.mode("overwrite").parquet(f"{self.folder}/lengths/{at}")
        batch.select("store", "seq", "h", "kind", "topic", "at", "target", "displaces").write.mode("overwrite").parquet(f"{self.folder}/rows/{at}")
        batch.unpersist()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """The narrow log so far, repeats dropped."""
        from ..operators.log import distinct_log

        return distinct_log(self.read("rows").drop("batch"))

    def live(self, name: str) -> DataFrame:
        """A derived table's part for rows that live."""
        rows = self.rows()
        alive = rows.filter(is_entry()).join(targets(rows, "retract"), ["store", "h"], "left_anti").select("store", "seq")
        return self.read(name).drop("batch").join(alive, ["store", "seq"], "left_semi")


def catch_up(spark: SparkSession, log_dir: str, schema: str, folder: str, files_per_batch: int = 64) -> DerivedTables:
    """Run all log files that aren't derived yet through the tables, and stop; a checkpoint remembers how far it came. log_dir may be
    one file: then that file of its folder is the stream."""
    tables = DerivedTables(spark, folder)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(log_dir)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, log_dir = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(log_dir)
    query = stream.writeStream.foreachBatch(tables.advance).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return tables
