"""The change feed as a stream: each micro-batch adds what it brings, and what is current is read from all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.changes import current_entries

COLUMNS = ("seq", "store", "h", "at", "kind", "topic", "target", "displaces")


class FeedTable:
    """The narrow columns of a feed, by batch. Repeats and order need no state here: they are settled by seq when the table is read, so
    batches may come late, in any order, and again after a failure (a batch replaces its own files)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(*COLUMNS).write.mode("overwrite").parquet(f"{self.folder}/feed/batch={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/feed").drop("batch")

    def current(self) -> DataFrame:
        """What current_entries says of all that has come so far."""
        return current_entries(self.rows())


def follow(spark: SparkSession, source: DataFrame, folder: str) -> FeedTable:
    """Run a streaming source of feed rows into the table until it has no more, and stop."""
    table = FeedTable(spark, folder)
    query = source.writeStream.foreachBatch(table.advance).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return table
