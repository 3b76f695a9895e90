"""Watching files and events: listings compared trigger by trigger, and windows over event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.relational import snapshot_difference
from graphloom.session import commit_file, list_files, read_file_text


class Watcher:
    """Compares full listings: a file source reports new paths only, never edits or deletions.

    Each tick takes a listing (path, state), compares it with the committed one, hands the changes
    to the handler and then commits the new listing with a small file that names it. A tick that
    fails before that is simply done again from the old listing; of two watchers one wins a tick.
    """

    def __init__(self, spark: SparkSession, root: str, listing: Callable[[], DataFrame], handler: Callable[[DataFrame, int], None]):
        self.spark, self.root, self.listing, self.handler = spark, root.rstrip("/"), listing, handler

    def tick(self) -> int:
        """One comparison; the number of the committed listing."""
        done = [n for n in list_files(self.spark, f"{self.root}/commits") if n.endswith(".txt")]
        n = len(done)
        name = f"{self.root}/listing-{n}-{uuid.uuid4().hex}"
        self.listing().write.parquet(name)
        new = self.spark.read.parquet(name)
        old = self.spark.read.parquet(read_file_text(self.spark, f"{self.root}/commits/{done[-1]}")) if done else new.limit(0)
        self.handler(snapshot_difference(old, new, "path", "state"), n)
        try:
            commit_file(self.spark, f"{self.root}/commits/{n:08d}.txt", name)
        except FileExistsError as e:
            raise RuntimeError(f"listing {n} was committed by another watcher") from e
        return n

    def start(self, seconds: int = 1):
        """Ticks on a clock of one trigger at a time, so that ticks never overlap."""
        clock = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return clock.writeStream.foreachBatch(lambda _df, _id: self.tick()).trigger(processingTime=f"{seconds} seconds").start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, event_type, n, total over event time, batch or stream; late rows beyond the watermark go."""
    e = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and returns the sink's rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
