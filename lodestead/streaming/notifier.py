"""Notifications of stored searches, batch by batch, with two tables that change together.

The audit rows and the bumps of a batch are written under the batch's number, and a mark makes both count. A batch that
fails between the two writes, or before its mark, is tried again as a whole: it overwrites its own and is marked once.
Messages go out before the mark, so that a failure repeats a message rather than losing one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cells

AUDIT = "email_canonical string, cluster_key string"
BUMPS = "watchdog_id long, notified_at timestamp_ntz"


class Log:
    """The two tables below a folder, as of the marked batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def marked(self) -> list[int]:
        path = self.fs_path(f"{self.folder}/marks")
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def mark(self, number: int) -> None:
        self.fs.create(self.fs_path(f"{self.folder}/marks/{number}"), True).close()

    def table(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        paths = [f"{self.folder}/{name}/{n}" for n in self.marked() if before is None or n < before]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def audit(self, before: int | None = None) -> DataFrame:
        return self.table("audit", AUDIT, before)

    def bumps(self, before: int | None = None) -> DataFrame:
        return self.table("bumps", BUMPS, before)


def bumped(watchdogs: DataFrame, bumps: DataFrame) -> DataFrame:
    """The searches with the last time that something was sent for them."""
    last = bumps.groupBy(F.col("watchdog_id").alias("id")).agg(F.max("notified_at").alias("_last"))
    return watchdogs.join(last, "id", "left").withColumn("last_notified_at", F.greatest("last_notified_at", "_last")).drop("_last")


def notify(log: Log, number: int, listings: DataFrame, watchdogs: DataFrame, sent: DataFrame, now: Column, send: Callable[[DataFrame], None] | None = None) -> None:
    """One batch: what its listings mean to the searches as they stand, sent, written and marked. ``sent`` is the audit of old."""
    if number in log.marked():
        return
    audit = sent.select("email_canonical", "cluster_key").unionByName(log.audit(number)).distinct()
    shown = cells.first(listings, bumped(watchdogs, log.bumps(number)), audit)
    path = f"{log.folder}/messages/{number}"
    shown.write.mode("overwrite").parquet(path)
    messages = log.spark.read.schema(shown.schema).parquet(path)
    if send:
        send(messages)
    messages.select("email_canonical", "cluster_key").distinct().write.mode("overwrite").parquet(f"{log.folder}/audit/{number}")
    messages.select("watchdog_id").distinct().withColumn("notified_at", now).write.mode("overwrite").parquet(f"{log.folder}/bumps/{number}")
    log.mark(number)


def start(spark: SparkSession, landing: str, folder: str, checkpoint: str, schema, watchdogs: DataFrame, sent: DataFrame, now: Callable[[int], Column], send: Callable[[DataFrame], None] | None = None, files: int | None = 1) -> StreamingQuery:
    """Notify of what has landed and stop. ``now`` gives a batch's time, so that a batch that is tried again has its own."""
    log = Log(spark, folder)
    reader = spark.readStream.schema(schema)
    landed = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)
    return landed.writeStream.foreachBatch(lambda batch, number: notify(log, number, batch, watchdogs, sent, now(number), send)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
