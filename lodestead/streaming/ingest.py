"""Continuous ingest: micro-batches of landed listings become snapshots, each deduplicated as it arrives.

Several sources are one loop: their streams are united, each at its own rate, and a cycle takes in what they bring, clusters
it and sweeps. A cycle's snapshot has the cycle's number and depends on the one before alone, so a loop that stops at its
deadline, or fails in mid-cycle, goes on from its checkpoint to the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import assigned, incremental
from ..operators.lifecycle import KEY, keyed_upsert, last_of_batch
from ..sources.schemas import LISTING


def apply(listings: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """One cycle: last write of the batch, upsert, incremental clusters. A batch that comes twice changes nothing more."""
    state = keyed_upsert(listings, last_of_batch(batch) if "arrival" in batch.columns else batch, now)
    return assigned(state, incremental(state, KEY), KEY).drop(KEY)


def snapshot(folder: str, version: int) -> str:
    return f"{folder}/v{version}"


def start(spark: SparkSession, landing: str, folder: str, checkpoint: str, now: Column, schema: str = LISTING, files: int | None = 1) -> StreamingQuery:
    """Process what has landed and stop; versions are numbered by batch, so a batch that is tried again overwrites its own.

    A batch takes so many landed files, or all there are (None).
    """

    def cycle(batch: DataFrame, number: int) -> None:
        old = batch.sparkSession.read.parquet(snapshot(folder, number))
        apply(old, batch, now).write.mode("overwrite").parquet(snapshot(folder, number + 1))

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)
    return stream.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Sweep = Callable[[DataFrame, Column], DataFrame]


def united(spark: SparkSession, landing: str, rates: dict[str, int], schema) -> DataFrame:
    """The streams of the sources below ``landing``, a folder each; ``rates`` are landed files a cycle."""
    each = [spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(f"{landing}/{source}") for source, n in sorted(rates.items())]
    return reduce(DataFrame.unionByName, each)


def watch(spark: SparkSession, landing: str, rates: dict[str, int], folder: str, checkpoint: str, schema, now: Callable[[int], Column], sweeps: tuple[Sweep, ...] = (), deadline: float | None = None, period: str | None = None) -> bool:
    """Run cycles over all sources until nothing new has landed or the deadline (seconds) is over; whether all was taken in.

    ``now`` gives a cycle's time, ``sweeps`` are (state, now) -> state, run in order after the clusters. With ``period`` cycles
    start that often and the loop goes on until its deadline.
    """

    def cycle(batch: DataFrame, number: int) -> None:
        at = now(number)
        state = apply(batch.sparkSession.read.parquet(snapshot(folder, number)), batch, at)
        reduce(lambda rows, sweep: sweep(rows, at), sweeps, state).write.mode("overwrite").parquet(snapshot(folder, number + 1))

    writer = united(spark, landing, rates, schema).writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()
    try:
        return query.awaitTermination(deadline) if deadline is not None else query.awaitTermination() is None
    finally:
        query.stop()


def idempotent_keys(stream: DataFrame, keys: list[str], moment: str, delay: str) -> DataFrame:
    """A stream whose repeated keys pass once within the delay; older state is dropped."""
    return stream.withWatermark(moment, delay).dropDuplicatesWithinWatermark(keys)
