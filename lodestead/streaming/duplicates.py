"""Duplicates across time: a stream of new listings, clustered as they arrive, with state by match hash.

What a hash's state holds is one small row, whatever the number of its listings: whether it is a cluster, the one listing that
waits for a second, when the hash was last seen and for how long its quiet was told. A batch aggregates its listings by hash,
joins them with the state of the batch before and writes the state that follows. A hash that was quiet for the last of
``HORIZONS`` is not carried on, so that the state is bounded by the hashes seen within that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import effective_hash

#: Days without a listing after which a hash is given up, can no longer come back, and is forgotten.
HORIZONS = (3, 7, 14)
DAY_MS = 86_400_000
#: By hash; ``told``: the days without a listing that were told last. The rest is what the batch found: whether it brought
#: listings, whether the hash was a cluster before, which listing waited, the least of it and the batch's, and what had been told.
STATE = "effective_hash string, formed boolean, waiting long, seen long, told int, brought boolean, existing boolean, waited long, least long, was_told int"
#: kind: ``member`` (a listing joins or forms a cluster) or ``quiet`` (``days`` without a listing).
OUT = "kind string, id long, cluster_id string, is_canonical boolean, existing_cluster boolean, days int"


def followed(state: DataFrame, rows: DataFrame, watermark: Column, horizons: tuple[int, ...]) -> DataFrame:
    """The state after a batch's rows (effective_hash, id, seen_ms), with the hashes that are forgotten at the watermark (ms)."""
    fresh = rows.groupBy("effective_hash").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.max("seen_ms").alias("last"))
    old = state.where(F.col("told") < horizons[-1]).select("effective_hash", F.col("formed").alias("existing"), F.col("waiting").alias("waited"), F.col("seen").alias("since"), F.col("told").alias("was_told"))
    both = old.join(fresh, "effective_hash", "full").withColumns({
        "existing": F.coalesce("existing", F.lit(False)), "brought": F.col("least").isNotNull(), "seen": F.greatest("since", "last"),
        "was_told": F.when(F.col("least").isNull(), F.col("was_told")).otherwise(0),
        "least": F.least("waited", "least"), "most": F.greatest("waited", "most"),
    })
    # The least listing so far is held back: it is the canonical one of a cluster that forms.
    formed = F.col("existing") | (F.col("least") < F.col("most"))
    told = F.greatest("was_told", *[F.when(F.col("seen") + days * DAY_MS <= watermark, days) for days in horizons])
    return both.withColumns({"formed": formed, "waiting": F.when(~formed, F.col("least")), "told": told}).select(*[c.split()[0] for c in STATE.split(", ")])


def found(after: DataFrame, rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """What a batch tells: the members of clusters that it forms or adds to, and quiet hashes."""
    grown = after.where("brought AND formed")
    waited = grown.where("NOT existing AND waited IS NOT NULL").select("effective_hash", F.col("waited").alias("id"))
    ids = rows.select("effective_hash", "id").unionByName(waited).join(grown.select("effective_hash", "existing", "least"), "effective_hash").distinct()
    first = ~F.col("existing") & (F.col("id") == F.col("least"))
    members = ids.select(F.lit("member").alias("kind"), "id", F.col("effective_hash").alias("cluster_id"), first.alias("is_canonical"), F.col("existing").alias("existing_cluster"), F.lit(None).cast("int").alias("days"))
    days = F.filter(F.array(*map(F.lit, horizons)), lambda d: (d > F.col("was_told")) & (d <= F.col("told")))
    nothing = lambda kind: F.lit(None).cast(kind)
    quiet = after.where("told > was_told").select(F.lit("quiet").alias("kind"), nothing("long").alias("id"), F.col("effective_hash").alias("cluster_id"), nothing("boolean").alias("is_canonical"), nothing("boolean").alias("existing_cluster"), F.explode(days).alias("days"))
    return members.unionByName(quiet)


def start(spark: SparkSession, landing: str, folder: str, checkpoint: str, schema: str, horizons: tuple[int, ...] = HORIZONS, late: str = "0 seconds", files: int | None = 1) -> StreamingQuery:
    """Cluster what has landed and stop; the results of a batch stand under its number, so a batch that is tried again overwrites its own.

    The stream brings each listing once; ``scraped_at`` is its event time. The watermark is the latest time of all listings so
    far less ``late``: rows not after that of the batch before are dropped, rows
    without a time count as seen at the batch's own, which decides when a hash is quiet.
    States stand in the checkpoint under the number of the batch that starts from them; older ones are deleted.
    """
    horizons = tuple(sorted(horizons))
    path = lambda name, number: f"{checkpoint}/{name}/{number}"

    def cycle(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state, before = session.createDataFrame([], STATE), None
        if number:
            state = session.read.schema(STATE).parquet(path("hashes", number))
            before = session.read.parquet(path("watermarks", number)).first()[0]
        landed = batch.withColumn("seen", F.col("scraped_at").cast("timestamp"))
        latest = landed.agg(F.unix_millis(F.max("seen") - F.lit(late).cast("interval"))).first()[0]
        watermark = max((x for x in (before, latest) if x is not None), default=None)
        late_ones = F.coalesce(F.unix_millis("seen") <= F.lit(before).cast("long"), F.lit(False))
        seen = F.coalesce(F.unix_millis("seen"), F.lit(watermark).cast("long"))
        rows = landed.where("is_active").where(~late_ones).select(effective_hash().alias("effective_hash"), "id", seen.alias("seen_ms")).where("effective_hash IS NOT NULL").persist()
        try:
            followed(state, rows, F.lit(watermark).cast("long"), horizons).write.mode("overwrite").parquet(path("hashes", number + 1))
            session.createDataFrame([(watermark,)], "watermark long").write.mode("overwrite").parquet(path("watermarks", number + 1))
            after = session.read.schema(STATE).parquet(path("hashes", number + 1))
            found(after, rows, horizons).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            rows.unpersist()
        for name in ("hashes", "watermarks"):  # the batch before is committed
            old = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path(name, number - 1))
            old.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    reader = spark.readStream.schema(schema)
    landed = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(landing)
    return landed.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
