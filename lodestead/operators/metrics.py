"""Run logs, latencies, request windows, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean and the 95th percentile as the value at place floor(0.95 n) - 1, from 0, by ranks instead of a sort in memory."""
    ranked = rows.groupBy(*by, value).count().withColumn("upto", F.sum("count").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    totals = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    place = F.greatest(F.lit(0), F.floor(F.col("n") * 0.95) - 1)
    return ranked.join(totals, list(by)).where(F.col("upto") > place).groupBy(*by, "n", "mean").agg(F.min(value).alias("p95"))


def effective_rate(rows: DataFrame, *by: str) -> DataFrame:
    """Successes a second of wall-clock time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / 1_000_000
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("event_type") != "error").cast("double"), seconds), 9).alias("per_second"))


def rates(counts: DataFrame, names: list[str]) -> DataFrame:
    """Shares of the buckets, by source."""
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select("source", *[F.round(F.try_divide(F.col(n).cast("double"), total), 6).alias(f"{n}_rate") for n in names])


def run_counters(rows: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return rows.groupBy("user_id").agg(F.count_if(kind == "view").alias("new_count"), F.count_if(kind == "click").alias("updated_count"), F.count_if(kind == "error").alias("error_count"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"))


def high_errors(counters: DataFrame) -> DataFrame:
    return counters.where("error_count > new_count AND error_count > 10")


def dashboard(rows: DataFrame) -> DataFrame:
    """The last total of every category, summed by source."""
    last = rows.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("total"))
    return last.groupBy("user_id").agg(F.round(F.sum("total"), 4).alias("total"), F.count("*").alias("categories"))


def buckets(rows: DataFrame, verdict: Column, names: list[str]) -> DataFrame:
    """Counts by source and verdict."""
    counted = rows.withColumn("verdict", verdict).groupBy("source").pivot("verdict", names).count()
    return counted.select("source", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def tumbling(rows: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Per key and fixed window: requests and how many are over the limit."""
    start = (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 / seconds) * seconds).alias("window_start")
    return rows.groupBy("user_id", start).agg(F.count("*").alias("n"), F.greatest(F.count("*") - limit, F.lit(0)).alias("refused"))


def restarting(rows: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Per key, windows that open with the first request after the last one expired; what is refused counts too.

    A window depends on the one before it only while requests follow each other without a pause as long as a window; so
    each key falls into stretches between pauses, and each stretch is walked by itself.
    """
    timed = rows.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("moment"))
    order = Window.partitionBy("user_id").orderBy("moment")
    pause = F.when(F.col("moment") - F.lag("moment").over(order) > seconds * 1_000_000, 1).otherwise(0)
    stretches = timed.withColumn("pause", pause).withColumn("stretch", F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    keyed = stretches.groupBy("user_id", "stretch").agg(F.array_sort(F.collect_list("moment")).alias("at"))
    zero = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("refused"), F.lit(0).cast("long").alias("windows"))

    def step(s: Column, t: Column) -> Column:
        new = (s.start < 0) | (t > s.start + seconds * 1_000_000)
        n = F.when(new, F.lit(1).cast("long")).otherwise(s.n + 1)
        return F.struct(F.when(new, t).otherwise(s.start).alias("start"), n.alias("n"), (s.refused + F.when(n > limit, 1).otherwise(0)).alias("refused"), (s.windows + F.when(new, 1).otherwise(0)).alias("windows"))

    walked = keyed.select("user_id", F.aggregate("at", zero, step).alias("s"))
    return walked.groupBy("user_id").agg(F.sum("s.windows").alias("windows"), F.sum("s.refused").alias("refused"))


def shuffled(seed: str, id_: str = "id") -> Column:
    """A pseudorandom order that depends on the row and a seed alone."""
    return F.md5(F.concat(F.col(id_).cast("string"), F.lit(seed)).cast("binary"))


def stratified(rows: DataFrame, by: str, n: int, seed: str) -> DataFrame:
    ranked = rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(shuffled(seed), "id")))
    return ranked.where(F.col("position") <= n).select(by, "id", "position")


def sample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    return rows.orderBy(shuffled(seed), "id").limit(n)


def sample_blocks(rows: DataFrame, share: float, seed: int) -> DataFrame:
    return rows.sample(share, seed)


def file_blocks(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """A share of the blocks that a table's files are read in, each with all its rows: what a block holds is not looked at.

    ``rows`` are read from files. A block is in or out by its file's name, its start and the seed, so a seed gives the same
    blocks as long as files are read in blocks of one size.
    """
    name, start = F.col("_metadata.file_name"), F.col("_metadata.file_block_start")
    return rows.where(F.pmod(F.xxhash64(name, start, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
