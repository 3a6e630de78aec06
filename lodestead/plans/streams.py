"""Streams that land in batches, each started anew from its checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.adapter import listings, notifications, watchdogs
from ..sources.staging import shared_folder
from ..streaming import duplicates, ingest, notifier
from .oracle import LISTINGS
from .watchdogs import BASE, MATCH, NEW


def _finished(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _now(number: int):
    return F.lit("2001-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(number))


def clusters(spark, sf):
    """Active listings in three batches; the state of hashes goes on from one to the next."""
    folder = f"{shared_folder(spark)}/duplicates-{uuid.uuid4().hex}"
    rows = listings(spark, sf).select("id", "is_active", "transaction_type", "latitude", "longitude", "size_m2", "price", "scraped_at")
    for k in range(3):
        rows.where(F.col("id") % 3 == k).write.mode("append").parquet(folder + "/landing")
        _finished(duplicates.start(spark, folder + "/landing", folder + "/out", folder + "/progress", rows.schema, (20_000,), "9000 days", None))
    found = spark.read.option("basePath", folder + "/out").parquet(folder + "/out").where("kind = 'member'")
    return found.select("id", "cluster_id", "is_canonical", "existing_cluster")


def told(spark, sf):
    """The audit after two batches of listings."""
    folder = f"{shared_folder(spark)}/notifier-{uuid.uuid4().hex}"
    rows = listings(spark, sf)
    for k in range(2):
        rows.where(F.col("id") % 2 == k).write.mode("append").parquet(folder + "/landing")
        _finished(notifier.start(spark, folder + "/landing", folder + "/log", folder + "/progress", rows.schema, watchdogs(spark, sf), notifications(spark, sf), _now, files=None))
    return notifier.Log(spark, folder + "/log").audit()


def watched(spark, sf):
    """Two sources that land new prices, in one loop with the sweep of old listings."""
    folder = f"{shared_folder(spark)}/watch-{uuid.uuid4().hex}"
    rows = listings(spark, sf)
    rows.write.parquet(ingest.snapshot(folder + "/state", 0))
    seen = rows.withColumns({"price": F.col("price") + 5, "scraped_at": F.lit("2001-08-30 00:00:00").cast("timestamp_ntz")})
    for source in ("low", "high"):
        seen.where(F.col("source") == source).write.parquet(f"{folder}/landing/{source}")
    ingest.watch(spark, folder + "/landing", {"low": 1000, "high": 1000}, folder + "/state", folder + "/progress", rows.schema, _now, (L.expire,))
    return spark.read.parquet(ingest.snapshot(folder + "/state", 1)).select("external_id", "price", "is_active", "deactivation_reason")


QUERIES = {
    "stream_duplicates": (clusters, f"""{LISTINGS}, e AS (SELECT id, coalesce(match_hash, match_hash_no_price) AS h, id % 3 AS b FROM listings WHERE is_active AND coalesce(match_hash, match_hash_no_price) IS NOT NULL),
 c AS (SELECT h, b, count(*) AS n, min(id) AS least FROM e GROUP BY 1, 2), r AS (SELECT h, b, sum(n) OVER (PARTITION BY h ORDER BY b) AS upto, min(least) OVER (PARTITION BY h ORDER BY b) AS first FROM c),
 f AS (SELECT h, min(b) AS formed, min_by(first, b) AS first FROM r WHERE upto >= 2 GROUP BY h) SELECT id, h AS cluster_id, id = first AS is_canonical, b > formed AS existing_cluster FROM e JOIN f USING (h)"""),
    "stream_notifier": (told, f"""{BASE}, {MATCH}, {NEW}, k AS (SELECT *, row_number() OVER (PARTITION BY watchdog_id, id % 2 ORDER BY created_at DESC NULLS FIRST, id) AS k, min(id % 2) OVER (PARTITION BY watchdog_id) AS first FROM n)
 SELECT DISTINCT email_canonical, cluster_key FROM k WHERE k <= 10 AND id % 2 = first"""),
    "stream_sources": (watched, f"{LISTINGS} SELECT external_id, CASE WHEN source IN ('low', 'high') THEN price + 5 ELSE price END AS price, source IN ('low', 'high') OR is_active AND scraped_at > TIMESTAMP '2001-08-18' AS is_active, CASE WHEN source NOT IN ('low', 'high') AND is_active AND scraped_at <= TIMESTAMP '2001-08-18' THEN 'ttl' ELSE deactivation_reason END AS deactivation_reason FROM listings"),
}
