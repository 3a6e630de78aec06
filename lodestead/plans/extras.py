"""Title matches, follow-up lists, codes, point clusters, streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import grouped
from ..operators import matching as M
from ..operators import point_clusters as P
from ..operators.search import card
from ..sources.adapter import listings, now
from ..sources.staging import shared_folder
from ..streaming import ingest
from .lifecycle import incoming
from .oracle import LISTINGS


def titles(spark, sf):
    rows = listings(spark, sf)
    cards = rows.where("id % 2 = 0").groupBy("title").agg(F.min("id").alias("id"))
    offers = rows.where("id % 2 = 1").groupBy("title").agg(F.min("id").alias("id")).withColumn("title", F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" - novinka"))).otherwise(F.col("title")))
    return M.by_title(cards, offers)


def streamed(spark, sf):
    """The scan of ``lifecycle_upsert`` landed as files and taken in by the stream."""
    import uuid

    folder = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"
    rows = listings(spark, sf)
    rows.write.parquet(ingest.snapshot(folder + "/state", 0))
    # The scan is of the stored listings and lands with all its writes; the cycle deals it out once, for the last write of each and the upsert.
    scan = incoming(spark, sf, spark.read.parquet(ingest.snapshot(folder + "/state", 0)))
    scan.write.parquet(folder + "/landing")
    query = ingest.start(spark, folder + "/landing", folder + "/state", folder + "/progress", now(), scan.schema, None)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(ingest.snapshot(folder + "/state", 1)).select("external_id", "price", "is_active")


def codes(spark, sf):
    i = F.col("id")
    path = F.get(F.array(*map(F.lit, ["/prodej/byty/1", "/prodej/garaze/2", "/x", "/chaty/3"])), (i % 4).cast("int"))
    rows = listings(spark, sf)
    flags = M.amenity_flags(lift=i % 2 == 0, balcony=i % 3 == 0, parking=F.lit(None).cast("boolean"))
    params = M.leftover(F.create_map(F.lit("a"), i.cast("string"), F.lit("b"), F.lit("x")), ["b"])
    return rows.select("id", M.property_type(F.when(i % 5 != 0, i % 5), path).alias("kind"), F.array_join(flags, ",").alias("flags"), F.array_join(F.map_keys(params), ",").alias("left_over"))


#: South, west, north, east.
BOX = (49.0, 13.0, 50.5, 17.0)

QUERIES = {
    "card_title_match": (titles, f"""{LISTINGS}, c AS (SELECT title, min(id) AS id FROM listings WHERE id % 2 = 0 GROUP BY 1), o AS (SELECT CASE WHEN id % 3 = 0 THEN title || ' - novinka' ELSE title END AS title, id FROM (SELECT title, min(id) AS id FROM listings WHERE id % 2 = 1 GROUP BY 1)),
m AS (SELECT c.id AS card_id, o.id AS offer_id, CASE WHEN c.title = o.title THEN 0 ELSE 1 END AS rank FROM c JOIN o ON c.title = o.title OR starts_with(c.title, o.title) OR starts_with(o.title, c.title))
SELECT card_id, offer_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY rank, offer_id) AS k FROM m) WHERE k = 1"""),
    "ingest_needs_detail": (lambda spark, sf: M.needs_detail(incoming(spark, sf), listings(spark, sf)), f"{LISTINGS} SELECT external_id FROM listings WHERE id % 3 = 0 AND description IS NULL AND seller_name IS NULL UNION ALL SELECT 'new_' || id FROM listings WHERE id % 3 = 0"),
    "ingest_new_ids": (lambda spark, sf: M.new_since(listings(spark, sf), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), 20), f"{LISTINGS} SELECT id FROM listings WHERE created_at >= TIMESTAMP '2000-01-01' ORDER BY id DESC LIMIT 21"),
    "latest_with_images": (lambda spark, sf: M.latest_with_images(listings(spark, sf), listings(spark, sf).where("thumbnail_url IS NULL")), f"{LISTINGS} SELECT id FROM (SELECT * FROM listings WHERE is_active AND is_canonical ORDER BY listed_at DESC NULLS LAST, id LIMIT 28) WHERE thumbnail_url IS NOT NULL ORDER BY listed_at DESC NULLS LAST, id LIMIT 20"),
    "codes_and_flags": (codes, f"{LISTINGS} SELECT id, CASE id % 5 WHEN 1 THEN 'flat' WHEN 2 THEN 'house' WHEN 3 THEN 'land' WHEN 4 THEN 'commercial' ELSE (['flat', 'garage', 'other', 'cottage'])[id % 4 + 1] END AS kind, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'balcony' END, CASE WHEN id % 2 = 0 THEN 'lift' END) AS flags, 'a' AS left_over FROM listings"),
    "marker_cards": (lambda spark, sf: card(listings(spark, sf)).select("id", "address", grouped(F.col("price")).alias("price_shown")), f"{LISTINGS} SELECT id, coalesce(address, city) AS address, replace(format('{{:,}}', CAST(floor(price + 0.5) AS BIGINT)), ',', chr(160)) AS price_shown FROM listings"),
    "hierarchical_clusters_total": (lambda spark, sf: P.hierarchy(listings(spark, sf), 12).groupBy("zoom").agg(F.sum("cnt").alias("total")), f"{LISTINGS} SELECT CAST(z AS INTEGER) AS zoom, CAST(count(*) AS BIGINT) AS total FROM listings, range(13) r(z) WHERE is_active AND latitude IS NOT NULL GROUP BY z"),
    "hierarchical_clusters": (lambda spark, sf: P.hierarchy(listings(spark, sf)), None),
    "map_view_listings": (lambda spark, sf: P.shown(listings(spark, sf), BOX, 17), f"{LISTINGS} SELECT 'listing' AS kind, id, 1::BIGINT AS cnt, latitude, longitude FROM listings WHERE is_active AND latitude BETWEEN 49 AND 50.5 AND longitude BETWEEN 13 AND 17 ORDER BY id LIMIT 5000"),
    "map_view_few": (lambda spark, sf: P.shown(listings(spark, sf).where("source = 'high' AND id <= 160"), BOX, 5), f"{LISTINGS} SELECT 'listing' AS kind, id, 1::BIGINT AS cnt, latitude, longitude FROM listings WHERE is_active AND source = 'high' AND id <= 160 AND latitude BETWEEN 49 AND 50.5 AND longitude BETWEEN 13 AND 17"),
    "map_view_clusters": (lambda spark, sf: P.shown(listings(spark, sf).where("transaction_type = 'sale'"), BOX, 13), None),
    "stream_ingest_equals_batch": (streamed, f"{LISTINGS} SELECT external_id, price + CASE WHEN id % 6 = 0 THEN 2 WHEN id % 3 = 0 THEN 1 ELSE 0 END AS price, CASE WHEN id % 3 = 0 THEN TRUE ELSE is_active END AS is_active FROM listings UNION ALL SELECT 'new_' || id, price, TRUE FROM listings WHERE id % 3 = 0"),
}
