"""Search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.markers import cards_page
from ..sources import files
from ..sources.adapter import listings
from ..sources.staging import shared_folder
from .oracle import LISTINGS

COLUMNS = ["id", "price", "size_m2", "city", "source"]
VISIBLE = "is_active AND is_canonical"


def page(filters=None, **options):
    return lambda spark, sf: S.search(listings(spark, sf), filters, **options).select(*COLUMNS)


def found(filters, include_inactive=False):
    return lambda spark, sf: S.matching(listings(spark, sf), filters, include_inactive).select("id")


def sorted_sql(order, offset=0, where="TRUE", limit=20):
    return f"{LISTINGS} SELECT {', '.join(COLUMNS)} FROM listings WHERE {VISIBLE} AND {where} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"


def found_sql(where, visible=VISIBLE):
    return f"{LISTINGS} SELECT id FROM listings WHERE {visible} AND {where}"


def stored(spark, sf):
    """The listings as a snapshot of their own, ordered by place."""
    folder = f"{shared_folder(spark)}/listings-{uuid.uuid4().hex}"
    files.write_snapshot(listings(spark, sf), folder, area=AREA)
    return files.snapshot(spark, folder)


#: South, west, north, east of the places that occur.
AREA = (48.5, 12.0, 51.1, 18.9)

BOX = {"sw_lat": 49.0, "sw_lng": 13.0, "ne_lat": 50.0, "ne_lng": 15.5}
BOX_SQL = "latitude BETWEEN 49.0 AND 50.0 AND longitude BETWEEN 13.0 AND 15.5"

QUERIES = {
    "search_default": (page({"transaction_type": "sale", "region": "EUROPE"}), sorted_sql("listed_at DESC NULLS FIRST", where="transaction_type = 'sale' AND region = 'EUROPE'")),
    "search_page_2": (page({"transaction_type": "sale", "region": "EUROPE"}, page=2), sorted_sql("listed_at DESC NULLS FIRST", 20, "transaction_type = 'sale' AND region = 'EUROPE'")),
    "search_price_asc": (page({}, sort="price_asc"), sorted_sql("price ASC NULLS LAST")),
    "search_price_desc": (page({}, sort="price_desc", per_page=500), sorted_sql("price DESC NULLS FIRST", limit=100)),
    "search_size_asc": (page({"property_type": "flat,house"}, sort="size_asc", page=3), sorted_sql("size_m2 ASC NULLS LAST", 40, "property_type IN ('flat', 'house')")),
    "search_size_desc": (page({}, sort="size_desc"), sorted_sql("size_m2 DESC NULLS FIRST")),
    "filter_multi_value": (found({"property_type": "flat,house", "layout": "2+kk,3+1", "source": "low"}), found_sql("property_type IN ('flat', 'house') AND layout IN ('2+kk', '3+1') AND source = 'low'")),
    "filter_untrimmed_value": (found({"transaction_type": "rent, sale"}), found_sql("transaction_type IN ('rent', ' sale')")),
    "filter_empty_value": (found({"city": ",", "condition": "new"}), found_sql("condition = 'new'")),
    "filter_price_range": (found({"price_min": "20000", "price_max": 40000}), found_sql("price BETWEEN 20000 AND 40000")),
    "filter_size_range": (found({"size_min": 50, "size_max": "80.5", "price_min": "x"}), found_sql("size_m2 BETWEEN 50 AND 80.5")),
    "filter_amenities_ilike": (found({"amenities": "Barrier_free, lift"}), found_sql("amenities ILIKE '%barrier_free%' AND amenities ILIKE '%lift%'")),
    "filter_location_prefix": (found({"location": " nation_1 "}), found_sql("(city = 'nation_1' OR district = 'nation_1' OR region = 'nation_1' OR city ILIKE 'nation_1%' OR district ILIKE 'nation_1%')")),
    "filter_location_v1_contains": (lambda spark, sf: listings(spark, sf).where(S.location_anywhere("ation_2")).select("id"), found_sql("(city ILIKE '%ation_2%' OR district ILIKE '%ation_2%' OR region ILIKE '%ation_2%' OR address ILIKE '%ation_2%')", "TRUE")),
    "filter_has_thumbnail": (found({"has_thumbnail": "true"}), found_sql("thumbnail_url LIKE 'http%'")),
    "filter_bbox": (found(BOX), found_sql(BOX_SQL)),
    "filter_bbox_overrides_location": (found({**BOX, "location": "NATION_3"}), found_sql(BOX_SQL)),
    "filter_incomplete_bbox": (found({"sw_lat": 49.0, "location": "NATION_3"}), found_sql("(city = 'NATION_3' OR district = 'NATION_3' OR region = 'NATION_3' OR city ILIKE 'NATION_3%' OR district ILIKE 'NATION_3%')")),
    "filter_include_inactive": (found({"city": "NATION_4"}, True), found_sql("city = 'NATION_4'", "TRUE")),
    "filter_combined": (found({**BOX, "price_max": 60000, "furnishing": "furnished,partially", "energy_rating": "A,B,G", "ownership": "personal", "construction": "brick,wood"}), found_sql(f"{BOX_SQL} AND price <= 60000 AND furnishing IN ('furnished', 'partially') AND energy_rating IN ('A', 'B', 'G') AND ownership = 'personal' AND construction IN ('brick', 'wood')")),
    "snapshot_box": (lambda spark, sf: S.matching(stored(spark, sf), BOX).select("id", "latitude", "longitude"), f"{LISTINGS} SELECT id, latitude, longitude FROM listings WHERE {VISIBLE} AND {BOX_SQL}"),
    "snapshot_counts": (lambda spark, sf: stored(spark, sf).groupBy("source", F.col("latitude").isNotNull().alias("placed")).agg(F.count("*").alias("n")), f"{LISTINGS} SELECT source, latitude IS NOT NULL AS placed, count(*) AS n FROM listings GROUP BY 1, 2"),
    "search_capped_count": (lambda spark, sf: S.capped_count(listings(spark, sf), {"transaction_type": "sale"}, 500), f"{LISTINGS} SELECT count(*) AS total FROM (SELECT 1 FROM listings WHERE {VISIBLE} AND transaction_type = 'sale' LIMIT 500)"),
    "search_total_pages": (lambda spark, sf: S.total_pages(S.capped_count(listings(spark, sf), {})), f"{LISTINGS} SELECT total, greatest(1, ceil(total / 20.0))::BIGINT AS total_pages FROM (SELECT count(*) AS total FROM (SELECT 1 FROM listings WHERE {VISIBLE} LIMIT 100000))"),
    "marker_cards_page": (lambda spark, sf: cards_page(listings(spark, sf)).select("id", "title", "address", "price"), f"{LISTINGS} SELECT id, title, coalesce(address, city) AS address, price FROM listings WHERE is_active AND latitude IS NOT NULL ORDER BY price DESC NULLS LAST, id LIMIT 20"),
    "listing_defaults": (lambda spark, sf: S.with_defaults(listings(spark, sf)).selectExpr("id", "currency", "size(image_urls) AS images", "is_active"), f"{LISTINGS} SELECT id, currency, n_images AS images, is_active FROM listings"),
    "marker_preview": (lambda spark, sf: S.preview(listings(spark, sf), [1, 2, 3, 5, 8, 13]), f"{LISTINGS} SELECT id, title, thumbnail_url FROM listings WHERE id IN (1, 2, 3, 5, 8, 13)"),
}
