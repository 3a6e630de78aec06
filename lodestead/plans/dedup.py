"""Duplicate clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import cluster_key
from ..operators import dedup as D
from ..sources.adapter import listings
from .oracle import LISTINGS

EFFECTIVE = "coalesce(match_hash, match_hash_no_price)"
ACTIVE = "FROM listings WHERE is_active AND cluster_id IS NOT NULL"
GROUPS = f"g AS (SELECT {EFFECTIVE} AS h, min(id) AS first, count(*) AS n FROM listings WHERE is_active AND {EFFECTIVE} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


def over(operator, *columns, **options):
    def run(spark, sf):
        found = operator(listings(spark, sf), **options)
        return found.select(*columns) if columns else found

    return run


def twice(spark, sf):
    """What a second incremental pass adds to the first: nothing."""
    once = listings(spark, sf)
    once = D.assigned(once, D.incremental(once))
    return D.incremental(once).agg(F.count("*").alias("added"))


QUERIES = {
    "dedup_match_hash": (lambda spark, sf: D.hashed(listings(spark, sf)).select("id", "match_hash", "match_hash_no_price"), f"{LISTINGS} SELECT id, match_hash, match_hash_no_price FROM listings"),
    "dedup_full_clusters": (over(D.full), f"{LISTINGS}, {GROUPS} SELECT id, h AS cluster_id, coalesce(id = first, TRUE) AS is_canonical FROM listings LEFT JOIN g ON is_active AND h = {EFFECTIVE}"),
    "dedup_dry_run_counts": (over(D.full_counts), f"{LISTINGS}, {GROUPS} SELECT coalesce(sum(n), 0)::BIGINT AS clustered, count(*) AS clusters FROM g"),
    "dedup_incremental": (over(D.incremental), f"""{LISTINGS}, g AS (SELECT {EFFECTIVE} AS h, bool_or(cluster_id IS NOT NULL) AS existing, min(id) FILTER (WHERE cluster_id IS NULL) AS first FROM listings WHERE is_active AND {EFFECTIVE} IS NOT NULL GROUP BY 1
 HAVING count(*) FILTER (WHERE cluster_id IS NULL) > 0 AND (bool_or(cluster_id IS NOT NULL) OR count(*) FILTER (WHERE cluster_id IS NULL) >= 2))
SELECT id, h AS cluster_id, (NOT existing AND id = first) AS is_canonical, existing AS existing_cluster FROM listings JOIN g ON h = {EFFECTIVE} WHERE is_active AND cluster_id IS NULL"""),
    "dedup_incremental_idempotent": (twice, "SELECT 0::BIGINT AS added"),
    "dedup_cluster_key": (lambda spark, sf: listings(spark, sf).select("id", cluster_key().alias("key")), f"{LISTINGS} SELECT id, coalesce('cluster:' || cluster_id, 'singleton:' || id) AS key FROM listings"),
    "dedup_no_price_preview": (over(D.no_price_preview), f"{LISTINGS}, g AS (SELECT match_hash_no_price, count(*) AS n, count(DISTINCT source) AS s FROM listings WHERE is_active AND match_hash_no_price IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, sum(n)::BIGINT AS members, sum(n - 1)::BIGINT AS hidden, count(*) FILTER (WHERE s > 1) AS cross_source, max(n) AS largest FROM g"),
    "dedup_largest_would_be": (over(D.largest_would_be), f"{LISTINGS} SELECT min(id) AS first_id, count(*) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, array_to_string((array_agg(title ORDER BY id))[1:5], ' / ') AS titles FROM listings WHERE is_active AND match_hash_no_price IS NOT NULL GROUP BY match_hash_no_price HAVING count(*) > 1 ORDER BY n DESC, first_id LIMIT 15"),
    "dedup_totals": (over(D.totals), f"{LISTINGS} SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_active AND cluster_id IS NOT NULL) AS clustered, count(*) FILTER (WHERE is_active AND is_canonical) AS canonical, count(DISTINCT cluster_id) FILTER (WHERE is_active) AS clusters FROM listings"),
    "dedup_size_histogram": (over(D.size_histogram), f"{LISTINGS} SELECT n AS cluster_size, count(*) AS clusters FROM (SELECT count(*) AS n {ACTIVE} GROUP BY cluster_id) GROUP BY 1"),
    "dedup_source_span": (over(D.source_span), f"{LISTINGS} SELECT n AS sources, count(*) AS clusters FROM (SELECT count(DISTINCT source) AS n {ACTIVE} GROUP BY cluster_id) GROUP BY 1"),
    "dedup_biggest": (over(D.biggest), f"{LISTINGS} SELECT cluster_id, count(*) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, min(price) AS price_min, max(price) AS price_max {ACTIVE} GROUP BY cluster_id ORDER BY n DESC, cluster_id LIMIT 10"),
    "dedup_recent_cross_source": (over(D.recent_cross_source), f"{LISTINGS} SELECT cluster_id, max(id) AS newest, count(DISTINCT source) AS sources {ACTIVE} GROUP BY cluster_id HAVING count(DISTINCT source) >= 2 ORDER BY newest DESC LIMIT 3"),
    "dedup_hash_peers_window": (over(D.hash_peers), f"{LISTINGS} SELECT id, count(*) OVER (PARTITION BY match_hash) AS peers, min(id) OVER (PARTITION BY match_hash) AS oldest FROM listings WHERE is_active AND match_hash IS NOT NULL"),
    "dedup_exists_probe": (over(D.existing_cluster_probe), f"{LISTINGS} SELECT id FROM listings a WHERE is_active AND cluster_id IS NULL AND EXISTS (SELECT 1 FROM listings b WHERE b.is_active AND b.cluster_id IS NOT NULL AND coalesce(b.match_hash, b.match_hash_no_price) = coalesce(a.match_hash, a.match_hash_no_price))"),
    "dedup_joined_existing": (lambda spark, sf: D.joined_existing(D.incremental(listings(spark, sf))), f"""{LISTINGS}, g AS (SELECT {EFFECTIVE} AS h, bool_or(cluster_id IS NOT NULL) AS existing, count(*) FILTER (WHERE cluster_id IS NULL) AS n FROM listings WHERE is_active AND {EFFECTIVE} IS NOT NULL GROUP BY 1)
SELECT coalesce(sum(n), 0)::BIGINT AS clustered, count(*) AS clusters, coalesce(sum(n) FILTER (WHERE existing), 0)::BIGINT AS joined_existing FROM g WHERE n > 0 AND (existing OR n >= 2)"""),
    "cluster_canonical_first": (over(D.canonical_first), f"{LISTINGS} SELECT cluster_id, id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY is_canonical DESC, price ASC NULLS LAST, id) AS INTEGER) AS position {ACTIVE}"),
    "cluster_siblings": (over(D.siblings), f"""{LISTINGS}, p AS (SELECT a.id AS listing_id, b.id, b.source, b.price, row_number() OVER (PARTITION BY a.id, b.source ORDER BY b.scraped_at DESC NULLS LAST, b.id) AS k FROM listings a JOIN listings b ON a.cluster_id = b.cluster_id AND a.id <> b.id WHERE a.is_active AND b.is_active)
SELECT listing_id, id, source, price, CAST(row_number() OVER (PARTITION BY listing_id ORDER BY price ASC NULLS LAST, id) AS INTEGER) AS position FROM p WHERE k = 1"""),
    "cluster_cheapest_per_source": (over(D.newest_per_source), f"{LISTINGS} SELECT cluster_id, source, id, price FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, source ORDER BY scraped_at DESC NULLS LAST, id) AS k {ACTIVE}) WHERE k = 1"),
    "cluster_price_spread": (over(D.price_spread), f"{LISTINGS} SELECT cluster_id, min(price) AS price_min, max(price) AS price_max, coalesce(min(price) <> max(price), FALSE) AS vary {ACTIVE} GROUP BY cluster_id"),
}
