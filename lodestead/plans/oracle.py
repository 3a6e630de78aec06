"""The derived tables in DuckDB SQL, for the queries' checks."""

LISTINGS = """
WITH listings AS (SELECT *,
 CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL AND size_m2 IS NOT NULL AND price IS NOT NULL THEN md5('geo|' || transaction_type || '|' || CAST(CAST(latitude AS DECIMAL(18,12)) AS DECIMAL(18,4)) || '|' || CAST(CAST(longitude AS DECIMAL(18,12)) AS DECIMAL(18,4)) || '|' || CAST(CAST(size_m2 AS DECIMAL(30,12)) AS DECIMAL(18,2)) || '|' || CAST(CAST(price AS DECIMAL(30,12)) AS DECIMAL(18,0))) END AS match_hash,
 CASE WHEN price IS NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND size_m2 > 0 THEN md5('geo-np|' || transaction_type || '|' || CAST(CAST(latitude AS DECIMAL(18,12)) AS DECIMAL(18,4)) || '|' || CAST(CAST(longitude AS DECIMAL(18,12)) AS DECIMAL(18,4)) || '|' || CAST(CAST(size_m2 AS DECIMAL(30,12)) AS DECIMAL(18,2))) END AS match_hash_no_price
FROM (SELECT *, cid IS NULL OR i % 3 = 0 AS is_canonical, cid AS cluster_id, CASE deal WHEN 'sale' THEN 'prodej' WHEN 'rent' THEN 'pronájem' ELSE 'dražba' END || ' bytu ' || coalesce(layout, 'atypický') || ' ' || CAST(20 + c % 180 AS VARCHAR) || ' m²' AS title
FROM (SELECT o_orderkey AS i, o_custkey AS c, o_orderkey AS id, 'ext_' || o_orderkey AS external_id, lower(substr(o_orderpriority, 3, 20)) AS source,
 (['flat','house','land','commercial','garage','cottage','residential_building','other'])[o_custkey % 8 + 1] AS property_type,
 CASE o_orderstatus WHEN 'F' THEN 'sale' WHEN 'O' THEN 'rent' ELSE 'auction' END AS deal, deal AS transaction_type,
 CASE WHEN o_orderkey % 4 <> 1 THEN 'Nabídka ' || o_orderkey || '. Byt po rekonstrukci v klidné části obce! Cena dohodou.' END AS description,
 CASE WHEN o_custkey % 11 <> 0 THEN CAST(5000 + (o_custkey * 7919) % 95000 AS DOUBLE) END AS price,
 CASE WHEN o_custkey % 31 = 0 THEN 'EUR' ELSE 'CZK' END AS currency,
 CASE WHEN o_custkey % 9 <> 0 THEN n_name || ', okres ' || n_name END AS address, n_name AS city, n_name || ' ' || (o_custkey % 10) AS district, r_name AS region,
 CASE WHEN o_custkey % 17 <> 0 THEN CAST(48.55 AS DOUBLE) + CAST(o_custkey * 37 % 2500 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS latitude,
 CASE WHEN o_custkey % 17 <> 0 THEN CAST(12.1 AS DOUBLE) + CAST(o_custkey * 53 % 6700 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS longitude,
 CASE WHEN o_custkey % 19 <> 0 THEN CAST(20 + o_custkey % 180 AS DOUBLE) END AS size_m2,
 (['1+kk','1+1','2+kk','2+1','3+kk','3+1','4+kk','6+kk',NULL])[o_custkey % 9 + 1] AS layout,
 CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 12 AS INTEGER) END AS floor, CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_custkey % 12 + 1 AS INTEGER) END AS total_floors,
 (['new','good','very_good','after_reconstruction',NULL,'poor'])[o_custkey % 6 + 1] AS condition, (['brick','panel',NULL,'wood'])[o_custkey % 4 + 1] AS construction,
 (['personal','cooperative',NULL])[o_custkey % 3 + 1] AS ownership, (['furnished',NULL,'partially','unfurnished',NULL])[o_custkey % 5 + 1] AS furnishing, (['A','B',NULL,'G'])[o_custkey % 4 + 1] AS energy_rating,
 (['["balcony","lift"]','["cellar","parking"]','["balcony","garage","terrace"]','["barrier_free","lift"]',NULL])[o_orderkey % 5 + 1] AS amenities,
 CASE WHEN o_orderkey % 5 = 0 THEN '//img.example.net/' ELSE 'http://img.example.net/' END AS http, CAST(least(o_orderkey % 4, 3) AS INTEGER) AS n_images,
 CASE WHEN o_orderkey % 4 > 0 THEN http || o_orderkey || '/0' END AS first_image,
 CASE WHEN o_orderkey % 6 <> 0 THEN http || o_orderkey END AS thumbnail_url, 'https://' || CASE WHEN o_orderkey % 7 = 0 THEN 'www.portal.example' ELSE 'example.org' END || '/detail/' || o_orderkey AS source_url,
 CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) END AS listed_at, o_orderdate + to_days(CAST(o_custkey % 30 AS INTEGER)) AS scraped_at,
 CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_days(1) END AS enriched_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) END AS last_checked_at,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END AS last_image_checked_at, o_orderdate AS created_at,
 CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS deactivated_at,
 CASE WHEN o_orderkey % 8 = 0 THEN (['ttl','liveness_404','liveness_dead',NULL])[(o_orderkey // 8) % 4 + 1] END AS deactivation_reason, o_orderkey % 8 <> 0 AS is_active,
 CASE WHEN o_custkey % 4 = 0 THEN md5('c' || o_custkey || deal) END AS cid,
 CASE WHEN o_custkey % 6 <> 0 THEN 'Seller ' || o_custkey END AS seller_name, CASE WHEN o_custkey % 7 = 0 THEN '+420 600 000 000' END AS seller_phone
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)))
"""

EMAIL = "CASE WHEN {c} % 3 = 0 THEN 'U.ser' ELSE 'user' END || {c} || CASE WHEN {c} % 4 = 0 THEN '+tag' ELSE '' END || '@' || (['gmail.com','googlemail.com','Example.org'])[{c} % 3 + 1]".format(c="c_custkey")

CANONICAL = "CASE WHEN c_custkey % 3 = 2 THEN 'user' || c_custkey || '@example.org' ELSE 'user' || c_custkey || '@gmail.com' END"

WATCHDOGS = (
    ", watchdogs AS (SELECT c_custkey AS id, " + EMAIL + " AS email, " + CANONICAL + """ AS email_canonical,
 CASE WHEN c_custkey % 5 = 0 THEN (['flat','house','land','commercial','garage','cottage','residential_building','other'])[c_custkey % 8 + 1] END AS property_type,
 CASE WHEN c_custkey % 7 <> 0 THEN (['sale','rent','auction'])[c_custkey % 3 + 1] END AS transaction_type, CASE WHEN c_custkey % 41 <> 0 AND c_custkey % 8 < 5 THEN CASE WHEN c_custkey % 8 = 4 THEN n_name || ',FRANCE,' ELSE n_name END END AS city,
 CASE WHEN c_custkey % 8 = 5 THEN CASE WHEN c_custkey % 16 = 5 THEN r_name || ',AFRICA' ELSE r_name END END AS region, CASE WHEN c_custkey % 12 = 1 THEN 'low,high' END AS source,
 CASE WHEN c_custkey % 9 = 2 THEN '2+kk,3+kk' END AS layout, CASE WHEN c_custkey % 14 = 3 THEN 'good,new' END AS condition, CASE WHEN c_custkey % 15 = 4 THEN 'brick' END AS construction,
 CASE WHEN c_custkey % 16 = 5 THEN 'personal' END AS ownership, CASE WHEN c_custkey % 18 = 6 THEN 'furnished,partially' END AS furnishing, CASE WHEN c_custkey % 20 = 7 THEN 'A,G' END AS energy_rating,
 CASE WHEN c_custkey % 6 = 3 THEN CASE WHEN c_custkey % 12 = 3 THEN 'balcony, LIFT' ELSE 'lift' END END AS amenities,
 CASE WHEN c_custkey % 8 = 6 THEN CASE c_custkey % 64 WHEN 6 THEN r_name WHEN 14 THEN ' ' || lower(substr(n_name, 1, 2)) WHEN 22 THEN lower(substr(n_name, 1, 5)) WHEN 30 THEN n_name || ' 3' WHEN 38 THEN '_ra' WHEN 46 THEN 'AFRICA' WHEN 54 THEN substr(n_name, 1, 4) ELSE n_name END WHEN c_custkey % 16 = 7 THEN 'nowhere' END AS location,
 CASE WHEN c_custkey % 8 = 7 THEN CAST(48.6 AS DOUBLE) + CAST(c_custkey % 20 AS DOUBLE) / CAST(10 AS DOUBLE) END AS sw_lat, CASE WHEN c_custkey % 8 = 7 THEN CAST(12.2 AS DOUBLE) + CAST(c_custkey % 30 AS DOUBLE) / CAST(5 AS DOUBLE) END AS sw_lng,
 sw_lat + CAST(0.5 AS DOUBLE) AS ne_lat, sw_lng + CASE WHEN c_custkey % 32 = 7 THEN CAST(30 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS ne_lng,
 CASE WHEN c_custkey % 3 <> 0 THEN CAST(5000 + (c_custkey * 31) % 60000 AS DOUBLE) END AS price_min, CASE WHEN c_custkey % 6 <> 1 THEN CAST(30000 + (c_custkey * 31) % 60000 AS DOUBLE) END AS price_max,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(20 + c_custkey % 100 AS DOUBLE) END AS size_min, CASE WHEN c_custkey % 10 = 3 THEN CAST(80 + c_custkey % 100 AS DOUBLE) END AS size_max,
 c_custkey % 9 <> 0 AS active, TIMESTAMP '1996-01-01 00:00:00' AS created_at, CASE WHEN c_custkey % 4 = 1 THEN TIMESTAMP '1998-01-01 00:00:00' END AS last_notified_at
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
, notifications AS (SELECT DISTINCT w.email_canonical, coalesce('cluster:' || l.cluster_id, 'singleton:' || l.id) AS cluster_key FROM listings l JOIN watchdogs w ON w.id = l.c)
"""
)
