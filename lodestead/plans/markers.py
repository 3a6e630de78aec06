"""Statistics and map markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markers as M
from ..operators import materialised as I
from ..operators import stats as T
from ..sources.adapter import listings, watchdogs
from .oracle import LISTINGS, WATCHDOGS

CELL = "CAST(CAST(CAST({0} AS DECIMAL(18,12)) AS DECIMAL(18,{1})) AS DOUBLE)"
COARSE = "CAST(CAST(CAST({0} AS DECIMAL(30,12)) AS DECIMAL(18,{1})) AS DOUBLE)"
COUNT = "count(*) AS cnt"


def cells(level: int) -> str:
    """CTEs of the finest level and of each coarser one down to ``level``."""
    out = f"{LISTINGS}, l3 AS (SELECT {CELL.format('latitude', 3)} AS lat, {CELL.format('longitude', 3)} AS lng, {COUNT}, avg(price) AS avg_price, min(id) AS min_id, sum(price) AS ps, count(price) AS pc FROM listings WHERE is_active AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2)"
    for p in range(2, level - 1, -1):
        out += f", l{p} AS (SELECT {COARSE.format('f.lat', p)} AS lat, {COARSE.format('f.lng', p)} AS lng, sum(cnt)::BIGINT AS cnt, sum(avg_price * cnt) / nullif(sum(CASE WHEN avg_price IS NOT NULL THEN cnt END), 0) AS avg_price, min(min_id) AS min_id, sum(ps) AS ps, sum(pc)::BIGINT AS pc FROM l{p + 1} f GROUP BY 1, 2)"
    return out


def level(p: int, exact: bool = False):
    return lambda spark, sf: M.level(listings(spark, sf), p, exact)


def level_sql(p: int, price: str = "avg_price") -> str:
    return f"{cells(p)} SELECT lat, lng, cnt, round({price}, 4) AS avg_price, min_id FROM l{p}"


def counted(*by):
    return lambda spark, sf: T.counts(listings(spark, sf), *by)


def area(spark, sf):
    c = F.col("id")
    box = [F.lit(48.5) + c % 7 / F.lit(10.0), F.lit(12.0) + c % 11 / F.lit(10.0), F.lit(48.7) + c % 13 / F.lit(10.0), F.lit(12.2) + c % 17 / F.lit(10.0)]
    rows = watchdogs(spark, sf).select("id", *[x.alias(n) for x, n in zip(box, ("a", "b", "d", "e"), strict=True)])
    km2 = M.box_area_km2(F.col("a"), F.col("b"), F.col("d"), F.col("e"))
    return rows.select("id", F.round(km2, 3).alias("km2"), (km2 > 1000).alias("too_large"))


A = "CAST({0} AS DOUBLE) + CAST(id % {1} AS DOUBLE) / CAST(10 AS DOUBLE)"
a, b, d, e = (A.format(x, m) for x, m in ((48.5, 7), (12.0, 11), (48.7, 13), (12.2, 17)))
KM2 = f"abs((({d}) - ({a})) * 111 * (({e}) - ({b})) * 111 * cos(radians((({a}) + ({d})) / 2)))"
TALL = "SELECT '{0}' AS dimension, {0} AS value, count(*) AS cnt FROM listings WHERE is_active GROUP BY 2"
ACTIVE = "FROM listings WHERE is_active"

def changed_listings(spark, sf):
    """Listings after a while: some gone inactive, some at other prices or places, some taken away, and new ones."""
    rows, i = listings(spark, sf), F.col("id")
    after = rows.where(i % 13 != 0).withColumns({"is_active": F.col("is_active") & (i % 5 != 0), "price": F.when(i % 3 == 0, F.col("price") + 1000).when(i % 17 == 0, None).otherwise(F.col("price")), "latitude": F.when(i % 7 == 0, F.col("latitude") + 0.25).otherwise(F.col("latitude"))})
    return rows, after.unionByName(rows.where(i % 11 == 0).withColumns({"id": -i, "city": F.lit("Nová")}))


AFTER = f"""{LISTINGS}, a AS (SELECT id, is_active AND id % 5 <> 0 AS is_active, CASE WHEN id % 3 = 0 THEN price + 1000 WHEN id % 17 = 0 THEN NULL ELSE price END AS price, CASE WHEN id % 7 = 0 THEN latitude + CAST(0.25 AS DOUBLE) ELSE latitude END AS latitude, longitude, source, property_type, transaction_type, city FROM listings WHERE id % 13 <> 0
 UNION ALL SELECT -id, is_active, price, latitude, longitude, source, property_type, transaction_type, 'Nová' FROM listings WHERE id % 11 = 0)"""


def refreshed_grid(spark, sf):
    """The grid of the changed listings, made from the grid before and the changes."""
    before, after = changed_listings(spark, sf)
    found = I.refreshed_cells(I.cells(before), I.changes(before, after), after)
    return found.select("lat", "lng", "cnt", F.round(F.try_divide(F.col("price_sum").cast("double"), "price_cnt"), 4).alias("avg_price"), "min_id")


def refreshed_stats(spark, sf):
    before, after = changed_listings(spark, sf)
    return I.tall(I.refreshed_counts(I.counts(before), I.changes(before, after)))


AFTER_TALL = " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS cnt FROM a WHERE is_active GROUP BY 2" for c in ("source", "property_type", "transaction_type"))


QUERIES = {
    "refreshed_grid": (refreshed_grid, f"{AFTER} SELECT {CELL.format('latitude', 3)} AS lat, {CELL.format('longitude', 3)} AS lng, {COUNT}, round(avg(price), 4) AS avg_price, min(id) AS min_id FROM a WHERE is_active AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2"),
    "refreshed_stats": (refreshed_stats, f"{AFTER} {AFTER_TALL} UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n FROM a WHERE is_active AND city IS NOT NULL GROUP BY 2 ORDER BY n DESC, city LIMIT 10) UNION ALL SELECT 'overall', NULL, count(*) FROM a WHERE is_active UNION ALL SELECT 'inactive', NULL, count(*) FROM a WHERE NOT is_active"),
    "stats_total": (lambda spark, sf: T.totals(listings(spark, sf)), f"{LISTINGS} SELECT count(*) AS total_all, count(*) FILTER (WHERE is_active) AS total_active, count(*) FILTER (WHERE NOT is_active) AS inactive FROM listings"),
    "stats_by_source": (counted("source"), f"{LISTINGS} SELECT source, {COUNT} {ACTIVE} GROUP BY 1"),
    "stats_by_type": (counted("property_type"), f"{LISTINGS} SELECT property_type, {COUNT} {ACTIVE} GROUP BY 1"),
    "stats_by_transaction": (counted("transaction_type"), f"{LISTINGS} SELECT transaction_type, {COUNT} {ACTIVE} GROUP BY 1"),
    "stats_multi_group": (counted("source", "property_type", "transaction_type"), f"{LISTINGS} SELECT source, property_type, transaction_type, {COUNT} {ACTIVE} GROUP BY 1, 2, 3"),
    "stats_top_cities": (lambda spark, sf: T.top_cities(listings(spark, sf)), f"{LISTINGS} SELECT city, {COUNT} {ACTIVE} AND city IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, city LIMIT 10"),
    "stats_top_six_cities": (lambda spark, sf: T.top_cities(listings(spark, sf), 6), f"{LISTINGS} SELECT city, {COUNT} {ACTIVE} AND city IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, city LIMIT 6"),
    "stats_tall_table": (lambda spark, sf: T.tall(listings(spark, sf)), f"{LISTINGS} SELECT * FROM ({TALL.format('source')} UNION ALL {TALL.format('property_type')} UNION ALL {TALL.format('transaction_type')} UNION ALL SELECT * FROM (SELECT 'city', city, count(*) AS n {ACTIVE} AND city IS NOT NULL GROUP BY 2 ORDER BY n DESC, city LIMIT 10) UNION ALL SELECT 'overall', NULL, count(*) {ACTIVE})"),
    "stats_nested": (lambda spark, sf: T.nested(T.tall(listings(spark, sf))).select("dimension", F.size("counts").alias("entries")), f"{LISTINGS} SELECT 'source' AS dimension, count(DISTINCT source)::INTEGER AS entries {ACTIVE} UNION ALL SELECT 'property_type', count(DISTINCT property_type)::INTEGER {ACTIVE} UNION ALL SELECT 'transaction_type', count(DISTINCT transaction_type)::INTEGER {ACTIVE} UNION ALL SELECT 'city', least(10, count(DISTINCT city))::INTEGER {ACTIVE}"),
    "stats_thumbnail_shapes": (lambda spark, sf: T.thumbnail_shapes(listings(spark, sf)), f"{LISTINGS} SELECT count(*) FILTER (WHERE thumbnail_url LIKE '//%') AS relative, count(*) FILTER (WHERE thumbnail_url LIKE '//%' AND first_image LIKE 'http%') AS fixable, count(*) FILTER (WHERE thumbnail_url IS NULL) AS missing, round(100.0::DOUBLE * count(*) FILTER (WHERE thumbnail_url LIKE '//%') / count(*), 2) AS relative_percent FROM listings"),
    "markers_grid_p3": (level(3), level_sql(3)),
    "markers_rollup_p2": (level(2), level_sql(2)),
    "markers_rollup_p1": (level(1), level_sql(1)),
    "markers_rollup_p0": (level(0), level_sql(0)),
    "markers_exact_average": (level(1, True), level_sql(1, "ps / nullif(pc, 0)")),
    "markers_levels": (lambda spark, sf: M.levels(listings(spark, sf)).groupBy("precision").agg(F.count("*").alias("cells"), F.sum("cnt").alias("total")), f"{cells(0)} SELECT 3 AS precision, count(*) AS cells, sum(cnt)::BIGINT AS total FROM l3 UNION ALL SELECT 2, count(*), sum(cnt)::BIGINT FROM l2 UNION ALL SELECT 1, count(*), sum(cnt)::BIGINT FROM l1 UNION ALL SELECT 0, count(*), sum(cnt)::BIGINT FROM l0"),
    "markers_viewport": (lambda spark, sf: M.viewport(M.level(listings(spark, sf), 2), 49.0, 13.0, 50.0, 15.5), f"{cells(2)} SELECT lat, lng, cnt, round(avg_price, 4) AS avg_price, min_id FROM l2 WHERE lat BETWEEN 49.0 AND 50.0 AND lng BETWEEN 13.0 AND 15.5"),
    "markers_expansion_level": (lambda spark, sf: M.expansion(listings(spark, sf)), f"""{cells(3)}, k AS (SELECT *, {COARSE.format('lat', 2)} AS a2, {COARSE.format('lng', 2)} AS b2 FROM l3), k1 AS (SELECT *, {COARSE.format('a2', 1)} AS a1, {COARSE.format('b2', 1)} AS b1 FROM k), k0 AS (SELECT *, {COARSE.format('a1', 0)} AS a0, {COARSE.format('b1', 0)} AS b0 FROM k1)
SELECT a0 AS lat, b0 AS lng, CASE WHEN count(DISTINCT (a1, b1)) > 1 THEN 1 WHEN count(DISTINCT (a2, b2)) > 1 THEN 2 WHEN count(DISTINCT (lat, lng)) > 1 THEN 3 ELSE 4 END AS precision FROM k0 GROUP BY 1, 2"""),
    "markers_v1_grid_members": (lambda spark, sf: M.members_grid(listings(spark, sf), 6), f"{LISTINGS} SELECT round_even(CAST(latitude AS DECIMAL(18,12)), 2)::DOUBLE AS lat, round_even(CAST(longitude AS DECIMAL(18,12)), 2)::DOUBLE AS lng, {COUNT}, array_to_string((array_agg(id ORDER BY id))[1:5], ',') AS ids {ACTIVE} AND latitude IS NOT NULL GROUP BY 1, 2"),
    "markers_individual": (lambda spark, sf: M.individual(listings(spark, sf), (49.0, 13.0, 49.5, 14.0)).select("id", "title", "latitude", "longitude"), f"{LISTINGS} SELECT id, title, latitude, longitude {ACTIVE} AND latitude BETWEEN 49.0 AND 49.5 AND longitude BETWEEN 13.0 AND 14.0 ORDER BY id LIMIT 5000"),
    "bbox_area_guard": (area, f"{LISTINGS}{WATCHDOGS} SELECT id, round({KM2}, 3) AS km2, {KM2} > 1000 AS too_large FROM watchdogs"),
}
