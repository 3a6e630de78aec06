"""Map markers: grid cells at four precisions, rolled up level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cell
from .search import card, order

FINEST = 3
#: Precision of the grid by zoom; from 17 on, single listings.
PRECISION = {z: 0 if z <= 8 else 1 if z <= 10 else 2 if z <= 13 else 3 for z in range(1, 17)}


def located(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("is_active") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def finest(listings: DataFrame, exact: bool = False) -> DataFrame:
    sums = [F.sum("price").alias("price_sum"), F.count("price").alias("price_cnt")] if exact else []
    cells = located(listings).groupBy(cell(F.col("latitude"), FINEST).alias("lat"), cell(F.col("longitude"), FINEST).alias("lng"))
    return cells.agg(F.count("*").alias("cnt"), F.avg("price").alias("avg_price"), F.min("id").alias("min_id"), *sums)


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0))


def rolled(cells: DataFrame, precision: int, exact: bool = False) -> DataFrame:
    """One level coarser from the finer cells: the listings are read once, whatever the number of levels.

    The average weighs a cell by all its listings, priced or not; ``exact`` carries sums and counts instead.
    """
    price = [F.sum("price_sum").alias("price_sum"), F.sum("price_cnt").alias("price_cnt"), F.try_divide(F.sum("price_sum"), F.sum("price_cnt")).alias("avg_price")] if exact else [weighted(F.col("avg_price"), F.col("cnt")).alias("avg_price")]
    return cells.groupBy(cell(F.col("lat"), precision).alias("lat"), cell(F.col("lng"), precision).alias("lng")).agg(F.sum("cnt").alias("cnt"), F.min("min_id").alias("min_id"), *price)


def level(listings: DataFrame, precision: int, exact: bool = False) -> DataFrame:
    found = finest(listings, exact)
    for p in range(FINEST - 1, precision - 1, -1):
        found = rolled(found, p, exact)
    return found.select("lat", "lng", "cnt", F.round("avg_price", 4).alias("avg_price"), "min_id")


def levels(listings: DataFrame) -> DataFrame:
    """All four levels in one table, each from the one below; the finest is one shuffle, which all levels reuse."""
    current, out = finest(listings), []
    for p in range(FINEST, -1, -1):
        current = current if p == FINEST else rolled(current, p)
        out.append(current.select(F.lit(p).alias("precision"), "lat", "lng", "cnt", F.round("avg_price", 4).alias("avg_price"), "min_id"))
    return reduce(DataFrame.unionByName, out)


def viewport(cells: DataFrame, sw_lat: float, sw_lng: float, ne_lat: float, ne_lng: float) -> DataFrame:
    return cells.where(F.col("lat").between(sw_lat, ne_lat) & F.col("lng").between(sw_lng, ne_lng))


def expansion(listings: DataFrame) -> DataFrame:
    """Per coarsest cell, the first precision at which it falls into several cells; 4 where it never does."""
    fine = finest(listings).select("lat", "lng")
    at = lambda p: (F.struct(cell(cell(cell(F.col("lat"), 2), 1), p), cell(cell(cell(F.col("lng"), 2), 1), p)) if p < 1 else F.struct(cell(cell(F.col("lat"), 2), p), cell(cell(F.col("lng"), 2), p)) if p < 2 else F.struct(cell(F.col("lat"), p), cell(F.col("lng"), p)))
    root = cell(cell(cell(F.col("lat"), 2), 1), 0).alias("lat0"), cell(cell(cell(F.col("lng"), 2), 1), 0).alias("lng0")
    counted = fine.select(*root, *[at(p).alias(f"c{p}") for p in (1, 2, 3)]).groupBy("lat0", "lng0").agg(*[F.count_distinct(f"c{p}").alias(f"n{p}") for p in (1, 2, 3)])
    return counted.select(F.col("lat0").alias("lat"), F.col("lng0").alias("lng"), F.when(F.col("n1") > 1, 1).when(F.col("n2") > 1, 2).when(F.col("n3") > 1, 3).otherwise(4).alias("precision"))


def members_grid(listings: DataFrame, zoom: int, shown: int = 5) -> DataFrame:
    """The older grid: cells by banker's rounding, count and the first members.

    Members are cut to ``shown`` per cell before they are gathered, so no cell is collected whole.
    """
    from pyspark.sql import Window

    precision = max(1, min(5, zoom - 4))
    rows = located(listings).select("id", F.bround(F.col("latitude").cast("decimal(18,12)"), precision).cast("double").alias("lat"), F.bround(F.col("longitude").cast("decimal(18,12)"), precision).cast("double").alias("lng"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("lat", "lng").orderBy("id"))).where(F.col("k") <= shown)
    members = first.groupBy("lat", "lng").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return rows.groupBy("lat", "lng").agg(F.count("*").alias("cnt")).join(members, ["lat", "lng"])


def individual(listings: DataFrame, box: tuple[float, float, float, float], most: int = 5000) -> DataFrame:
    inside = F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3])
    return card(located(listings).where(inside).orderBy("id").limit(most))


def cards_page(listings: DataFrame, sort: str = "price_desc", limit: int = 20) -> DataFrame:
    """In-memory order: nulls last whatever the direction."""
    return card(located(listings).orderBy(*order(sort, "memory")).limit(limit))


def shape(zoom: int, filtered: bool, n: int) -> str:
    """What the map shows: ``individual`` listings or ``clusters``."""
    return "individual" if zoom >= 17 or filtered and n <= 50 else "clusters"


def box_area_km2(sw_lat: Column, sw_lng: Column, ne_lat: Column, ne_lng: Column) -> Column:
    return F.abs((ne_lat - sw_lat) * 111 * (ne_lng - sw_lng) * 111 * F.cos(F.radians((sw_lat + ne_lat) / 2)))
