"""Pre-aggregated statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count("*").alias("total_all"), F.count_if(F.col("is_active")).alias("total_active"), (F.count("*") - F.count_if(F.col("is_active"))).alias("inactive"))


def counts(listings: DataFrame, *by: str) -> DataFrame:
    return listings.where(F.col("is_active")).groupBy(*by).agg(F.count("*").alias("cnt"))


def top_cities(listings: DataFrame, n: int = 10) -> DataFrame:
    return counts(listings.where("city IS NOT NULL"), "city").orderBy(F.desc("cnt"), "city").limit(n)


DIMENSIONS = ("source", "property_type", "transaction_type")


def tall(listings: DataFrame, cities: int = 10) -> DataFrame:
    """One row per (dimension, value): the three dimensions and the cities in one pass by grouping sets, then the total."""
    active = listings.where(F.col("is_active"))
    sets = [[c] for c in (*DIMENSIONS, "city")]
    columns = [c for s in sets for c in s]
    cube = active.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("cnt"), F.grouping_id(*columns).alias("g"))
    n = len(columns)
    name = F.coalesce(*[F.when(F.col("g") == (1 << n) - 1 - (1 << (n - 1 - k)), F.lit(c)) for k, c in enumerate(columns)])
    value = F.coalesce(*[F.when(name == c, F.col(c)) for c in columns])
    rows = cube.select(name.alias("dimension"), value.alias("value"), "cnt")
    top = rows.where("dimension = 'city' AND value IS NOT NULL").orderBy(F.desc("cnt"), "value").limit(cities)
    overall = totals(listings).select(F.lit("overall").alias("dimension"), F.lit(None).cast("string").alias("value"), F.col("total_active").alias("cnt"))
    return rows.where("dimension <> 'city'").unionByName(top).unionByName(overall)


def nested(tall_rows: DataFrame) -> DataFrame:
    """The read side: a map per dimension."""
    return tall_rows.where("value IS NOT NULL").groupBy("dimension").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "cnt")))).alias("counts"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(100.0 * a, b), 2), F.lit(0.0))


def thumbnail_shapes(listings: DataFrame) -> DataFrame:
    relative, first = F.col("thumbnail_url").startswith("//"), F.get("image_urls", F.lit(0))
    return listings.agg(F.count_if(relative).alias("relative"), F.count_if(relative & first.startswith("http")).alias("fixable"), F.count_if(F.col("thumbnail_url").isNull()).alias("missing"), ratio(F.count_if(relative), F.count("*")).alias("relative_percent"))
