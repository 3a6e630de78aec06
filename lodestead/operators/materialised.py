"""Grid cells and counts kept current from what changed, without reading all listings again.

A change is a listing before and after; it takes its old contribution out and puts its new one in, as signed sums by cell
or value. Counts and price sums are exact (prices as decimals), so taking out what was put in leaves nothing behind. A
least id cannot be taken out by subtraction: cells that lost their least one, and only these, look at their listings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cell
from .markers import FINEST, located
from .stats import DIMENSIONS

PRICE = "decimal(30,4)"
WATCHED = ("is_active", "latitude", "longitude", "price", "source", "property_type", "transaction_type", "city")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, b, a): listings whose watched columns differ, come or go; ``b`` and ``a`` are null where there was or is none."""
    side = lambda rows, name: rows.select("id", F.struct(*WATCHED).alias(name))
    joined = side(before, "b").join(side(after, "a"), "id", "full_outer")
    return joined.where(~F.col("a").eqNullSafe(F.col("b")))


def signed(changed: DataFrame) -> DataFrame:
    """A row with sign -1 for what a change takes out and one with sign 1 for what it puts in."""
    rows = changed.select("id", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("b").alias("x")), F.struct(F.lit(1).alias("sign"), F.col("a").alias("x")))).alias("s"))
    return rows.where("s.x IS NOT NULL").select("id", "s.sign", "s.x.*")


def _placed(rows: DataFrame) -> DataFrame:
    return located(rows).select("id", cell(F.col("latitude"), FINEST).alias("lat"), cell(F.col("longitude"), FINEST).alias("lng"), F.col("price").cast(PRICE).alias("price"), *(["sign"] if "sign" in rows.columns else []))


def cells(listings: DataFrame) -> DataFrame:
    """The finest cells with what can be added to and taken from: (lat, lng, cnt, price_sum, price_cnt, min_id)."""
    return _placed(listings).groupBy("lat", "lng").agg(F.count("*").alias("cnt"), F.coalesce(F.sum("price"), F.lit(0)).cast(PRICE).alias("price_sum"), F.count("price").alias("price_cnt"), F.min("id").alias("min_id"))


def refreshed_cells(current: DataFrame, changed: DataFrame, listings: DataFrame) -> DataFrame:
    """The cells after the changes; ``listings`` are those after them, of which only cells without a sure least id are read."""
    moved = _placed(signed(changed))
    priced = F.when(F.col("price").isNotNull(), F.col("sign")).otherwise(0)
    delta = moved.groupBy("lat", "lng").agg(
        F.sum("sign").alias("d_cnt"), F.coalesce(F.sum(F.col("price") * F.col("sign")), F.lit(0)).cast(PRICE).alias("d_sum"), F.sum(priced).alias("d_priced"),
        F.min(F.when(F.col("sign") > 0, F.col("id"))).alias("came"), F.min(F.when(F.col("sign") < 0, F.col("id"))).alias("went"),
    )
    joined = current.join(delta, ["lat", "lng"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    kept = F.col("min_id").isNotNull() & ~F.coalesce(F.col("went") <= F.col("min_id"), F.lit(False))
    # A cell whose least id went is sure again only if one no larger came.
    sure = kept | F.col("min_id").isNull() | F.coalesce(F.col("came") <= F.col("min_id"), F.lit(False))
    out = joined.select("lat", "lng", (zero("cnt") + zero("d_cnt")).alias("cnt"), (zero("price_sum") + zero("d_sum")).cast(PRICE).alias("price_sum"), (zero("price_cnt") + zero("d_priced")).alias("price_cnt"), F.when(sure, F.least("came", "min_id")).alias("min_id"), sure.alias("sure")).where("cnt > 0")
    open_ = out.where(~F.col("sure")).select("lat", "lng")
    found = _placed(listings).join(open_, ["lat", "lng"], "left_semi").groupBy("lat", "lng").agg(F.min("id").alias("found"))
    return out.join(found, ["lat", "lng"], "left").select("lat", "lng", "cnt", "price_sum", "price_cnt", F.coalesce("min_id", "found").alias("min_id"))


def counted(rows: DataFrame, weight: Column) -> DataFrame:
    """(dimension, value, cnt): weights of active rows by each dimension, city and overall, and of all rows."""
    active = rows.where(F.col("is_active"))
    each = [(name, F.col(name), active) for name in (*DIMENSIONS, "city")] + [("overall", F.lit(None).cast("string"), active), ("all", F.lit(None).cast("string"), rows)]
    parts = [part.select(F.lit(name).alias("dimension"), value.alias("value"), weight.alias("w")) for name, value, part in each]
    return reduce(DataFrame.unionByName, parts).groupBy("dimension", "value").agg(F.sum("w").alias("cnt"))


def counts(listings: DataFrame) -> DataFrame:
    return counted(listings, F.lit(1).cast("long"))


def refreshed_counts(current: DataFrame, changed: DataFrame) -> DataFrame:
    """The counts after the changes; values that nothing has any more go."""
    delta = counted(signed(changed), F.col("sign").cast("long"))
    return current.unionByName(delta).groupBy("dimension", "value").agg(F.sum("cnt").alias("cnt")).where("cnt > 0 OR value IS NULL AND dimension IN ('overall', 'all')")


def tall(current: DataFrame, cities: int = 10) -> DataFrame:
    """What is shown of the counts: the dimensions, the first cities, the active total and the inactive one."""
    top = current.where("dimension = 'city' AND value IS NOT NULL").orderBy(F.desc("cnt"), "value").limit(cities)
    inactive = current.where("dimension IN ('all', 'overall')").agg(F.sum(F.when(F.col("dimension") == "all", F.col("cnt")).otherwise(-F.col("cnt"))).alias("cnt")).select(F.lit("inactive").alias("dimension"), F.lit(None).cast("string").alias("value"), "cnt")
    return current.where("dimension NOT IN ('city', 'all')").unionByName(top).unionByName(inactive)
