"""Listings, watchdogs and notifications derived from the order tables: one listing per order.

Place, size and price depend on the customer alone, so orders of one customer with one status are the same item seen by
several sources. The two dimension tables are broadcast only where the planner finds them small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The present, for everything that has a horizon.
NOW = "2001-09-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def shifted(moment: Column, days: Column | int = 0, hours: Column | int = 0) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return moment + F.make_dt_interval(lit(days).cast("int"), lit(hours).cast("int"))


LAYOUTS = ["1+kk", "1+1", "2+kk", "2+1", "3+kk", "3+1", "4+kk", "6+kk", None]
AMENITIES = ['["balcony","lift"]', '["cellar","parking"]', '["balcony","garage","terrace"]', '["barrier_free","lift"]', None]
PROPERTY = ["flat", "house", "land", "commercial", "garage", "cottage", "residential_building", "other"]
WORDS = {"sale": "prodej", "rent": "pronájem", "auction": "dražba"}


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    i, c, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp_ntz")
    deal = F.when(F.col("o_orderstatus") == "F", "sale").when(F.col("o_orderstatus") == "O", "rent").otherwise("auction")
    some = lambda keep, value: F.when(keep, value)
    size, layout, active = some(c % 19 != 0, (20 + c % 180).cast("double")), pick(LAYOUTS, c), i % 8 != 0
    clustered = some(c % 4 == 0, F.md5(F.concat(F.lit("c"), c.cast("string"), deal).cast("binary")))
    word = F.when(deal == "sale", "prodej").when(deal == "rent", "pronájem").otherwise("dražba")
    http = F.when(i % 5 == 0, "//img.example.net/").otherwise("http://img.example.net/")
    return rows.select(
        i.alias("id"), F.concat(F.lit("ext_"), i.cast("string")).alias("external_id"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("source"),
        pick(PROPERTY, c).alias("property_type"), deal.alias("transaction_type"),
        F.concat(word, F.lit(" bytu "), F.coalesce(layout, F.lit("atypický")), F.lit(" "), F.coalesce((20 + c % 180).cast("string"), F.lit("")), F.lit(" m²")).alias("title"),
        some(i % 4 != 1, F.concat(F.lit("Nabídka "), i.cast("string"), F.lit(". Byt po rekonstrukci v klidné části obce! Cena dohodou."))).alias("description"),
        some(c % 11 != 0, (5000 + (c * 7919) % 95000).cast("double")).alias("price"),
        F.when(c % 31 == 0, "EUR").otherwise("CZK").alias("currency"),
        some(c % 9 != 0, F.concat(F.col("n_name"), F.lit(", okres "), F.col("n_name"))).alias("address"),
        F.col("n_name").alias("city"), F.concat(F.col("n_name"), F.lit(" "), (c % 10).cast("string")).alias("district"), F.col("r_name").alias("region"),
        some(c % 17 != 0, 48.55 + (c * 37 % 2500) / F.lit(1000.0)).alias("latitude"), some(c % 17 != 0, 12.1 + (c * 53 % 6700) / F.lit(1000.0)).alias("longitude"),
        size.alias("size_m2"), layout.alias("layout"), some(c % 3 != 0, (c % 12).cast("int")).alias("floor"), some(c % 5 != 0, (c % 12 + 1).cast("int")).alias("total_floors"),
        pick(["new", "good", "very_good", "after_reconstruction", None, "poor"], c).alias("condition"), pick(["brick", "panel", None, "wood"], c).alias("construction"),
        pick(["personal", "cooperative", None], c).alias("ownership"), pick(["furnished", None, "partially", "unfurnished", None], c).alias("furnishing"), pick(["A", "B", None, "G"], c).alias("energy_rating"),
        pick(AMENITIES, i).alias("amenities"),
        F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, (i % 4).cast("int")), lambda k: F.concat(http, i.cast("string"), F.lit("/"), k.cast("string"))).alias("image_urls"),
        some(i % 6 != 0, F.concat(http, i.cast("string"))).alias("thumbnail_url"), F.concat(F.lit("https://"), F.when(i % 7 == 0, "www.portal.example").otherwise("example.org"), F.lit("/detail/"), i.cast("string")).alias("source_url"),
        some(i % 13 != 0, shifted(day, 0, i % 24)).alias("listed_at"), shifted(day, c % 30).alias("scraped_at"), some(i % 3 != 0, shifted(day, 1)).alias("enriched_at"),
        some(i % 4 != 0, shifted(day, i % 60)).alias("last_checked_at"), some(i % 5 != 0, shifted(day, i % 40)).alias("last_image_checked_at"), day.alias("created_at"),
        some(~active, shifted(day, i % 20)).alias("deactivated_at"), some(~active, pick(["ttl", "liveness_404", "liveness_dead", None], F.floor(i / 8))).alias("deactivation_reason"),
        active.alias("is_active"), (clustered.isNull() | (i % 3 == 0)).alias("is_canonical"), clustered.alias("cluster_id"),
        some(c % 6 != 0, F.concat(F.lit("Seller "), c.cast("string"))).alias("seller_name"), some(c % 7 == 0, F.lit("+420 600 000 000")).alias("seller_phone"),
    )


def pick_place(c: Column) -> Column:
    """Places as people type them: a region, a short or a longer beginning of a nation, a district, a pattern."""
    n = F.col("n_name")
    return F.when(c % 64 == 6, F.col("r_name")).when(c % 64 == 14, F.concat(F.lit(" "), F.lower(F.substring(n, 1, 2)))).when(c % 64 == 22, F.lower(F.substring(n, 1, 5))).when(c % 64 == 30, F.concat(n, F.lit(" 3"))).when(c % 64 == 38, "_ra").when(c % 64 == 46, "AFRICA").when(c % 64 == 54, F.substring(n, 1, 4)).otherwise(n)


def watchdogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored search per customer."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    c = F.col("c_custkey")
    email = F.concat(F.when(c % 3 == 0, "U.ser").otherwise("user"), c.cast("string"), F.when(c % 4 == 0, "+tag").otherwise(""), F.lit("@"), pick(["gmail.com", "googlemail.com", "Example.org"], c))
    low, area = 5000 + (c * 31) % 60000, 20 + c % 100
    south, west, boxed = F.lit(48.6) + (c % 20) / F.lit(10.0), F.lit(12.2) + (c % 30) / F.lit(5.0), c % 8 == 7
    opt = lambda keep, x: F.when(keep, x)
    return rows.select(
        c.alias("id"), email.alias("email"), F.struct(
            opt(c % 5 == 0, pick(PROPERTY, c)).alias("property_type"), opt(c % 7 != 0, pick(["sale", "rent", "auction"], c)).alias("transaction_type"),
            opt((c % 41 != 0) & (c % 8 < 5), F.when(c % 8 == 4, F.concat("n_name", F.lit(",FRANCE,"))).otherwise(F.col("n_name"))).alias("city"),
            opt(c % 8 == 5, F.when(c % 16 == 5, F.concat("r_name", F.lit(",AFRICA"))).otherwise(F.col("r_name"))).alias("region"), opt(c % 12 == 1, F.lit("low,high")).alias("source"),
            opt(c % 9 == 2, F.lit("2+kk,3+kk")).alias("layout"), opt(c % 14 == 3, F.lit("good,new")).alias("condition"), opt(c % 15 == 4, F.lit("brick")).alias("construction"),
            opt(c % 16 == 5, F.lit("personal")).alias("ownership"), opt(c % 18 == 6, F.lit("furnished,partially")).alias("furnishing"), opt(c % 20 == 7, F.lit("A,G")).alias("energy_rating"),
            opt(c % 6 == 3, F.when(c % 12 == 3, "balcony, LIFT").otherwise("lift")).alias("amenities"),
            F.when(c % 8 == 6, pick_place(c)).when(c % 16 == 7, F.lit("nowhere")).alias("location"),
            opt(boxed, south).alias("sw_lat"), opt(boxed, west).alias("sw_lng"), opt(boxed, south + 0.5).alias("ne_lat"), opt(boxed, west + F.when(c % 32 == 7, 30.0).otherwise(1.0)).alias("ne_lng"),
            opt(c % 3 != 0, low.cast("double")).alias("price_min"), opt(c % 6 != 1, (low + 25000).cast("double")).alias("price_max"),
            opt(c % 2 == 0, area.cast("double")).alias("size_min"), opt(c % 10 == 3, (area + 60).cast("double")).alias("size_max")).alias("filters"),
        (c % 9 != 0).alias("active"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        opt(c % 4 == 1, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).alias("last_notified_at"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been sent: to each customer's address, the offers made of the customer's own orders."""
    from ..functions.keys import canonical_email, cluster_key

    sent = listings(spark, sf_dir).select("id", "cluster_id").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), "id")
    # The address is made canonical once a customer, not once an offer.
    rows = sent.join(watchdogs(spark, sf_dir).select(F.col("id").alias("customer"), canonical_email(F.col("email")).alias("email_canonical")), "customer")
    return rows.select("email_canonical", cluster_key().alias("cluster_key")).distinct()
