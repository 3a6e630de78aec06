"""Cross-source duplicates: clusters of active listings with one match hash, one canonical member each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import effective_hash, match_hash, match_hash_no_price


def hashed(listings: DataFrame) -> DataFrame:
    return listings.withColumns({"match_hash": match_hash(), "match_hash_no_price": match_hash_no_price()})


def candidates(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("is_active")).withColumn("effective_hash", effective_hash()).where("effective_hash IS NOT NULL")


def full(listings: DataFrame) -> DataFrame:
    """All clusters anew: (id, cluster_id, is_canonical) of every listing. One aggregation by hash and a join back.

    Groups are aggregated before they meet, and only keys of clusters join back, so a hash that many rows share costs one
    row of the aggregate and a join that adaptive execution can split.
    """
    keyed = listings.select("id", F.when(F.col("is_active"), effective_hash()).alias("effective_hash"))
    groups = keyed.where("effective_hash IS NOT NULL").groupBy("effective_hash").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(groups, "effective_hash", "left")
    return joined.select("id", F.when(F.col("n").isNotNull(), F.col("effective_hash")).alias("cluster_id"), F.coalesce(F.col("id") == F.col("canonical_id"), F.lit(True)).alias("is_canonical"))


def full_counts(listings: DataFrame) -> DataFrame:
    """What a full pass would do, without doing it."""
    groups = candidates(listings).groupBy("effective_hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("clustered"), F.count("*").alias("clusters"))


def incremental(listings: DataFrame, *also: str) -> DataFrame:
    """(id, cluster_id, is_canonical, existing_cluster) of the listings that join or form a cluster; clustered rows stay.

    Other columns can be asked for."""
    open_ = F.col("cluster_id").isNull()
    rows = candidates(listings).select("id", *also, "cluster_id", "effective_hash")
    groups = rows.groupBy("effective_hash").agg(F.bool_or(~open_).alias("existing_cluster"), F.min(F.when(open_, F.col("id"))).alias("new_canonical_id"), F.count_if(open_).alias("n"))
    groups = groups.where((F.col("n") > 0) & (F.col("existing_cluster") | (F.col("n") >= 2)))
    found = rows.where(open_).drop("cluster_id").join(groups, "effective_hash")
    return found.select("id", *also, F.col("effective_hash").alias("cluster_id"), (~F.col("existing_cluster") & (F.col("id") == F.col("new_canonical_id"))).alias("is_canonical"), "existing_cluster")


def assigned(listings: DataFrame, clusters: DataFrame, key: str = "id") -> DataFrame:
    """The listings with new cluster columns where ``clusters`` has them."""
    new = clusters.select(key, F.col("cluster_id").alias("_cluster"), F.col("is_canonical").alias("_canonical"), F.lit(True).alias("_new"))
    joined = listings.join(new, key, "left")
    changed = F.coalesce("_new", F.lit(False))
    return joined.withColumns({"cluster_id": F.when(changed, F.col("_cluster")).otherwise(F.col("cluster_id")), "is_canonical": F.when(changed, F.col("_canonical")).otherwise(F.col("is_canonical"))}).drop("_cluster", "_canonical", "_new").select(*listings.columns)


def totals(listings: DataFrame) -> DataFrame:
    active = F.col("is_active")
    return listings.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(active & F.col("cluster_id").isNotNull()).alias("clustered"),
        F.count_if(active & F.col("is_canonical")).alias("canonical"), F.count_distinct(F.when(active, F.col("cluster_id"))).alias("clusters"),
    )


def active_clusters(listings: DataFrame) -> DataFrame:
    return listings.where(F.col("is_active") & F.col("cluster_id").isNotNull())


def size_histogram(listings: DataFrame) -> DataFrame:
    sizes = active_clusters(listings).groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count("*").alias("clusters"))


def source_span(listings: DataFrame) -> DataFrame:
    spans = active_clusters(listings).groupBy("cluster_id").agg(F.count_distinct("source").alias("sources"))
    return spans.groupBy("sources").agg(F.count("*").alias("clusters"))


def joined_sources() -> Column:
    return F.array_join(F.array_sort(F.collect_set("source")), ", ")


def biggest(listings: DataFrame, n: int = 10) -> DataFrame:
    groups = active_clusters(listings).groupBy("cluster_id").agg(F.count("*").alias("n"), joined_sources().alias("sources"), F.min("price").alias("price_min"), F.max("price").alias("price_max"))
    return groups.orderBy(F.desc("n"), "cluster_id").limit(n)


def recent_cross_source(listings: DataFrame, n: int = 3) -> DataFrame:
    groups = active_clusters(listings).groupBy("cluster_id").agg(F.max("id").alias("newest"), F.count_distinct("source").alias("sources")).where("sources >= 2")
    return groups.orderBy(F.desc("newest")).limit(n)


def no_price_groups(listings: DataFrame) -> DataFrame:
    rows = listings.where(F.col("is_active")).withColumn("key", match_hash_no_price()).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("id").alias("first_id")).where("n > 1")


def no_price_preview(listings: DataFrame) -> DataFrame:
    return no_price_groups(listings).agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.sum(F.col("n") - 1).alias("hidden"), F.count_if(F.col("sources") > 1).alias("cross_source"), F.max("n").alias("largest"))


def largest_would_be(listings: DataFrame, n: int = 15) -> DataFrame:
    """The largest groups without price, with the titles of their first five members."""
    rows = listings.where(F.col("is_active")).withColumn("key", match_hash_no_price()).where("key IS NOT NULL")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), joined_sources().alias("sources")).where("n > 1").orderBy(F.desc("n"), "first_id").limit(n)
    # Only the groups shown gather members.
    shown = rows.join(F.broadcast(groups.select("key")), "key").groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "title"))), 1, 5).alias("first"))
    return groups.join(shown, "key").select("first_id", "n", "sources", F.array_join(F.transform("first", lambda x: x.title), " / ").alias("titles"))


def hash_peers(listings: DataFrame) -> DataFrame:
    """Per listing, how many share its hash and the oldest of them; counted first, so a common hash is not one task's."""
    rows = listings.where(F.col("is_active")).select("id", match_hash().alias("match_hash")).where("match_hash IS NOT NULL")
    peers = rows.groupBy("match_hash").agg(F.count("*").alias("peers"), F.min("id").alias("oldest"))
    return rows.join(peers, "match_hash").select("id", "peers", "oldest")


def joined_existing(found: DataFrame) -> DataFrame:
    """Of an incremental pass: rows clustered, their clusters, and rows that joined a cluster there was."""
    return found.agg(F.count("*").alias("clustered"), F.count_distinct("cluster_id").alias("clusters"), F.count_if("existing_cluster").alias("joined_existing"))


def existing_cluster_probe(listings: DataFrame) -> DataFrame:
    """Unclustered listings whose hash a clustered one has."""
    rows = candidates(listings)
    held = rows.where("cluster_id IS NOT NULL").select("effective_hash")
    return rows.where("cluster_id IS NULL").join(held, "effective_hash", "left_semi").select("id")


def siblings(listings: DataFrame) -> DataFrame:
    """Of each listing, the others of its cluster: the newest of every source, cheapest first."""
    rows = active_clusters(listings)
    mine = rows.select(F.col("id").alias("listing_id"), "cluster_id")
    newest = Window.partitionBy("listing_id", "source").orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id"))
    # A listing excludes only itself, so the two newest of a source are enough for every member of the cluster.
    of_source = Window.partitionBy("cluster_id", "source").orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id"))
    two = rows.withColumn("k", F.row_number().over(of_source)).where("k <= 2").select("cluster_id", "id", "source", "price", "scraped_at")
    pairs = mine.join(two, "cluster_id").where("id <> listing_id")
    best = pairs.withColumn("k", F.row_number().over(newest)).where("k = 1")
    cheapest = Window.partitionBy("listing_id").orderBy(F.col("price").asc_nulls_last(), F.col("id"))
    return best.select("listing_id", "id", "source", "price", F.row_number().over(cheapest).alias("position"))


def canonical_first(listings: DataFrame) -> DataFrame:
    """Members of each cluster in the order in which links to them are shown: canonical ones, then the rest, cheapest first."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("is_canonical").desc(), F.col("price").asc_nulls_last(), F.col("id"))
    return active_clusters(listings).withColumn("position", F.row_number().over(order)).select("cluster_id", "id", "position")


def newest_per_source(listings: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster_id", "source").orderBy(F.col("scraped_at").desc_nulls_last(), F.col("id"))
    return active_clusters(listings).withColumn("k", F.row_number().over(w)).where("k = 1").select("cluster_id", "source", "id", "price")


def price_spread(listings: DataFrame) -> DataFrame:
    return active_clusters(listings).groupBy("cluster_id").agg(F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.coalesce(F.min("price") != F.max("price"), F.lit(False)).alias("vary"))
