"""Readers of landed source data and writers of snapshots, feeds and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escaped
from .schemas import LISTING, NOTIFICATION

ESTATES = "_embedded struct<estates:array<struct<hash_id:bigint,name:string,price:double,locality:string,gps:struct<lat:double,lon:double>>>>, result_size bigint"
ADVERTS = "data struct<listAdverts:struct<totalCount:bigint,list:array<struct<id:string,price:double,address:string,gps:struct<lat:double,lng:double>>>>>"


def listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING).parquet(path)


def rest_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Landed pages of a paged JSON interface: a row per item."""
    rows = spark.read.schema(ESTATES).json(path).select(F.explode("_embedded.estates").alias("e"))
    return rows.select(F.concat(F.lit(source + "_"), F.col("e.hash_id").cast("string")).alias("external_id"), F.lit(source).alias("source"), F.col("e.name").alias("title"), F.col("e.price").alias("price"), F.col("e.locality").alias("address"), F.col("e.gps.lat").alias("latitude"), F.col("e.gps.lon").alias("longitude"))


def graphql_pages(spark: SparkSession, path: str, source: str) -> DataFrame:
    rows = spark.read.schema(ADVERTS).json(path).select(F.explode("data.listAdverts.list").alias("e"))
    return rows.select(F.concat(F.lit(source + "_"), F.col("e.id")).alias("external_id"), F.lit(source).alias("source"), F.col("e.price").alias("price"), F.col("e.address").alias("address"), F.col("e.gps.lat").alias("latitude"), F.col("e.gps.lng").alias("longitude"))


def cached_references(cache: DataFrame) -> DataFrame:
    """Normalised-cache pages (a map of key to object JSON): adverts with their referenced objects put in place."""
    entries = cache.select("page_id", F.explode("entries").alias("key", "value"))
    adverts = entries.where(F.col("key").startswith("Advert:")).select("page_id", "key", "value", F.get_json_object("value", "$.address.__ref").alias("ref"))
    objects = entries.select("page_id", F.col("key").alias("ref"), F.col("value").alias("address"))
    return adverts.join(objects, ["page_id", "ref"], "left").select("page_id", "key", "value", "address")


def preferred(entries: Column, part: str) -> Column:
    """The value of the first key that contains ``part``, else the first value."""
    return F.coalesce(F.get(F.map_values(F.map_filter(entries, lambda k, _: F.contains(k, F.lit(part)))), F.lit(0)), F.get(F.map_values(entries), F.lit(0)))


def features(listings: DataFrame) -> DataFrame:
    """Points as GeoJSON features, one per line."""
    return listings.where("is_active AND latitude IS NOT NULL AND longitude IS NOT NULL").select(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"), F.struct("id", "title", "price", "source").alias("properties"))


FEATURE = "type string, geometry struct<type:string,coordinates:array<double>>, properties struct<id:bigint,title:string,price:double,source:string>"


def write_features(listings: DataFrame, path: str) -> None:
    features(listings).write.mode("overwrite").json(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE).json(path).select("properties.*", F.get("geometry.coordinates", F.lit(1)).alias("latitude"), F.get("geometry.coordinates", F.lit(0)).alias("longitude"))


#: South, west, north, east of all places, and bits of each axis of the curve.
WORLD, BITS = (-90.0, -180.0, 90.0, 180.0), 16


def curve(latitude: Column, longitude: Column, area: tuple[float, float, float, float] = WORLD) -> Column:
    """The place on a space-filling (Z-order) curve: near places have near numbers. Outside the area, its edge; null without a place."""

    def spread(x: Column, low: float, high: float) -> Column:
        top = (1 << BITS) - 1
        x = F.least(F.lit(top), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * (top + 1)))).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):  # a zero before every bit
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    south, west, north, east = area
    at = F.shiftleft(spread(latitude, south, north), 1).bitwiseOR(spread(longitude, west, east))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), at)


def placed(df: DataFrame, *by: str, area: tuple[float, float, float, float] = WORLD) -> DataFrame:
    """Rows dealt to tasks and sorted by ``by`` and then along the curve, so that files and their row groups are small areas.

    Rows without a place follow a hash of their own numbers below all places, so that they are not one task's.
    """
    nowhere = -1 - F.pmod(F.xxhash64("id" if "id" in df.columns else F.struct(*df.columns)), F.lit(1 << 31))
    out = df.withColumn("_curve", F.coalesce(curve(F.col("latitude"), F.col("longitude"), area), nowhere))
    return out.repartitionByRange(*by, "_curve").sortWithinPartitions(*by, "_curve").drop("_curve")


def write_snapshot(df: DataFrame, path: str, *by: str, area: tuple[float, float, float, float] = WORLD, block_bytes: int | None = None) -> str:
    """A new snapshot beside the old ones, named by its number; readers take the last one that is complete.

    Where rows have a place they are ordered along a curve, so that a box reads few files and row groups. ``area`` is where
    the places are (the curve is finer in a small one), ``block_bytes`` the size of a row group. A task that fails leaves a
    folder without the mark of completion, which ``snapshot`` passes over; a number that another writer took is an error.
    """
    out = placed(df, *by, area=area) if {"latitude", "longitude"} <= set(df.columns) else df.repartition(*by) if by else df
    numbers = [int(name) for name, _ in _snapshots(df.sparkSession, path)]
    target = f"{path}/{max(numbers, default=0) + 1:08d}"
    writer = out.write.partitionBy(*by)
    (writer.option("parquet.block.size", block_bytes) if block_bytes else writer).parquet(target)
    return target


def _snapshots(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, complete) of the snapshots below a path, by the session's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder) if x.isDirectory()]
    return sorted((n, fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))) for n in names if n.isdigit())


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last complete snapshot."""
    return spark.read.parquet(f"{path}/{[name for name, complete in _snapshots(spark, path) if complete][-1]}")


def append_missing(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> None:
    """Insert what is not there: the first row of a key wins, old rows stay."""
    old = spark.read.schema(rows.schema).parquet(path).select(*keys)
    rows.dropDuplicates(keys).join(old, keys, "left_anti").write.mode("append").parquet(path)


def audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTIFICATION).parquet(path)


def migrate(spark: SparkSession, url: str, dbtable: str, path: str, keys: list[str], **options: str) -> None:
    """Copy a table of another database, skipping rows whose key is known."""
    append_missing(spark, spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load(), path, keys)


def sitemap_rows(listings: DataFrame, base: str, most: int = 50_000) -> DataFrame:
    """URL and last change of the first listings by id."""
    changed = F.date_format(F.coalesce("enriched_at", "scraped_at", "created_at"), "yyyy-MM-dd")
    return listings.where("is_active AND is_canonical").orderBy("id").limit(most).select(F.format_string(base + "/listing/%d", "id").alias("loc"), changed.alias("lastmod"))


def write_sitemap(listings: DataFrame, base: str, path: str) -> None:
    """One document: rows by id within the envelope of a sitemap, addresses escaped."""
    rows = sitemap_rows(listings, base).select(F.monotonically_increasing_id().alias("at"), F.format_string("<url><loc>%s</loc><lastmod>%s</lastmod></url>", escaped(F.col("loc")), "lastmod").alias("value"))
    ends = listings.sparkSession.createDataFrame([(-1, '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), ((1 << 62), "</urlset>")], "at long, value string")
    rows.union(ends).coalesce(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)  # at most 50,000 rows


def last_runs(runs: DataFrame) -> DataFrame:
    """The state of each run: its last log row."""
    return runs.groupBy("id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "id"]), F.coalesce("finished_at", "started_at")).alias("s")).select("id", "s.*")
