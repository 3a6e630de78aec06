"""State transitions of the listings table: pure functions from a snapshot and a change to the next snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT = ("id", "external_id", "source", "created_at")
#: Horizons in days, and city names that are not in the country.
TTL_DAYS, GIVE_UP_DAYS, REACTIVATE_DAYS, REENRICH_DAYS = 14, 3, 7, 7
FOREIGN = ("spanelsko", "spain", "espana", "nemecko", "germany", "deutschland", "rakousko", "austria", "polsko", "poland", "slovensko", "slovakia", "francie", "france", "italie", "italy")


#: Buckets in which new listings are numbered.
BUCKETS = 4096
#: The column by which an upsert deals rows out: the external id, or the id behind a zero byte where there is none.
KEY = "_key"


def ago(now: Column, days: int = 0, hours: int = 0) -> Column:
    return now - F.make_dt_interval(F.lit(days), F.lit(hours))


def marked(listings: DataFrame, rows: DataFrame, name: str, key: str = "external_id") -> DataFrame:
    """A flag column: whether the key occurs in ``rows``."""
    return listings.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def last_of_batch(batch: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One row per external id: within a batch the last write wins."""
    last = Window.partitionBy("external_id").orderBy(F.col(arrival).desc())
    return batch.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", arrival)


def upsert(listings: DataFrame, batch: DataFrame, now: Column, policy: str = "overwrite", first_id: Column | None = None) -> DataFrame:
    """Insert new external ids, overwrite the others but for identity; ``coalesce`` keeps old values where new are null.

    New rows are numbered after the largest id without gaps, bucket by bucket of their external ids' hash, so that no task
    numbers them all. A listing that is seen again is active.
    """
    return keyed_upsert(listings, batch, now, policy).drop(KEY)


def keyed_upsert(listings: DataFrame, batch: DataFrame, now: Column, policy: str = "overwrite") -> DataFrame:
    """``upsert`` with the key by which its rows are dealt out, so that what joins by it moves no whole row again.

    Rows of new ids stand among the listings, empty but for their number, before the batch meets them: whole rows of either
    side are dealt out once.
    """
    incoming = [c for c in batch.columns if c not in KEPT and c in listings.columns]
    top = listings.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("_top"))
    bucket = F.pmod(F.xxhash64("external_id"), F.lit(BUCKETS)).cast("int")
    fresh = batch.where("external_id IS NOT NULL").select("external_id").join(listings.select("external_id"), "external_id", "left_anti").withColumn("_bucket", bucket)
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    starts = fresh.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = fresh.withColumn("_at", F.row_number().over(Window.partitionBy("_bucket").orderBy("external_id")))
    numbered = within.join(F.broadcast(starts), "_bucket").join(F.broadcast(top)).select("external_id", (F.col("_top") + F.col("_start") + F.col("_at")).alias("id"))
    # What comes without an external id meets nothing, and is a row of its own without a number.
    nameless = batch.where("external_id IS NULL").select("external_id", "source", *incoming)
    if "is_active" in listings.columns:
        nameless = nameless.withColumn("is_active", F.lit(True))
    whole = listings.unionByName(numbered, allowMissingColumns=True).unionByName(nameless, allowMissingColumns=True)
    whole = whole.withColumn(KEY, F.coalesce("external_id", F.concat(F.lit("\0"), F.col("id").cast("string"))))
    new = batch.where("external_id IS NOT NULL").select(F.col("external_id").alias(KEY), F.col("source").alias("_source"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in incoming])
    joined = whole.join(new, KEY, "left")
    arrived = F.coalesce("_new", F.lit(False))
    value = {c: F.when(arrived, F.col(f"_{c}") if policy == "overwrite" else F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in incoming}
    value |= {"source": F.coalesce("source", "_source"), "created_at": F.coalesce("created_at", now), "is_active": F.when(arrived, F.lit(True)).otherwise(F.col("is_active"))}
    return joined.select(KEY, *[value[c].alias(c) if c in value else F.col(c) for c in listings.columns])


def batch_counts(listings: DataFrame, batch: DataFrame) -> DataFrame:
    known = batch.select("external_id").distinct().join(listings.select("external_id", F.lit(True).alias("old")), "external_id", "left")
    return known.agg(F.count_if(F.col("old").isNull()).alias("new_rows"), F.count_if("old").alias("updated_rows"))


def was_enriched() -> Column:
    detail = ["description", "seller_name", "seller_phone", "floor", "energy_rating", "condition", "construction", "furnishing", "ownership"]
    found = F.size("image_urls") > 1
    for c in detail:
        found = found | F.col(c).isNotNull()
    return found


def stamped_enriched(listings: DataFrame, now: Column) -> DataFrame:
    return listings.withColumn("enriched_at", F.when(was_enriched(), now).otherwise(F.col("enriched_at")))


def backfilled_enriched(listings: DataFrame) -> DataFrame:
    return listings.withColumn("enriched_at", F.when(F.col("enriched_at").isNull() & was_enriched(), F.col("scraped_at")).otherwise(F.col("enriched_at")))


def deactivate_missing(listings: DataFrame, source: str, seen: DataFrame, now: Column) -> DataFrame:
    """After a full scan: what the scan of a source missed goes inactive, without a reason. An empty scan changes nothing."""
    if seen.isEmpty():
        return listings
    flagged = marked(listings, seen, "_seen")
    gone = (F.col("source") == source) & F.col("is_active") & ~F.col("_seen")
    return flagged.withColumns({"is_active": F.when(gone, F.lit(False)).otherwise(F.col("is_active")), "deactivated_at": F.when(gone, now).otherwise(F.col("deactivated_at"))}).select(*listings.columns)


def expire(listings: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    old = F.coalesce(F.col("is_active") & (F.col("scraped_at") <= ago(now, days)), F.lit(False))
    return listings.withColumns({"is_active": F.when(old, F.lit(False)).otherwise(F.col("is_active")), "deactivated_at": F.when(old, now).otherwise(F.col("deactivated_at")), "deactivation_reason": F.when(old, F.lit("ttl")).otherwise(F.col("deactivation_reason"))})


def apply_verdicts(listings: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Liveness verdicts (id, verdict, reason): dead goes inactive, alive comes back if a recent verdict took it, all are stamped."""
    joined = listings.join(verdicts.select("id", "verdict", "reason"), "id", "left")
    dead = F.coalesce(F.col("is_active") & (F.col("verdict") == "dead"), F.lit(False))
    back = F.coalesce((F.col("verdict") == "alive") & ~F.col("is_active") & F.col("deactivation_reason").ilike("liveness\\_%") & (F.col("deactivated_at") >= ago(now, REACTIVATE_DAYS)), F.lit(False))
    null = F.lit(None)
    return joined.withColumns({
        "is_active": F.when(dead, F.lit(False)).when(back, F.lit(True)).otherwise(F.col("is_active")),
        "deactivated_at": F.when(dead, now).when(back, null).otherwise(F.col("deactivated_at")),
        "deactivation_reason": F.when(dead, F.concat(F.lit("liveness_"), F.col("reason"))).when(back, null).otherwise(F.col("deactivation_reason")),
        "last_checked_at": F.when(F.col("verdict").isNotNull(), now).otherwise(F.col("last_checked_at")),
    }).select(*listings.columns)


#: Fixed values by source: where a redirect leads that means the listing lives on, and phrases of a page that was taken down.
ALIVE_AT = {"sreality": "sreality.cz/detail/", "idnes": "/detail/", "bezrealitky": "/nemovitosti-byty-domy/"}
TAKEN_DOWN = {"idnes": ("tato nabídka již není", "tato nabidka jiz neni", "inzerát byl ukončen", "inzerat byl ukoncen", "nabídka byla ukončena")}
LOGIN, RETURN = "login.szn.cz/", "return_url"
SEARCHES, FRONT = ("/hledani/", "/vyhledavani/"), ("sreality.cz", "sreality.cz/")


def verdict(source: Column, status: Column, location: Column, body: Column) -> Column:
    """What an answer says of a listing, by source: ``alive``, ``dead``, or ``unknown``, which changes nothing.

    Gone is dead, a page is alive unless it carries a phrase of removal. A redirect to a detail page is alive. Elsewhere it
    is dead for two sources; for one with a sign-on, the address to return to decides, the front page and searches are dead
    and all others unknown; for sources without rules of their own redirects are unknown. So is all else.
    """
    to, text = F.lower(F.coalesce(location, F.lit(""))), F.coalesce(body, F.lit(""))
    anywhere = lambda c, parts: reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts], F.lit(False))
    removed = reduce(lambda a, b: a | b, [(source == s) & anywhere(text, phrases) for s, phrases in TAKEN_DOWN.items()])
    back = F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(location, F.lit("QUERY"), F.lit(RETURN))), F.lit("")))
    signed_on = F.when(F.try_parse_url(location, F.lit("HOST")).isNull(), "unknown").when(F.contains(back, F.lit(ALIVE_AT["sreality"])), "alive").otherwise("dead")
    outside = reduce(lambda a, b: a | b, [F.endswith(to, F.lit(x)) for x in FRONT], anywhere(to, SEARCHES))
    sign_on = F.when(F.contains(to, F.lit(LOGIN)) & F.contains(to, F.lit(RETURN + "=")), signed_on).when(outside, "dead").otherwise("unknown")
    moved = F.lit("unknown")
    for name, path in ALIVE_AT.items():
        moved = F.when(source == name, F.when(F.contains(to, F.lit(path)), "alive").otherwise(sign_on if name == "sreality" else F.lit("dead"))).otherwise(moved)
    gone, page = status.isin(404, 410), status.between(200, 299)
    return F.when(gone, "dead").when(status.isin(301, 302), moved).when(page, F.when(F.coalesce(removed, F.lit(False)), "dead").otherwise("alive")).otherwise("unknown")


def stamped_checked(listings: DataFrame, ids: DataFrame, now: Column, stamp: str = "last_image_checked_at", flag: str | None = None) -> DataFrame:
    """A check of these ids was made, whatever it found, so that the queue moves on.

    ``flag`` names a column that says which rows were stamped; a stamp of old may be of this very moment.
    """
    name = flag or "_checked"
    return marked(listings, ids, name, "id").withColumn(stamp, F.when(F.col(name), now).otherwise(F.col(stamp))).select(*listings.columns, *[flag] * bool(flag))


def queue(listings: DataFrame, stamp: str, per_source: int, nulls: str = "first") -> DataFrame:
    """Per source the listings longest unchecked; those never checked come first (or last)."""
    c = F.col(stamp)
    oldest = Window.partitionBy("source").orderBy(c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last(), F.col("id"))
    return listings.where(F.col("is_active")).withColumn("position", F.row_number().over(oldest)).where(F.col("position") <= per_source).select("source", "id", "position")


def reenrich_queue(listings: DataFrame, now: Column, per_source: int, days: int = REENRICH_DAYS) -> DataFrame:
    return queue(listings.where(F.col("enriched_at") <= ago(now, days)), "enriched_at", per_source)


def known_split(listings: DataFrame, page: DataFrame) -> DataFrame:
    return marked(page, listings, "known").groupBy("known").agg(F.count("*").alias("n"))


def enrichment_done(listings: DataFrame, now: Column, days: int = GIVE_UP_DAYS) -> DataFrame:
    return listings.where(F.col("enriched_at").isNotNull() | (F.col("created_at") <= ago(now, days))).select("external_id")


def recently_enriched(listings: DataFrame, now: Column, hours: int, days: int = GIVE_UP_DAYS) -> DataFrame:
    given_up = F.col("enriched_at").isNull() & (F.col("created_at") <= ago(now, days))
    return listings.where((F.col("enriched_at") >= ago(now, 0, hours)) | given_up).select("external_id")


def recently_scraped(listings: DataFrame, now: Column, hours: int) -> DataFrame:
    return listings.where(F.col("scraped_at") >= ago(now, 0, hours)).select("external_id")


def cleaned(rows: DataFrame) -> DataFrame:
    """What ingest does to raw fields: no negative prices, no places outside the country, no half coordinates."""
    inside = F.col("latitude").between(48.5, 51.1) & F.col("longitude").between(12.0, 18.9)
    return rows.withColumns({
        "price": F.when(F.col("price") >= 0, F.col("price")),
        "latitude": F.when(inside, F.col("latitude")), "longitude": F.when(inside, F.col("longitude")),
        "city": F.when(~F.coalesce(F.lower(F.trim("city")).isin(*FOREIGN), F.lit(False)), F.col("city")),
    })


def fixed_thumbnails(listings: DataFrame) -> DataFrame:
    """Protocol-relative thumbnails: the first image where it has a protocol, else with one added."""
    first, relative = F.get("image_urls", F.lit(0)), F.col("thumbnail_url").startswith("//")
    return listings.withColumn("thumbnail_url", F.when(relative & F.coalesce(first.startswith("http"), F.lit(False)), first).when(relative, F.concat(F.lit("https:"), F.col("thumbnail_url"))).otherwise(F.col("thumbnail_url")))


def fixed_sizes(rows: DataFrame, parsed: Column, largest: int = 3000) -> DataFrame:
    """Sizes that swallowed the layout's digit: stored and parsed differ by whole thousands up to nine."""
    diff = F.col("size_m2") - parsed
    wrong = (parsed > 0) & (parsed <= largest) & diff.between(1000, 9000) & (F.pmod(diff, F.lit(1000.0)) == 0)
    return rows.withColumn("fixed_size", F.when(wrong, parsed).otherwise(F.col("size_m2")))


def fixed_districts(rows: DataFrame) -> DataFrame:
    """A city that reads ``okres X`` is the district X."""
    okres = r"(?iu)^okres\s+"
    is_district = F.coalesce(F.col("city").rlike(okres), F.lit(False))
    return rows.withColumns({"district": F.when(is_district, F.regexp_replace("city", okres, "")).otherwise(F.col("district")), "city": F.when(~is_district, F.col("city"))})
