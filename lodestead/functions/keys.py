"""Byte-stable keys: match hashes, cluster keys, addresses, grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, scale: int) -> Column:
    """Decimal rounded half away from zero. Two casts: the inner one drops the binary tail of a double."""
    return x.cast("decimal(18,12)" if scale > 2 else "decimal(30,12)").cast(f"decimal(18,{scale})")


def match_hash(prefix: str = "") -> Column:
    """Key of items that agree in deal, place to 4 decimals, size to 2 and price to 0; null where one is missing."""
    c = lambda x: F.col(prefix + x)
    text = F.concat(F.lit("geo|"), c("transaction_type"), F.lit("|"), fixed(c("latitude"), 4).cast("string"), F.lit("|"), fixed(c("longitude"), 4).cast("string"), F.lit("|"), fixed(c("size_m2"), 2).cast("string"), F.lit("|"), fixed(c("price"), 0).cast("string"))
    return F.md5(text.cast("binary"))


def match_hash_no_price(prefix: str = "") -> Column:
    """The same without price, for items that have none; a size of 0 counts as missing."""
    c = lambda x: F.col(prefix + x)
    text = F.concat(F.lit("geo-np|"), c("transaction_type"), F.lit("|"), fixed(c("latitude"), 4).cast("string"), F.lit("|"), fixed(c("longitude"), 4).cast("string"), F.lit("|"), fixed(c("size_m2"), 2).cast("string"))
    return F.when(c("price").isNull() & (c("size_m2") > 0), F.md5(text.cast("binary")))


def effective_hash(prefix: str = "") -> Column:
    return F.coalesce(match_hash(prefix), match_hash_no_price(prefix))


def cluster_key(cluster: str = "cluster_id", id_: str = "id") -> Column:
    return F.coalesce(F.concat(F.lit("cluster:"), F.col(cluster)), F.concat(F.lit("singleton:"), F.col(id_).cast("string")))


def canonical_email(email: Column) -> Column:
    """One form per mailbox; null where the address is malformed."""
    whole = F.lower(F.trim(email))
    local, domain = F.split_part(whole, F.lit("@"), F.lit(1)), F.split_part(whole, F.lit("@"), F.lit(2))
    local = F.split_part(local, F.lit("+"), F.lit(1))
    domain = F.when(domain == "googlemail.com", "gmail.com").otherwise(domain)
    local = F.when(domain == "gmail.com", F.replace(local, F.lit("."), F.lit(""))).otherwise(local)
    single = F.length(whole) - F.length(F.replace(whole, F.lit("@"), F.lit(""))) == 1
    return F.when(single & (local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))


def looks_like_email(x: Column) -> Column:
    return x.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def cell(x: Column, precision: int) -> Column:
    return fixed(x, precision).cast("double")
