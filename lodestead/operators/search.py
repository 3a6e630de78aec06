"""Filtered, sorted and paginated search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import EXACT_FILTERS, PROPERTY_TYPES, SORTS, TRANSACTION_TYPES

Filters = dict[str, object]
CORNERS = ("sw_lat", "sw_lng", "ne_lat", "ne_lng")
RANGES = {"price_min": "price", "price_max": "price", "size_min": "size_m2", "size_max": "size_m2"}


def values(csv: str) -> list[str]:
    """Items of a comma-separated value; empty ones drop, nothing is trimmed."""
    return [v for v in csv.split(",") if v]


def number(raw: object) -> float | None:
    """A numeric parameter; anything else counts as absent."""
    try:
        x = float(raw)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return None if x != x else x


def flag(raw: object) -> bool:
    return str(raw).lower() in ("true", "1")


def free_text(raw: str, longest: int = 200) -> str:
    return raw.strip()[:longest]


def validated(filters: Filters) -> Filters:
    """Raise where an enumerated parameter holds something unknown; items are trimmed for the test only."""
    for name, known in (("property_type", PROPERTY_TYPES), ("transaction_type", TRANSACTION_TYPES), ("sort", SORTS)):
        if wrong := [v for v in str(filters.get(name) or "").split(",") if v.strip() and v.strip() not in known]:
            raise ValueError(f"{name}: {wrong[0]!r} is none of {', '.join(known)}")
    return filters


def has_content_filters(filters: Filters) -> bool:
    return any(filters.get(k) for k in filters if k not in (*CORNERS, "sort", "page", "per_page", "zoom"))


def visible() -> Column:
    return F.col("is_active") & F.col("is_canonical")


def location(place: str) -> Column:
    place = place.strip()
    same = [F.col(c) == place for c in ("city", "district", "region")]
    return reduce(lambda a, b: a | b, [*same, F.col("city").ilike(place + "%"), F.col("district").ilike(place + "%")])


def location_anywhere(place: str) -> Column:
    """The older form: part of any of four columns."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{place}%") for c in ("city", "district", "region", "address")])


def inside(sw_lat: float, sw_lng: float, ne_lat: float, ne_lng: float) -> Column:
    return F.col("latitude").between(sw_lat, ne_lat) & F.col("longitude").between(sw_lng, ne_lng)


def conditions(filters: Filters, include_inactive: bool = False) -> list[Column]:
    """The predicates of a filter object; all hold. They are plain columns, so they reach the scan."""
    out = [] if include_inactive else [visible()]
    for name in EXACT_FILTERS:
        if wanted := values(str(filters.get(name) or "")):
            out.append(F.col(name).isin(wanted) if len(wanted) > 1 else F.col(name) == wanted[0])
    for column, low, high in (("price", "price_min", "price_max"), ("size_m2", "size_min", "size_max")):
        if (x := number(filters.get(low))) is not None:
            out.append(F.col(column) >= x)
        if (x := number(filters.get(high))) is not None:
            out.append(F.col(column) <= x)
    out += [F.col("amenities").ilike(f"%{a.strip()}%") for a in str(filters.get("amenities") or "").split(",") if filters.get("amenities")]
    box = [number(filters.get(k)) for k in CORNERS]
    if None not in box:
        out.append(inside(*box))  # type: ignore[arg-type]
    elif filters.get("location"):
        out.append(location(str(filters["location"])))
    if flag(filters.get("has_thumbnail")):
        out.append(F.col("thumbnail_url").isNotNull() & F.col("thumbnail_url").startswith("http"))
    return out


def matching(listings: DataFrame, filters: Filters, include_inactive: bool = False) -> DataFrame:
    found = conditions(filters, include_inactive)
    return listings.where(reduce(lambda a, b: a & b, found)) if found else listings


def order(sort: str = "newest", nulls: str = "stored") -> list[Column]:
    """``stored``: nulls first in descending order, last in ascending; ``memory``: always last. Ties by id."""
    column, down = {"newest": ("listed_at", True), "price_asc": ("price", False), "price_desc": ("price", True), "size_asc": ("size_m2", False), "size_desc": ("size_m2", True)}[sort]
    c = F.col(column)
    if down:
        first = c.desc_nulls_last() if nulls == "memory" else c.desc_nulls_first()
    else:
        first = c.asc_nulls_last()
    return [first, F.col("id").asc()]


def paging(page: object = 1, per_page: object = 20) -> tuple[int, int]:
    """(offset, limit): pages from 1, at most 100 rows each."""
    size = min(100, max(1, int(number(per_page) or 20)))
    return (max(1, int(number(page) or 1)) - 1) * size, size


def search(listings: DataFrame, filters: Filters | None = None, sort: str = "newest", page: int = 1, per_page: int = 20, include_inactive: bool = False) -> DataFrame:
    """One page; sort and limit become a top-k, so no full sort runs."""
    offset, limit = paging(page, per_page)
    found = matching(listings, filters or {}, include_inactive).orderBy(*order(sort))
    return found.offset(offset).limit(limit) if offset else found.limit(limit)


def capped_count(listings: DataFrame, filters: Filters, cap: int = 100_000) -> DataFrame:
    """Count of matches up to a cap: scanning stops there."""
    return matching(listings, filters).select(F.lit(1).alias("one")).limit(cap).agg(F.count("*").alias("total"))


def total_pages(counted: DataFrame, per_page: int = 20) -> DataFrame:
    return counted.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long"))


def page_total(rows_on_page: int, offset: int, per_page: int, counted: int | None) -> int:
    """A page that is not full tells the total; a count that timed out is estimated."""
    if rows_on_page < per_page:
        return offset + rows_on_page
    return counted if counted is not None else max(10_000, offset + rows_on_page + per_page)


def card(listings: DataFrame) -> DataFrame:
    """The columns of a card on the map or in a list."""
    return listings.select("id", "title", "price", "currency", "property_type", "transaction_type", "latitude", "longitude", "size_m2", "layout", "city", F.coalesce("address", "city").alias("address"), "thumbnail_url", "source", "source_url", "listed_at")


def detail(listings: DataFrame, id_: int) -> DataFrame:
    return listings.where(F.col("id") == id_).limit(1)


def preview(listings: DataFrame, ids: list[int]) -> DataFrame:
    return listings.where(F.col("id").isin(ids)).select("id", "title", "thumbnail_url")


def with_defaults(listings: DataFrame) -> DataFrame:
    """Read-side defaults of nullable columns."""
    return listings.withColumns({"currency": F.coalesce("currency", F.lit("CZK")), "image_urls": F.coalesce("image_urls", F.array().cast("array<string>")), "is_active": F.coalesce("is_active", F.lit(True)), "is_canonical": F.coalesce("is_canonical", F.lit(True))})
