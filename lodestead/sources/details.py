"""Detail pages and detail documents of sources to listing fields, and listing rows to and from ingest records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.extract import layout, part
from ..operators.lifecycle import cleaned
from . import blocks as B

# -- definition lists of a detail page

#: How the labels of a page's definition list begin, for each field.
LABELS = {
    "size_m2": ("plocha užitná", "plocha uzitna"), "floor": ("patro",), "total_floors": ("podlaží v budově", "počet podlaží", "celkem podlaží"), "energy_rating": ("třída en",),
    "ownership": ("vlastnictví", "vlastnict"), "construction": ("konstrukce",), "condition": ("stav objektu", "stav nemovitosti"), "furnishing": ("vybaven",),
}
#: Labels that are a field's as a whole, and those that only contain a word.
WHOLE = {"floor": ("podlaží",), "condition": ("stav",)}
CONTAINED = {"energy_rating": ("energetick",)}


def _labelled(pairs: Column, field: str, value) -> Column:
    """What ``value`` makes of the field's pairs: of the last one of which it makes anything."""

    def mine(p):
        label = p["label"]
        tests = [label.startswith(x) for x in LABELS[field]] + [label == x for x in WHOLE.get(field, ())] + [F.contains(label, F.lit(x)) for x in CONTAINED.get(field, ())]
        return reduce(lambda a, b: a | b, tests)

    return F.try_element_at(F.array_compact(F.transform(F.filter(pairs, mine), lambda p: value(p["value"]))), F.lit(-1))


def definition_pairs(page: Column) -> Column:
    """(label in small letters without its colon, value) of each list of one pair below ``box-params``; empty ones are left out."""
    boxes = B.select(page, B.has_class("box-params"))
    lists = B.select(page, B.is_tag("dl"), boxes)

    def pair(n):
        inside = lambda tag: B.first(F.filter(page["nodes"], lambda m: (m["at"] > n["at"]) & (m["at"] <= n["last"]) & (m["tag"] == tag)))
        label = N.trimmed(F.regexp_replace(F.lower(B.text(page, inside("dt"))), ":$", ""))
        return F.struct(label.alias("label"), B.text(page, inside("dd")).alias("value"))

    return F.filter(F.transform(lists, pair), lambda p: (p["label"] != "") & (p["value"] != ""))


def _size(value: Column) -> Column:
    x = F.regexp_replace(part(value, r"(?i)(\d+[.,]?\d*)\s*m"), ",", ".").try_cast("double")
    return F.when(x.between(5, 5000), x)


def _furnished(value: Column) -> Column:
    low = F.lower(value)
    return F.when((low == "ano") | low.startswith("plně"), "furnished").when(low.startswith("částečně") | low.startswith("castecne"), "partially").when(low.isin("ne", "nezařízeno"), "unfurnished")


def pictures(page: Column) -> Column:
    """Addresses of a gallery's pictures, then of the picture files that it links to, each once."""
    gallery = B.select(page, B.has_class("property-detail__gallery"))
    whole = lambda x: F.when(x.startswith("//"), F.concat(F.lit("https:"), x)).otherwise(x)
    inside = lambda n: F.exists(gallery, lambda a: (n["at"] > a["at"]) & (n["at"] <= a["last"]))
    below = lambda tag, name: B.select(page, lambda n: (n["tag"] == tag) & (inside(n) | B.has_class(name)(n)))
    shown = F.transform(below("img", "property-detail__gallery__image"), lambda n: whole(B.attribute(n, "src", "data-src")))
    linked = F.filter(F.transform(below("a", "property-detail__gallery__link"), lambda n: whole(B.attribute(n, "href"))), lambda x: x.rlike(r"(?i)\.(jpg|jpeg|png|webp)"))
    return F.array_distinct(F.array_compact(F.concat(shown, linked)))


def page_details(rows: DataFrame, html: str = "html") -> DataFrame:
    """The rows with a struct ``detail`` of the listing fields that their detail page gives; null where it says nothing."""
    page = F.col("_page")
    pairs = F.col("_pairs")
    boxes = B.select(page, B.has_class("box-desc"))
    says = lambda name: lambda n: F.try_element_at(n["attrs"], F.lit(name)) == "description"
    marked = [B.first(B.select(page, says(name), boxes)) for name in ("temprop", "itemprop")]
    described = F.coalesce(*marked, B.first(B.select(page, B.is_tag("p"), boxes)))
    lists = B.select(page, B.has_class("property-detail__amenities", "property-detail__features", "property-detail__equipment"))
    items = F.filter(F.transform(B.select(page, B.is_tag("li"), lists), lambda n: B.text(page, n)), lambda x: x != "")
    contact = F.slice(B.select(page, B.has_class("property-detail__contact", "property-detail__seller")), 1, 1)
    inside = lambda test: F.nullif(B.text(page, B.first(B.select(page, test, contact))), F.lit(""))
    linked = lambda scheme: lambda n: (n["tag"] == "a") & F.coalesce(B.attribute(n, "href").startswith(scheme), F.lit(False))
    number = lambda v: part(v, r"(\d+)").try_cast("int")
    whole = lambda v: v
    fields = {
        "description": F.nullif(B.text(page, described), F.lit("")), "image_urls": pictures(page),
        "size_m2": _labelled(pairs, "size_m2", _size), "floor": _labelled(pairs, "floor", number), "total_floors": _labelled(pairs, "total_floors", number),
        "energy_rating": _labelled(pairs, "energy_rating", lambda v: F.upper(part(v, r"(?i)^([A-G])(?![\p{L}\p{N}_])"))),
        "ownership": _labelled(pairs, "ownership", whole), "construction": _labelled(pairs, "construction", whole), "condition": _labelled(pairs, "condition", whole), "furnishing": _labelled(pairs, "furnishing", _furnished),
        "amenities": N.amenities(F.when(F.size(items) > 0, F.to_json(items))),
        "seller_name": inside(lambda n: B.has_class("property-detail__contact__name")(n) | n["tag"].isin("h3", "strong")), "seller_phone": inside(linked("tel:")), "seller_email": inside(linked("mailto:")),
        "seller_company": inside(B.has_class("property-detail__contact__company", "company-name")),
    }
    read = rows.withColumn("_page", B.tree(F.col(html))).withColumn("_pairs", definition_pairs(page))
    detail = F.struct(*[c.alias(n) for n, c in fields.items()], F.get(fields["image_urls"], F.lit(0)).alias("thumbnail_url"), F.map_from_arrays(F.transform(_last_of(pairs, "label"), lambda p: p["label"]), F.transform(_last_of(pairs, "label"), lambda p: p["value"])).alias("params"))
    return read.withColumn("detail", detail).drop("_page", "_pairs")


def _last_of(pairs: Column, key: str) -> Column:
    """The pairs without those that a later pair of the same key overrides."""
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q[key] == p[key]))


# -- linked data

OFFER = "struct<name:string,url:string,price:double,currency:string,seller:string,kind:string>"


def linked_data(html: Column) -> Column:
    """The JSON-LD blocks of a page as variants; what is not JSON is passed over."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    return F.filter(F.transform(found, F.try_parse_json), lambda v: v.isNotNull())


def _kind(v: Column) -> Column:
    return F.try_variant_get(v, '$["@type"]', "string")


def _offers_of(v: Column) -> Column:
    """The offers of a listing block as an array, be it an array or an object."""
    whole = F.try_variant_get(v, "$.offers", "variant")
    return F.coalesce(F.try_variant_get(v, "$.offers", "array<variant>"), F.when(whole.isNotNull() & ~F.coalesce(F.is_variant_null(whole), F.lit(False)), F.array(whole)), F.array().cast("array<variant>"))


def _offer(v: Column) -> Column:
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    return F.struct(get("$.name").alias("name"), get("$.url").alias("url"), get("$.price", "double").alias("price"), get("$.priceCurrency").alias("currency"), F.coalesce(get("$.offeredBy.name"), get("$.offeredBy[0].name")).alias("seller"), _kind(v).alias("kind"))


def offers(html: Column) -> Column:
    """All offers of a list page: those of listing blocks that are arrays, and blocks that are offers themselves."""
    none = F.array().cast("array<variant>")
    many = F.flatten(F.transform(linked_data(html), lambda v: F.when(_kind(v) == "RealEstateListing", F.coalesce(F.try_variant_get(v, "$.offers", "array<variant>"), none)).when(_kind(v).isin("OfferForPurchase", "OfferForLease"), F.array(v)).otherwise(none)))
    return F.transform(many, _offer)


def detail_offer(html: Column) -> Column:
    """The offer of a detail page: the first block that is one, or the first offer of a listing block."""
    one = F.transform(linked_data(html), lambda v: F.when(_kind(v).isin("OfferForPurchase", "OfferForLease", "Offer"), v).when(_kind(v) == "RealEstateListing", F.get(_offers_of(v), F.lit(0))))
    found = F.filter(one, lambda v: v.isNotNull())
    return F.get(F.transform(found, _offer), F.lit(0))


# -- detail documents with nested items

#: Names of a detail document's items that become fields, and those that are known from the list.
ITEMS = {"construction": ("Stavba",), "condition": ("Stav objektu",), "ownership": ("Vlastnictví",), "floor": ("Podlaží", "Podlaží z celku"), "size_m2": ("Užitná plocha", "Plocha"), "energy_rating": ("Energetická náročnost budovy",), "furnishing": ("Vybavení",), "layout": ("Dispozice",)}
KNOWN = ("Celková cena", "Cena")
CDN = "https://cdn.sreality.cz"


def _shape(v: Column) -> Column:
    return F.schema_of_variant(v)


def _plain(v: Column) -> Column:
    """A scalar as text; the value of an object that has one; null for other objects."""
    return F.coalesce(F.try_variant_get(v, "$.value", "string"), F.when(~_shape(v).rlike("^(OBJECT|ARRAY)"), v.try_cast("string")))


def _counted(v: Column) -> Column:
    """What counts of an item's value, which is a scalar, an object with a value, or an array of either, whose first one counts.

    A path leads nowhere in values of other kinds, so none is asked for its kind.
    """
    held = F.coalesce(F.try_variant_get(v, "$.value", "variant"), v)  # the object's own value may be an array again
    return F.coalesce(F.try_variant_get(held, "$[0]", "variant"), held)


def items(document: Column) -> Column:
    """(name, value) of a document's items; those whose value is missing or null are left out."""
    all_items = F.coalesce(F.try_variant_get(document, "$.items", "array<variant>"), F.array().cast("array<variant>"))
    told = F.filter(F.transform(all_items, lambda i: F.struct(N.trimmed(F.coalesce(F.try_variant_get(i, "$.name", "string"), F.lit(""))).alias("name"), F.try_variant_get(i, "$.value", "variant").alias("v"))), lambda p: p["v"].isNotNull() & ~F.is_variant_null(p["v"]))
    counted = F.transform(told, lambda p: F.struct(p["name"].alias("name"), _counted(p["v"]).alias("v")))
    return F.transform(counted, lambda p: F.struct(p["name"].alias("name"), F.coalesce(N.trimmed(_plain(p["v"])), F.lit("")).alias("value")))


def document_details(rows: DataFrame, json: str = "json") -> DataFrame:
    """The rows with a struct ``detail`` of the fields of a nested detail document, and a map of what no field takes.

    Documents that are not JSON give nulls.
    """
    doc, pairs = F.col("_doc"), F.col("_items")
    get = lambda path, kind="string": F.try_variant_get(doc, path, kind)

    def item(field, value=lambda v: v):
        return F.try_element_at(F.array_compact(F.transform(F.filter(pairs, lambda p: p["name"].isin(*ITEMS[field])), lambda p: value(p["value"]))), F.lit(-1))

    def grade(v):
        return F.coalesce(F.upper(part(v, r"(?iu)T[řr][íi]da\s+([A-G])")), F.upper(part(v, r"(?i)^([A-G])$")), v)

    images = F.coalesce(get("$._embedded.images", "array<variant>"), F.array().cast("array<variant>"))
    hrefs = F.filter(F.transform(images, lambda v: F.try_variant_get(v, "$.href", "string")), lambda h: h != "")
    urls = F.transform(hrefs, lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(CDN), h)))
    seller = "$._embedded.seller"
    phone = F.when(_shape(get(f"{seller}.phones[0]", "variant")).startswith("OBJECT"), F.coalesce(get(f"{seller}.phones[0].number"), get(f"{seller}.phones[0].code"))).otherwise(get(f"{seller}.phones[0]"))
    used = [*KNOWN, *(n for names in ITEMS.values() for n in names)]
    rest = F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != "") & ~p["name"].isin(*used))
    fields = {
        "title": F.nullif(get("$.name.value"), F.lit("")), "description": get("$.text.value"), "address": F.nullif(get("$.locality.value"), F.lit("")),
        "latitude": get("$.map.lat", "double"), "longitude": get("$.map.lon", "double"), "image_urls": urls, "thumbnail_url": F.get(urls, F.lit(0)),
        "seller_name": get(f"{seller}.user_name"), "seller_phone": phone, "seller_email": get(f"{seller}.email"),
        "seller_company": F.coalesce(F.nullif(get(f"{seller}.company_name"), F.lit("")), get(f"{seller}._embedded.premise.name")),
        "construction": item("construction"), "condition": item("condition"), "ownership": item("ownership"), "furnishing": item("furnishing"),
        "floor": item("floor", lambda v: part(v, r"^(\d+)").try_cast("int")), "total_floors": item("floor", lambda v: part(v, r"z\s+(\d+)").try_cast("int")),
        "size_m2": item("size_m2", lambda v: part(v, r"(\d+(?:\.\d+)?)").try_cast("double")), "energy_rating": item("energy_rating", grade), "layout": item("layout", lambda v: F.coalesce(layout(v), v)),
        "additional_params": F.when(F.size(rest) > 0, F.map_from_entries(_last_of(rest, "name"))),
    }
    read = rows.withColumn("_doc", F.try_parse_json(F.col(json))).withColumn("_items", items(doc))
    return read.withColumn("detail", F.struct(*[c.alias(n) for n, c in fields.items()])).drop("_doc", "_items")


def enriched(listings: DataFrame, detail: Column) -> DataFrame:
    """Listings with the fields of a detail struct in place of their own, where it says something; a gallery replaces the thumbnail."""
    known = {f.name for f in listings.select(detail.alias("d")).schema["d"].dataType.fields}
    own = [n for n in known if n in listings.columns and n not in ("image_urls", "additional_params")]
    out = {n: F.coalesce(detail[n], F.col(n)) for n in own}
    if "image_urls" in known & set(listings.columns):
        out["image_urls"] = F.when(F.size(detail["image_urls"]) > 0, detail["image_urls"]).otherwise(F.col("image_urls"))
    return listings.withColumns(out)


# -- listing rows and ingest records


def to_record(listings: DataFrame, now: Column) -> DataFrame:
    """Rows as ingest records: arrays and maps as JSON, seen now, defaults in place."""
    return listings.withColumns({
        "image_urls": F.coalesce(F.to_json("image_urls"), F.lit("[]")), "additional_params": F.to_json("additional_params"),
        "currency": F.coalesce("currency", F.lit("CZK")), "is_active": F.coalesce("is_active", F.lit(True)), "scraped_at": now,
    })


def to_row(records: DataFrame) -> DataFrame:
    """Ingest records as rows: one vocabulary, JSON read (what is not JSON is no image and no parameter), values cleaned."""
    rules = {"condition": N.condition, "construction": N.construction, "ownership": N.ownership, "energy_rating": N.energy, "furnishing": N.furnishing, "layout": N.layout}
    urls = F.try_variant_get(F.try_parse_json("image_urls"), "$", "array<string>")
    params = F.try_variant_get(F.try_parse_json("additional_params"), "$", "map<string,string>")
    read = records.withColumns({"image_urls": F.coalesce(urls, F.array().cast("array<string>")), "additional_params": params} | {n: rule(F.col(n)) for n, rule in rules.items()})
    return cleaned(read)
