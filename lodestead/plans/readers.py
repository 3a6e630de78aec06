"""Landed pages and documents to listing fields, and rows to and from ingest records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import blocks as B
from ..sources import details as D
from ..sources.adapter import listings, now, pick, table
from .oracle import LISTINGS

#: Markup of a detail page, put behind each landed page; ``%1$d`` is the page's id.
DETAIL = (
    '<div class="wide box-params"><dl><dt>Evidenční číslo:</dt><dd>%1$d</dd></dl><dl><dt>Plocha sklepa:</dt><dd>3 m<sup>2</sup></dd></dl>'
    "<dl><dt>PLOCHA UŽITNÁ :</dt><dd> %1$d,5 m<sup>2</sup></dd></dl><dl><dt>Patro, podlaží:</dt><dd>%1$d. podlaží</dd></dl><dl><dt>Počet podlaží:</dt><dd>nad %1$d</dd></dl>"
    "<dl><dt>Stav:<dd>Po rekonstrukci</dl><dl><dt>Konstrukce:</dt><dd><b>Cihlová</b></dd></dl><dl><dt>Energetická náročnost:</dt><dd>b &ndash; velmi úsporná</dd></dl><dl><dt>Vybavení:</dt><dd>Plně vybaveno</dd></dl><dl><dt></dt><dd>nic</dd></dl></div>"
    '<div class="box-desc"><p>kratší</p><p itemprop="description">Nabídka &amp; popis <i>č. %1$d</i><br>dnes</p></div>'
    '<div class="property-detail__gallery"><a href="//img.example/%1$d.webp"><img data-src="//img.example/%1$d-s.png"></a><a href="/dalsi">x</a></div><ul class="property-detail__features"><li>Balkón</li><li> Sklep 4 m2</li><li></li></ul>'
    '<div class="property-detail__seller"><strong>Paní %1$d</strong><a href="mailto:a@b">a@b</a><a href="tel:%1$d">+420 %1$d</a><span class="company-name">Firma</span></div>'
)
AREA = "CASE WHEN page_id + 0.5 BETWEEN 5 AND 5000 THEN CAST(page_id + 0.5 AS DOUBLE) END"


def detail_pages(spark, sf):
    """Fields of the made markup behind every landed page, which holds none of them itself."""
    rows = table(spark, sf, "pages").withColumn("html", F.concat("html", F.format_string(DETAIL, "page_id")))
    d = F.col("detail")
    fields = [d[n].alias(n) for n in ("description", "size_m2", "floor", "total_floors", "energy_rating", "ownership", "construction", "condition", "furnishing", "amenities", "seller_name", "seller_phone", "seller_email", "seller_company", "thumbnail_url")]
    return D.page_details(rows).select("page_id", *fields, F.array_join(d["image_urls"], " ").alias("images"), F.try_element_at(d["params"], F.lit("evidenční číslo")).alias("number"), F.size(d["params"]).alias("n_params"))


def page_blocks(spark, sf):
    """Elements of the landed pages as they are."""
    page = F.col("page")
    rows = table(spark, sf, "pages").select("page_id", B.tree(F.col("html")).alias("page"))
    count = lambda test, within=None: F.size(B.select(page, test, within)).cast("long")
    return rows.select("page_id", count(B.is_tag("a")).alias("links"), count(B.is_tag("p")).alias("paragraphs"), count(B.is_tag("li"), B.select(page, B.is_tag("nav"))).alias("menu"), count(B.has_class("ad")).alias("adverts"), F.size(F.filter(page["nodes"], lambda n: n["tag"] == "script")).cast("long").alias("scripts"))


PLAIN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>).*?(</script>)', '\\1\\2', 'g')"
#: A detail document by the listing's id; some are not JSON.
DOCUMENT = """{"name": {"value": "Byt %1$d"}, "text": {"value": "Popis"}, "locality": {"value": ""}, "map": {"lat": 50.25, "lon": 14}, "_embedded": {"images": [{"href": "/i/%1$d"}, {}, {"href": "https://x.example/2"}],
 "seller": {"user_name": "Pan", "phones": [%2$s], "company_name": "", "_embedded": {"premise": {"name": "Kancelář"}}}},
 "items": [{"name": "Cena", "value": 1}, {"name": " Podlaží ", "value": "%1$d. z 80 podlaží"}, {"name": "Užitná plocha", "value": [{"value": "%1$d.5 m2"}, "9"]}, {"name": "Stavba", "value": {"value": "Cihlová"}}, {"name": "Vlastnictví", "value": null},
 {"name": "Energetická náročnost budovy", "value": {"value": ["Trida f - nehospodárná"]}}, {"name": "Dispozice", "value": "Byt 3+KK"}, {"name": "Výtah", "value": true}, {"name": "Sklep", "value": []}, {"name": "Parkování", "value": %1$d}, {"name": "Parkování", "value": "ano"}, {"value": "bez jména"}]}"""


def documents(spark, sf):
    i = F.col("id")
    phone = F.when(i % 3 == 0, F.lit('{"code": "420", "number": "77"}')).when(i % 3 == 1, F.lit('"66"')).otherwise(F.lit(""))
    raw = F.when(i % 10 == 9, F.lit('{"name": ')).otherwise(F.format_string(DOCUMENT, i, phone))
    d = F.col("detail")
    fields = [d[n].alias(n) for n in ("title", "description", "address", "latitude", "longitude", "thumbnail_url", "seller_name", "seller_phone", "seller_company", "construction", "ownership", "floor", "total_floors", "size_m2", "energy_rating", "layout")]
    found = D.document_details(listings(spark, sf).select("id", raw.alias("json")))
    return found.select("id", *fields, F.size(d["image_urls"]).alias("n_images"), F.array_join(F.array_sort(F.transform(F.map_entries(d["additional_params"]), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("rest"))


GOOD = "id % 10 <> 9"


def said(**values: str) -> str:
    return ", ".join(f"CASE WHEN {GOOD} THEN {v} END AS {n}" for n, v in values.items())


#: Linked data behind each landed page: an offer that stands alone, a list, something else, and what is not JSON.
LINKED = """<script type="application/ld+json">{"@type": "OfferForPurchase", "name": "A%1$d", "price": %1$d, "offeredBy": {"name": "N"}}</script>
<SCRIPT data-x="1" type = 'application/ld+json'>{"@type": "RealEstateListing", "offers": [{"name": "B", "price": "%1$d.5"}, {"name": "C", "priceCurrency": "CZK"}]}</SCRIPT>
<script type="application/ld+json">{"@type": "RealEstateListing", "offers": {"name": "D"}}</script><script type="application/ld+json">{"@type": "OfferForLease", </script><script type="application/ld+json">{"@type": "Person", "name": "E"}</script>"""


def offers(spark, sf):
    """Offers of the list page, and the one that the page as a detail page would be."""
    html = F.concat("html", F.format_string(LINKED, "page_id"))
    rows = table(spark, sf, "pages").select("page_id", html.alias("html"))
    many = rows.select("page_id", F.lit("list").alias("kind"), F.explode(D.offers(F.col("html"))).alias("o"))
    one = rows.select("page_id", F.lit("detail").alias("kind"), D.detail_offer(F.concat(F.lit('<script type="application/ld+json">[1]</script><script type="application/ld+json">{"@type": "RealEstateListing", "offers": {"name": "F"}}</script>'), "html")).alias("o"))
    return many.unionByName(one).select("page_id", "kind", "o.name", "o.price", "o.currency", "o.seller")


def records(spark, sf):
    rows = listings(spark, sf).withColumns({"additional_params": F.when(F.col("id") % 2 == 0, F.create_map(F.lit("a"), F.col("id").cast("string"))), "currency": F.nullif("currency", F.lit("CZK")), "is_active": F.when(F.col("is_active"), F.lit(None).cast("boolean")).otherwise(F.col("is_active"))})
    return D.to_record(rows, now())


def raw_records(spark, sf):
    """Records as a source gives them: its own words, JSON that may be broken, values out of bounds."""
    i = F.col("id")
    return records(spark, sf).withColumns({
        "condition": pick(["Novostavba", " velmi dobrý ", "po rekonstrukci", None, "zcela jiný"], i), "construction": pick(["Cihlová", "panel", "dřevostavba"], i), "ownership": pick(["Osobní", "družstevní", "obecní"], i),
        "energy_rating": pick(["Třída G - mimořádně nehospodárná", "c", "D_UD", "nezjištěno"], i), "furnishing": pick(["Ano", "částečně", "ne", "linka, skříň, stůl, postel"], i), "layout": pick(["Byt 3+KK", "garsonka", "atypický", None], i),
        "image_urls": F.when(i % 4 == 1, "[broken").when(i % 4 == 2, '{"a": 1}').otherwise(F.col("image_urls")), "additional_params": F.when(i % 6 == 0, "{").otherwise(F.col("additional_params")),
        "price": F.when(i % 7 == 0, -1.0).otherwise(F.col("price")), "latitude": F.when(i % 9 == 0, 40.0).otherwise(F.col("latitude")), "city": F.when(i % 11 == 0, " Rakousko ").otherwise(F.col("city")),
    })


def ingested(spark, sf):
    out = D.to_row(raw_records(spark, sf))
    return out.select("id", "condition", "construction", "ownership", "energy_rating", "furnishing", "layout", F.size("image_urls").alias("n_images"), F.try_element_at("additional_params", F.lit("a")).alias("a"), "price", F.col("latitude").isNotNull().alias("placed"), "city")




def by_id(*values: str | None) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[id % {len(values)} + 1]"


QUERIES = {
    "detail_pages": (detail_pages, f"""SELECT page_id, 'Nabídka & popis č. ' || page_id || 'dnes' AS description, {AREA} AS size_m2, CAST(page_id AS INTEGER) AS floor, CAST(page_id AS INTEGER) AS total_floors, 'B' AS energy_rating, NULL AS ownership, 'Cihlová' AS construction, 'Po rekonstrukci' AS condition,
 'furnished' AS furnishing, '["balcony","cellar"]' AS amenities, 'Paní ' || page_id AS seller_name, '+420 ' || page_id AS seller_phone, 'a@b' AS seller_email, 'Firma' AS seller_company, 'https://img.example/' || page_id || '-s.png' AS thumbnail_url, 'https://img.example/' || page_id || '-s.png https://img.example/' || page_id || '.webp' AS images,
 CAST(page_id AS VARCHAR) AS number, 9 AS n_params FROM pages"""),
    "page_blocks": (page_blocks, f"SELECT page_id, len(regexp_extract_all({PLAIN}, '<a[ >]')) AS links, len(regexp_extract_all({PLAIN}, '<p[ >]')) AS paragraphs, len(regexp_extract_all(array_to_string(regexp_extract_all({PLAIN}, '(?s)<nav[ >].*?</nav>'), ''), '<li[ >]')) AS menu, len(regexp_extract_all({PLAIN}, '<[a-z0-9]+ class=\"ad\"')) AS adverts, len(regexp_extract_all({PLAIN}, '<script[ >]')) AS scripts FROM pages"),
    "detail_documents": (documents, f"""{LISTINGS} SELECT id, {said(title="'Byt ' || id", description="'Popis'", address="NULL", latitude="CAST(50.25 AS DOUBLE)", longitude="CAST(14 AS DOUBLE)", thumbnail_url="'https://cdn.sreality.cz/i/' || id", seller_name="'Pan'",
 seller_phone="CASE id % 3 WHEN 0 THEN '77' WHEN 1 THEN '66' END", seller_company="'Kancelář'", construction="'Cihlová'", ownership="NULL", floor="CAST(id AS INTEGER)", total_floors="CAST(80 AS INTEGER)", size_m2="CAST(id + 0.5 AS DOUBLE)", energy_rating="'F'", layout="'3+kk'")},
 CASE WHEN {GOOD} THEN 2 ELSE 0 END AS n_images, CASE WHEN {GOOD} THEN 'Parkování=ano;Výtah=true' END AS rest FROM listings"""),
    "linked_offers": (offers, """WITH o AS (SELECT unnest([1, 2, 3, 4]) AS k) SELECT page_id, CASE WHEN k < 4 THEN 'list' ELSE 'detail' END AS kind, CASE k WHEN 1 THEN 'A' || page_id WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'F' END AS name,
 CASE k WHEN 1 THEN CAST(page_id AS DOUBLE) WHEN 2 THEN CAST(page_id + 0.5 AS DOUBLE) END AS price, CASE k WHEN 3 THEN 'CZK' END AS currency, CASE k WHEN 1 THEN 'N' END AS seller FROM pages, o"""),
    "ingest_records": (lambda spark, sf: records(spark, sf).select("id", "image_urls", "additional_params", "currency", "is_active", (F.col("scraped_at") == now()).alias("fresh")), f"""{LISTINGS} SELECT id, CASE n_images WHEN 0 THEN '[]' WHEN 1 THEN '["' || http || id || '/0"]' WHEN 2 THEN '["' || http || id || '/0","' || http || id || '/1"]' ELSE '["' || http || id || '/0","' || http || id || '/1","' || http || id || '/2"]' END AS image_urls,
 CASE WHEN id % 2 = 0 THEN '{{"a":"' || id || '"}}' END AS additional_params, currency, is_active, TRUE AS fresh FROM listings"""),
    "ingest_rows": (ingested, f"""{LISTINGS} SELECT id, {by_id("new", "very_good", "after_reconstruction", None, None)} AS condition, {by_id("brick", "panel", "wood")} AS construction, {by_id("personal", "cooperative", "state")} AS ownership,
 {by_id("G", "C", "D", None)} AS energy_rating, {by_id("furnished", "partially", "unfurnished", "furnished")} AS furnishing, {by_id("3+kk", "1+kk", "atypicky", None)} AS layout, CASE WHEN id % 4 IN (1, 2) THEN 0 ELSE n_images END AS n_images, CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN CAST(id AS VARCHAR) END AS a,
 CASE WHEN id % 7 <> 0 THEN price END AS price, coalesce(id % 9 <> 0 AND latitude BETWEEN 48.5 AND 51.1 AND longitude BETWEEN 12 AND 18.9, FALSE) AS placed, CASE WHEN id % 11 <> 0 THEN city END AS city FROM listings"""),
}
