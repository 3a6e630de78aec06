"""Scalar functions over listings, pages, documents and lists of raw values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import normalize as N
from ..functions import special
from ..functions import text as X
from ..sources.adapter import listings, table
from .oracle import LISTINGS

#: Raw values as sources write them; every listing gets one by its id.
RAW = {
    "condition": ["Novostavba", "VELMI DOBRÝ", "dobrý stav", "po rekonstrukci", "PŘED REKONSTRUKCÍ", "ve výstavbě", "projekt", "Špatný", "k demolici", "120 m²", "very-good", "BAD"],
    "construction": ["Cihlová", "zděná", "PANELOVÁ", "Dřevostavba", "skeletová", "montovaná", "SMÍŠENÁ", "kamenná", "modulární", "Ostatní", "jiná"],
    "ownership": ["Osobní", "DRUŽSTEVNÍ", "státní", "Obecní", "PRIVATE", "OTHER", "soukromé", "?"],
    "energy": ["Třída G - Mimořádně nehospodárná", "B_VERY_EFFICIENT", "c", "velmi úsporná a levná", "xyz", "TŘÍDA d"],
    "furnishing": ["Částečně", "zařízený", "NEZAŘÍZENÝ", "ano", "false", "linka, postel, stůl, skříň", "linka, Lednice", "poloprázdný", "plně vybavený"],
    "layout": ["2+KK", "Garsoniéra", "atypický", "Pokoj", "byt 3+1 s balkonem", "jiný", "5 a více"],
    "amenities": ["Balkón 2 m², Terasa 5 m²", "[\"sklep\",\"výtah\",\"Sklep\"]", "Osobní výtah, garážové stání", "nic", "pool, lift", "bezbariérový přístup,klimatizace"],
    "price": ["25 000 Kč", "Cena dohodou", "1 Kč", "120 000 €", "info v textu", "", "990 EUR / měsíc"],
    "place": ["Praha 2 - Vinohrady", "Lhota, okres Kolín", "Ulice 5, Brno", "okres Beroun", "Dolní 3, Plzeň 4 - Doubravka, okres Plzeň-město"],
    "date": ["[1.3.2024]", "vloženo 12. 11. 2023", "včera", "3.4.99"],
    "floor": ["3. podlaží z 8", "2/5", "přízemí", "10. z celkem 12", "-1. z 4"],
    "sizes": ["Prodej bytu 4+1 118 m²", "pozemek 18 363 m², dům", "2+1,56 m²", "84,7 m2", "bez výměry", "sklad 100000 m²"],
}
DESCRIPTIONS = ["Byt v osobním vlastnictví, před rekonstrukcí, v panelovém domě. Nachází se ve 2. patře, dům má 8 podlaží.", "Družstevní byt po kompletní rekonstrukci, PENB: B. Cihlový dům, 3. NP.", "Novostavba, energetická třída: Třída C, plně vybavený, 12podlažní dům", "Státní vlastnictví. Částečně vybaven. Velmi dobrý stav.", "Prodej 2+1 OV, po rekonstrukci, ve 4. patře", "dům ov, družstevní 3+1 u parku, OVčárna"]


def raw(spark, sf, kind, *also):
    values = F.array(*map(F.lit, RAW[kind]))
    return listings(spark, sf).select("id", F.get(values, (F.col("id") % len(RAW[kind])).cast("int")).alias("raw"), *also)


def mapped(kind, **columns):
    """A function of the raw values, for every listing."""
    return lambda spark, sf: raw(spark, sf, kind).select("id", *[f(F.col("raw")).alias(name) for name, f in columns.items()])


def q(x) -> str:
    return "NULL" if x is None else "TRUE" if x is True else "FALSE" if x is False else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def given(n: int, **answers) -> str:
    """The expected answers for the raw values, by hand, spread over the listings."""
    kinds = {float: "DOUBLE", int: "INTEGER", str: "VARCHAR"}
    kind = {name: kinds[type(next(v for v in values if v is not None))] for name, values in answers.items()}
    columns = ", ".join(f"CAST(([{', '.join(map(q, values))}])[id % {n} + 1] AS {kind[name]}) AS {name}" for name, values in answers.items())
    return f"{LISTINGS} SELECT id, {columns} FROM listings"


def pages(spark, sf):
    return table(spark, sf, "pages")


def documents(spark, sf):
    return table(spark, sf, "documents")


def mined(spark, sf):
    text = F.get(F.array(*map(F.lit, DESCRIPTIONS)), (F.col("id") % len(DESCRIPTIONS)).cast("int"))
    rows = listings(spark, sf).select("id", text.alias("d"))
    return rows.select("id", *[E.mined(F.col("d"), f).alias(f) for f in ("energy_rating", "ownership", "construction", "condition", "furnishing", "floor", "total_floors")])


def page_facts(spark, sf):
    """Every page with embedded data made from its id behind its own markup: what the extractors find in the whole."""
    i = F.col("page_id").cast("string")
    made = [
        '<script type="application/ld+json">{"name":"x","offers":{"price":"', i, '"}}</script><div data-gps-lat="50.', i, '" data-gps-lng="14.', i, "\"></div><script>foto_done(1,'/a", i,
        ".jpg');foto_done(2,'/b.jpg');foto_done(3,'/a", i, ".jpg')</script><dl><dt>Plocha užitná:</dt><dd> ", i, " <b>m2</b></dd><dt>Stav</dt><dd>Dobrý</dd></dl><p>1 ", F.lpad(i, 6, "0"), " nabídek</p>",
    ]
    html = F.concat("html", *[F.lit(x) if isinstance(x, str) else x for x in made])
    rows = pages(spark, sf).select("page_id", html.alias("html"))
    d, g, t = E.definitions(F.col("html")), E.gps(F.col("html")), E.total_count(F.col("html"), 20)
    return rows.select("page_id", F.get_json_object(F.get(E.json_ld(F.col("html")), F.lit(0)), "$.offers.price").alias("price"), g["latitude"].alias("latitude"), g["longitude"].alias("longitude"), F.array_join(E.gallery(F.col("html")), ",").alias("photos"), F.try_element_at(d, F.lit("Plocha užitná")).alias("area"), t["total"].alias("total"), t["pages"].alias("pages"))


def tokens(spark, sf):
    rows = listings(spark, sf).select("id", F.concat(F.lit("watchdog:"), F.col("id").cast("string")).alias("payload"))
    signed = rows.withColumn("token", special.signer("secret")("payload"))
    return signed.select("id", special.verifier("secret")("token").alias("payload"), special.verifier("other")("token").isNull().alias("refused"))


def krovak(spark, sf):
    rows = listings(spark, sf).select("id", (F.lit(-743100.0) + F.col("id") % 100).alias("x"), (F.lit(-1043000.0) - F.col("id") % 100).alias("y"))
    return rows.withColumn("w", special.krovak_udf()("x", "y")).select("id", "w.latitude", "w.longitude")


FLAT = "regexp_replace(trim(coalesce(text, '')), '\\s+', ' ', 'g')"
CUT = f"substr({FLAT}, 1, 155)"
LAST = "(CASE WHEN strpos(reverse({0}), '{1}') > 0 THEN length({0}) - strpos(reverse({0}), '{1}') - {2} ELSE -1 END)"
STOP = f"greatest({LAST.format(CUT, ' .', 1)}, {LAST.format(CUT, ' !', 1)}, {LAST.format(CUT, ' ?', 1)})"
SPACE = LAST.format(CUT, " ", 0)
HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"

QUERIES = {
    "normalize_condition": (mapped("condition", word=N.condition), given(12, word=["new", "very_good", "good", "after_reconstruction", "before_reconstruction", "under_construction", "project", "poor", "demolition", None, "very_good", "poor"])),
    "normalize_construction": (mapped("construction", word=N.construction), given(11, word=["brick", "brick", "panel", "wood", "skeleton", "prefab", "mixed", "stone", "modular", "other", None])),
    "normalize_ownership": (mapped("ownership", word=N.ownership), given(8, word=["personal", "cooperative", "state", "state", "personal", "other", "personal", None])),
    "normalize_energy": (mapped("energy", word=N.energy, first=N.energy_first_letter), given(6, word=["G", "B", "C", "A", None, "D"], first=["D", "B", "C", "E", None, "D"])),
    "normalize_furnishing": (mapped("furnishing", word=N.furnishing), given(9, word=["partially", "furnished", "unfurnished", "furnished", "unfurnished", "furnished", "partially", None, "furnished"])),
    "normalize_layout": (mapped("layout", word=N.layout), given(7, word=["2+kk", "1+kk", "atypicky", "pokoj", "3+1", "atypicky", "5 a více"])),
    "normalize_amenities": (lambda spark, sf: N.by_value(raw(spark, sf, "amenities"), "raw", "keys", N.amenities).select("id", "keys"), given(6, keys=['["balcony","terrace"]', '["cellar","lift"]', '["garage","lift"]', None, '["lift","pool"]', '["air_conditioning","barrier_free"]'])),
    "read_amenities": (lambda spark, sf: listings(spark, sf).select("id", F.array_join(N.amenities_read(F.col("amenities")), "+").alias("items")), f"{LISTINGS} SELECT id, coalesce(array_to_string(CAST(CAST(amenities AS JSON) AS VARCHAR[]), '+'), '') AS items FROM listings"),
    "extract_title_details": (lambda spark, sf: listings(spark, sf).select("id", E.title_layout(F.col("title")).alias("layout_found"), E.title_size(F.col("title")).alias("size_found")), f"{LISTINGS} SELECT id, layout AS layout_found, CAST(20 + c % 180 AS DOUBLE) AS size_found FROM listings"),
    "extract_sizes": (mapped("sizes", grouped=E.size_grouped, spaced=E.size_spaced, plain=E.size_plain), given(6, grouped=[118.0, 18363.0, 56.0, 84.7, None, 100000.0], spaced=[118.0, 18363.0, 56.0, 7.0, None, 100000.0], plain=[118.0, 363.0, 56.0, 84.7, None, None])),
    "extract_layout": (mapped("layout", word=E.layout), given(7, word=["2+kk", "1+kk", "atypicky", None, "3+1", None, None])),
    "extract_layout_code": (lambda spark, sf: listings(spark, sf).select("id", E.layout_code(F.when(F.col("id") % 2 == 0, "FLAT2_KK").otherwise("FLAT31")).alias("layout")), f"{LISTINGS} SELECT id, CASE WHEN id % 2 = 0 THEN '2+kk' ELSE '3+1' END AS layout FROM listings"),
    "extract_price": (mapped("price", price=lambda c: E.price(c)["price"], currency=lambda c: E.price(c)["currency"], note=lambda c: E.price(c)["note"]), given(7, price=[25000.0, None, None, 120000.0, None, None, 990.0], currency=["CZK", "CZK", "CZK", "EUR", "CZK", "CZK", "EUR"], note=[None, "Cena dohodou", "1 Kč", None, "info v textu", None, None])),
    "extract_city": (mapped("place", city=lambda c: E.place(c)["city"], district=lambda c: E.place(c)["district"]), given(5, city=["Praha", "Lhota", "Brno", None, "Plzeň"], district=[None, "Kolín", None, "Beroun", "Plzeň-město"])),
    "extract_date": (mapped("date", day=E.czech_date), given(4, day=["2024-03-01", "2023-11-12", None, None])),
    "extract_floor": (mapped("floor", floor=lambda c: E.floors(c)["floor"], total=lambda c: E.floors(c)["total_floors"]), given(5, floor=[3, 2, None, 10, -1], total=[8, 5, None, 12, 4])),
    "extract_description": (mined, given(6, energy_rating=[None, "B", "C", None, None, None], ownership=["osobní", "družstevní", None, "státní", "osobní", "družstevní"], construction=["panel", "cihla", None, None, None, None], condition=["před rekonstrukcí", "po rekonstrukci", "novostavba", "velmi dobrý", "po rekonstrukci", None], furnishing=[None, None, "vybavený", "částečně", None, None], floor=[2, 3, None, None, 4, None], total_floors=[8, None, 12, None, None, None])),
    "extract_page_facts": (page_facts, "SELECT page_id, CAST(page_id AS VARCHAR) AS price, CAST('50.' || page_id AS DOUBLE) AS latitude, CAST('14.' || page_id AS DOUBLE) AS longitude, '/a' || page_id || '.jpg,/b.jpg' AS photos, page_id || ' m2' AS area, 1000000 + page_id AS total, CAST(ceil((1000000 + page_id) / 20) AS BIGINT) AS pages FROM pages"),
    "extract_pages_host": (lambda spark, sf: pages(spark, sf).select("page_id", E.host(F.col("url")).alias("host"), E.covered(F.col("url"), ["example.org", "ththth.example.com"]).alias("covered")), f"SELECT page_id, {HOST} AS host, ({HOST} = 'example.org' OR {HOST} LIKE '%.example.org' OR {HOST} = 'ththth.example.com' OR {HOST} LIKE '%.ththth.example.com') AS covered FROM pages"),
    "extract_page_title": (lambda spark, sf: pages(spark, sf).select("page_id", X.unescaped(E.part(F.col("html"), "(?is)<title>(.*?)</title>")).alias("title")), "SELECT page_id, replace(replace(replace(replace(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS title FROM pages"),
    "extract_size_keyword": (lambda spark, sf: listings(spark, sf).select("id", E.keyword_size(F.concat(F.lit("Prodej bytu 151 m, užitná plocha "), (20 + F.col("id") % 100).cast("string"), F.lit(" m²"))).alias("size")), f"{LISTINGS} SELECT id, CAST(20 + id % 100 AS DOUBLE) AS size FROM listings"),
    "krovak_to_wgs84": (krovak, None),
    "token_sign_verify": (tokens, f"{LISTINGS} SELECT id, 'watchdog:' || id AS payload, TRUE AS refused FROM listings"),
    "description_snippet": (lambda spark, sf: documents(spark, sf).select("doc_id", X.snippet(F.col("text"), F.lit(None).cast("string"), "-").alias("snippet")), f"SELECT doc_id, CASE WHEN {FLAT} = '' THEN '-' WHEN length({FLAT}) <= 155 THEN {FLAT} WHEN {STOP} > 80 THEN substr({CUT}, 1, {STOP} + 1) WHEN {SPACE} > 80 THEN substr({CUT}, 1, {SPACE}) || '…' ELSE {CUT} || '…' END AS snippet FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)"),
    "layout_expansion": (lambda spark, sf: listings(spark, sf).select("id", F.size(X.expanded_layouts(F.concat_ws(",", F.col("layout"), F.lit("6+")))).alias("n"), F.array_join(X.collapsed_layouts(X.expanded_layouts(F.concat_ws(",", F.when(~F.col("layout").startswith("6"), F.col("layout")), F.lit("6+")))), ",").alias("shown")), f"{LISTINGS} SELECT id, CASE WHEN layout IS NULL THEN 14 ELSE 15 END AS n, '6+' || CASE WHEN layout IS NULL OR layout LIKE '6%' THEN '' ELSE ',' || layout END AS shown FROM listings"),
    "price_format": (lambda spark, sf: listings(spark, sf).select("id", X.price(F.col("price") + 0.5, F.col("transaction_type")).alias("shown")), f"{LISTINGS} SELECT id, CASE WHEN price IS NULL THEN 'Cena na vyžádání' ELSE replace(format('{{:,}}', CAST(floor(price + 1) AS BIGINT)), ',', chr(160)) || chr(160) || CASE WHEN transaction_type = 'rent' THEN 'Kč/měs.' ELSE 'Kč' END END AS shown FROM listings"),
    "title_composition": (lambda spark, sf: listings(spark, sf).select("id", X.composed(F.col("property_type"), F.lit(""), F.col("layout"), F.col("city")).alias("title")), f"{LISTINGS} SELECT id, concat_ws(' ', property_type, layout, city) AS title FROM listings"),
    "source_names": (lambda spark, sf: listings(spark, sf).select("id", X.source_name(F.col("source"), {"low": "LOW!"}).alias("name")), f"{LISTINGS} SELECT id, CASE WHEN source = 'low' THEN 'LOW!' ELSE upper(substr(source, 1, 1)) || substr(source, 2) END AS name FROM listings"),
    "portal_url": (lambda spark, sf: listings(spark, sf).select("id", X.portal_url(F.get(F.array(*map(F.lit, ["sreality", "ulovdomov", "bezrealitky", "x"])), (F.col("id") % 4).cast("int")), F.concat(F.get(F.array(*map(F.lit, ["sreality_", "ulovdomov_", "bezrealitky_", "x_"])), (F.col("id") % 4).cast("int")), F.col("id").cast("string")), F.when(F.col("id") % 8 == 2, F.concat(F.lit("https://y/nemovitosti-byty-domy/"), F.col("id").cast("string"))).otherwise(F.col("source_url")), F.col("transaction_type"), F.col("property_type"), F.col("layout")).alias("url")), f"{LISTINGS} SELECT id, CASE id % 4 WHEN 0 THEN 'https://www.sreality.cz/detail/' || CASE transaction_type WHEN 'sale' THEN 'prodej' WHEN 'rent' THEN 'pronajem' ELSE 'drazby' END || '/' || CASE property_type WHEN 'flat' THEN 'byt' WHEN 'house' THEN 'dum' WHEN 'land' THEN 'pozemek' WHEN 'commercial' THEN 'komercni' WHEN 'other' THEN 'ostatni' WHEN 'garage' THEN 'garaz' ELSE property_type END || '/' || CASE WHEN property_type = 'flat' THEN coalesce(layout, 'x') ELSE 'x' END || '/x/' || id WHEN 1 THEN 'https://www.ulovdomov.cz/inzerat/x/' || id WHEN 2 THEN CASE WHEN id % 8 = 2 THEN 'https://y/nemovitosti-byty-domy/' || id ELSE 'https://www.bezrealitky.cz/nemovitosti-byty-domy/' || id END ELSE source_url END AS url FROM listings"),
    "surface_class": (lambda spark, sf: listings(spark, sf).select("id", X.surface(F.get(F.array(*map(F.lit, ["/", "/search?x=1", "/listing/5", "/watchdog/manage?token=a", "/about"])), (F.col("id") % 5).cast("int"))).alias("surface"), X.without_token(F.lit("https://e.org/watchdog/manage?token=abc&x=1")).alias("bare")), f"{LISTINGS} SELECT id, (['home', 'search', 'modal_listing', 'manage', 'other'])[id % 5 + 1] AS surface, 'https://e.org/watchdog/manage?x=1' AS bare FROM listings"),
    "relative_age": (lambda spark, sf: listings(spark, sf).select("id", X.age(F.col("created_at"), F.col("created_at") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") % 100000).cast("int"))).alias("age")), f"{LISTINGS}, s AS (SELECT id, (id % 100000) * 60 AS s FROM listings) SELECT id, CASE WHEN s < 3600 THEN s // 60 || ' min' WHEN s < 86400 THEN s // 3600 || ' h' WHEN s < 604800 THEN s // 86400 || ' d' WHEN s < 2592000 THEN s // 604800 || ' w' ELSE s // 2592000 || ' m' END AS age FROM s"),
    "html_escape": (lambda spark, sf: pages(spark, sf).select("page_id", F.md5(X.escaped(F.col("html")).cast("binary")).alias("digest")), "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages"),
    "url_absolute": (lambda spark, sf: listings(spark, sf).select("id", X.absolute(F.col("thumbnail_url"), "https://e.org").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("hashed")), f"{LISTINGS} SELECT id, CASE WHEN thumbnail_url LIKE '//%' THEN 'https:' || thumbnail_url ELSE thumbnail_url END AS url, sha256(CAST(id AS VARCHAR)) AS hashed FROM listings"),
}
