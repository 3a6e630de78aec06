"""Fields mined from titles, prices, addresses, descriptions and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\u00A0]"


def part(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def decimal(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SPACES, ""), ",", ".").try_cast("double")


def title_layout(title: Column) -> Column:
    return part(title, r"(?i)(\d\+(?:kk|1|\d))")


def title_size(title: Column) -> Column:
    """Square metres, looked for after the layout only, so that its digit is not taken for thousands."""
    found = title_layout(title)
    rest = F.when(found.isNotNull(), F.regexp_replace(title, r"(?is)^.*?\d\+(?:kk|1|\d)", "")).otherwise(title)
    return decimal(part(rest, r"(?i)(\d[\d\s]*(?:[.,]\d+)?)\s*m[²2]"))


def size_grouped(text: Column) -> Column:
    """Size with groups of thousands and a decimal tail, not starting inside a layout."""
    return decimal(part(text, rf"(?i)(?<![\d+])(\d+(?:{SPACES}\d{{3}})*(?:[.,]\d+)?)\s*m[²2]"))


def size_spaced(text: Column) -> Column:
    x = decimal(part(text, rf"(?i)(?<![\d+])(\d(?:\d|{SPACES})*)\s*m[²2]"))
    return F.when(x > 0, x)


def size_plain(text: Column) -> Column:
    x = decimal(part(text, r"(?i)(?<![\d+])(\d+[.,]?\d*)\s*m[²2]"))
    return F.when((x > 0) & (x < 100_000), x)


def layout(text: Column) -> Column:
    return F.coalesce(F.lower(part(text, r"(?i)(\d+\+(?:kk|\d))")), F.when(text.rlike("(?iu)atypick"), "atypicky"), F.when(text.rlike("(?iu)garsoni"), "1+kk"))


def layout_code(code: Column) -> Column:
    """``FLAT2_KK`` is 2+kk, ``FLAT21`` is 2+1."""
    return F.coalesce(F.concat(part(code, r"^FLAT(\d)_?KK$"), F.lit("+kk")), F.concat_ws("+", part(code, r"^FLAT(\d)(\d)$"), F.when(part(code, r"^FLAT(\d)(\d)$").isNotNull(), part(code, r"^FLAT(\d)(\d)$", 2))))


#: Phrases for a price that is to be agreed.
BY_AGREEMENT = ("dohodou", "v textu", "nabídněte", "info v tel")


def price(text: Column) -> Column:
    """struct(price, currency, note): by agreement, or a placeholder of 0 or 1, is no price but a note."""
    clean = F.trim(F.regexp_replace(text, r"[\s\u00A0]+", " "))
    low = F.lower(clean)
    none = low.isin("0 kč", "1 kč")
    for phrase in BY_AGREEMENT:
        none = none | F.contains(low, F.lit(phrase))
    x = F.regexp_replace(clean, "[^0-9]", "").try_cast("double")
    value = F.when(~none & (x > 0), x)
    return F.struct(value.alias("price"), F.when(clean.rlike("€|(?i)EUR"), "EUR").otherwise("CZK").alias("currency"), F.when(value.isNull(), F.nullif(clean, F.lit(""))).alias("note"))


def place(locality: Column) -> Column:
    """struct(city, district): ``okres X`` at the end is the district; suffixes and trailing numbers go."""
    parts = F.transform(F.split(locality, ","), lambda x: F.trim(x))
    last = F.element_at(parts, -1)
    is_okres = last.rlike(r"(?iu)^okres\s+")
    city = F.when(is_okres, F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))).otherwise(last)
    city = F.trim(F.regexp_replace(F.trim(F.regexp_replace(city, r"\s*-\s*\S.*$", "")), r"\s+\d+$", ""))
    return F.struct(F.nullif(city, F.lit("")).alias("city"), F.when(is_okres, F.nullif(F.trim(F.regexp_replace(last, r"(?iu)^okres\s+", "")), F.lit(""))).alias("district"))


def czech_date(text: Column) -> Column:
    """``d.m.yyyy`` as ISO."""
    d = lambda k: part(text, r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})", k)
    return F.when(d(3).isNotNull(), F.concat_ws("-", d(3), F.lpad(d(2), 2, "0"), F.lpad(d(1), 2, "0")))


def postcode(text: Column) -> Column:
    return part(text, r"(\d{3}\s*\d{2})")


def floors(text: Column) -> Column:
    """struct(floor, total_floors) of ``3. z 8`` or ``3/8``."""
    pattern = r"(-?\d+)\s*(?:\.\s*(?:podlaží\s*)?z|/)\s*(?:celkem\s*)?(\d+)"
    return F.struct(part(text, pattern).try_cast("int").alias("floor"), part(text, pattern, 2).try_cast("int").alias("total_floors"))


#: What a description says, in order. ``\\b`` stands for a boundary of Unicode letters.
MINED = {
    "energy_rating": [r"energetick[áý]\s+(?:třída|nároč)[^:]*?:\s*(?:Třída\s+)?([A-G])\b", r"(?:štítkem|třída|třídou|PENB)\s+([A-G])\b", r"\bPENB\s*[:\-–]\s*([A-G])\b"],
    "floor": [r"ve?\s+(\d+)\.\s*(?:patře|NP|nadzemním|podlaží)", r"(\d+)\.\s*(?:patro|NP|nadzemní\s+podlaží)"],
    "total_floors": [r"(?:se|má|o)\s+(\d+)\s+podlaží", r"(\d+)\s*podlažní"],
}
MINED_WORDS = {
    "ownership": [(r"\bosobní(?:m|ho)?\s+vlastnictví\b|\bosobní\s+\d\+|(?-i:\bOV\b)", "osobní"), (r"\bdružstevní(?:m|ho)?\s+(?:vlastnictví\b|byt)|\bdružstevní\s+\d\+", "družstevní"), (r"\bstátní(?:m|ho)?\s+vlastnictví\b", "státní")],
    "construction": [(r"\bpanel(?:ový|ové|ová|ového|ovém)?\s+(?:budov|dom|dům|byt)|\bv\s+panel(?:ový|ové|ová|ovém|ového)?\b", "panel"), (r"\bcihlov(?:ý|é|á|ém|ého)?\s+(?:budov|dom|dům|byt)|\bv\s+cihlov(?:ý|é|á|ém|ého)?\b", "cihla"), (r"\bdřevostavb", "dřevostavba")],
    "condition": [(r"\bnovostavb", "novostavba"), (r"\bpo\s+(?:kompletní\s+)?rekonstrukci\b", "po rekonstrukci"), (r"\bpřed\s+rekonstrukcí\b", "před rekonstrukcí"), (r"\bvelmi\s+dobr(?:ý|ém)\s+stavu?\b", "velmi dobrý"), (r"\bdobr(?:ý|ém)\s+stavu?\b", "dobrý")],
    "furnishing": [(r"\bplně\s+(?:za|vy)baven|\bkompletně\s+(?:za|vy)baven", "vybavený"), (r"\bčástečně\s+(?:za|vy)baven", "částečně"), (r"\bnev(?:y)?baven", "nevybavený")],
}


def boundary(pattern: str, ascii_only: bool = False) -> str:
    """Word boundaries spelled out: of all letters, or of ASCII letters alone (then a pattern that ends in one with an accent
    cannot match, as in engines that know no others)."""
    word = "[A-Za-z0-9_]" if ascii_only else r"[\p{L}\p{N}_]"
    return "(?iu)" + pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def mined(description: Column, field: str, ascii_only: bool = False) -> Column:
    if field in MINED:
        found = F.coalesce(*[part(description, boundary(p, ascii_only)) for p in MINED[field]])
        return F.upper(found) if field == "energy_rating" else found.try_cast("int")
    found = None
    for pattern, word in MINED_WORDS[field]:
        test = description.rlike(boundary(pattern, ascii_only))
        found = F.when(test, word) if found is None else found.when(test, word)
    return found


#: Words for area, and the plausible sizes.
AREA_WORDS = ("plocha", "ploch", "výměr", "vymer", "rozloh", "velikost")
SMALLEST, LARGEST, BEFORE = 10, 2000, 40
SIZE = r"(\d{2,4})[\s\x{A0}]*m(?:[²2])?(?=\b|[\s\x{A0},.]|$)"


def keyword_size(title: Column) -> Column:
    """The size after a word for area at most 40 characters back, else the first plausible one."""
    text = F.lower(F.coalesce(title, F.lit("")))
    sizes = F.regexp_extract_all(text, F.lit(SIZE), 1)
    pieces = F.split(F.regexp_replace(text, SIZE, "\u0001$0"), "\u0001")  # each but the first begins with a size
    told = lambda k: F.right(F.array_join(F.slice(pieces, 1, k + 1), ""), F.lit(BEFORE)).rlike("|".join(AREA_WORDS))
    found = F.transform(sizes, lambda x, k: F.struct(x.cast("double").alias("size"), told(k).alias("told")))
    fits = F.filter(found, lambda p: p.getField("size").between(SMALLEST, LARGEST))
    return F.coalesce(F.get(F.filter(fits, lambda p: p.getField("told")), F.lit(0)).getField("size"), F.get(fits, F.lit(0)).getField("size"))


def json_ld(html: Column) -> Column:
    """The JSON-LD blocks of a page."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)


def gps(html: Column) -> Column:
    """struct(latitude, longitude): data attributes, else an embedded GeoJSON point (longitude first)."""
    lat = F.coalesce(part(html, r'data-(?:gps-)?lat(?:itude)?="(-?\d+\.?\d*)"'), part(html, r'"coordinates"\s*:\s*\[\s*-?\d+\.?\d*\s*,\s*(-?\d+\.?\d*)'))
    lng = F.coalesce(part(html, r'data-(?:gps-)?(?:lng|lon(?:gitude)?)="(-?\d+\.?\d*)"'), part(html, r'"coordinates"\s*:\s*\[\s*(-?\d+\.?\d*)'))
    return F.struct(lat.try_cast("double").alias("latitude"), lng.try_cast("double").alias("longitude"))


def gallery(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"foto_done\(\d+,\s*'([^']+)'\)"), 1))


def total_count(text: Column, per_page: int) -> Column:
    n = F.regexp_replace(part(text, rf"(\d(?:\d|{SPACES})*)\s*(?:nabídek|inzerátů|výsledků)"), SPACES, "").try_cast("long")
    return F.struct(n.alias("total"), F.ceil(n / per_page).cast("long").alias("pages"))


def definitions(html: Column) -> Column:
    """Map of a definition list's terms to their texts, markup removed."""
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), r"\s+", " "))
    pattern = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
    pairs = F.zip_with(F.regexp_extract_all(html, F.lit(pattern), 1), F.regexp_extract_all(html, F.lit(pattern), 2), lambda k, v: F.struct(F.rtrim(clean(k), F.lit(":")).alias("key"), clean(v).alias("value")))
    seen = F.aggregate(pairs, F.filter(pairs, lambda p: F.lit(False)), lambda kept, p: F.when(F.exists(kept, lambda q: q.key == p.key), kept).otherwise(F.array_append(kept, p)))
    return F.map_from_entries(seen)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def covered(url: Column, hosts: list[str]) -> Column:
    """Whether a URL's host is one of ``hosts`` or below one."""
    h = host(url)
    return F.coalesce(F.exists(F.array(*map(F.lit, hosts)), lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x))), F.lit(False))
