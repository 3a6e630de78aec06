"""Text shown to people: snippets, titles, summaries, prices, ages, addresses of pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"
#: Labels.
PROPERTY_LABELS = {"flat": "Byty", "house": "Domy", "land": "Pozemky", "commercial": "Komerční", "garage": "Garáže", "cottage": "Chaty", "residential_building": "Činžovní domy", "other": "Ostatní"}
DEAL_LABELS = {"rent": "Pronájem", "sale": "Prodej", "auction": "Aukce", "flatshare": "Spolubydlení"}
ALL_OFFERS, CHOSEN_AREA, ON_REQUEST = "Všechny nabídky", "vybraná oblast", "Cena na vyžádání"
SIX_PLUS = ["6+kk", "6+1", "6+2", "6+3", "7+kk", "7+1", "7+2", "8+kk", "8+1", "8+2", "9+kk", "9+1", "9+2", "9+3"]
SNIPPET, SHORTEST = 155, 80


def labelled(csv: Column, labels: dict[str, str]) -> Column:
    """Labels of a comma-separated value joined by `` + ``; unknown items stay as they are."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    items = F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(F.transform(items, lambda x: F.coalesce(F.try_element_at(table, x), x)), " + "), F.lit(""))


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + 0.5)


def grouped(x: Column) -> Column:
    return F.replace(F.format_number(half_up(x), 0), F.lit(","), F.lit(NBSP))


def price(value: Column, deal: Column) -> Column:
    return F.when(value.isNull(), ON_REQUEST).otherwise(F.concat(grouped(value), F.lit(NBSP), F.when(deal == "rent", "Kč/měs.").otherwise("Kč")))


def span(low: Column, high: Column, unit: Column, above: str) -> Column:
    """A range in words; ``above`` says how a lone lower bound reads (``{}`` stands for the number and its unit)."""
    before, after = above.split("{}")
    both = F.concat(grouped(low), F.lit("–"), grouped(high), unit)
    return F.when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), F.concat(F.lit(before), grouped(low), unit, F.lit(after))).when(high.isNotNull(), F.concat(F.lit("do "), grouped(high), unit))


def summary(f: Column, place: Column) -> Column:
    """What a stored search asks for, in one line."""
    money = F.when(f["transaction_type"] == "rent", " Kč/měsíc").otherwise(" Kč")
    parts = [labelled(f["property_type"], PROPERTY_LABELS), labelled(f["transaction_type"], DEAL_LABELS), place, span(f["size_min"], f["size_max"], F.lit(" m²"), "{}+"), span(f["price_min"], f["price_max"], money, "od {}")]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit(ALL_OFFERS))


def subject(n: Column, line: Column) -> Column:
    tail = F.when(F.coalesce(F.trim(line), F.lit("")) != "", F.concat(F.lit(": "), F.trim(line))).otherwise("")
    return F.concat(n.cast("string"), F.when(n == 1, " nová nabídka").when(n.between(2, 4), " nové nabídky").otherwise(" nových nabídek"), tail)


def query_string(f: Column, names: list[str]) -> Column:
    """``k=v`` pairs of what is set, in the given order; whole numbers without a decimal part."""
    def shown(name: str) -> Column:
        text = f[name].cast("string")
        return F.when(text.isNotNull() & (text != ""), F.concat(F.lit(name + "="), F.url_encode(F.regexp_replace(text, r"\.0$", ""))))

    return F.concat_ws("&", *map(shown, names))


def more_url(base: Column, query: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/search"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def last_index(text: Column, what: str) -> Column:
    """Index of the last occurrence, from 0; -1 where there is none."""
    back = F.locate(what[::-1], F.reverse(text))
    return F.when(back > 0, F.length(text) - back - len(what) + 1).otherwise(-1)


def once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def snippet(description: Column, title: Column, instead: str) -> Column:
    """At most 155 characters, cut at the last sentence end after 80, else the last space after 80, else where they end.

    Only as much of the text is looked at as can be shown: its first visible characters with the space between them.
    """
    text = F.coalesce(F.nullif(description, F.lit("")), title, F.lit(""))
    head = F.regexp_extract(text, rf"^\s*+((?:\S\s*+){{0,{SNIPPET + 1}}})", 1)

    def shown(flat: Column) -> Column:
        cut = F.substring(flat, 1, SNIPPET)
        stop, space = F.greatest(*[last_index(cut, x) for x in (". ", "! ", "? ")]), last_index(cut, " ")
        left = lambda n: F.substr(cut, F.lit(1), n)
        return F.when(flat == "", instead).when(F.length(flat) <= SNIPPET, flat).when(stop > SHORTEST, left(stop + 1)).when(space > SHORTEST, F.concat(left(space), F.lit("…"))).otherwise(F.concat(cut, F.lit("…")))

    return once(F.rtrim(F.regexp_replace(head, r"\s+", " ")), shown)


def composed(*parts: Column) -> Column:
    """Parts joined by spaces, empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def expanded_layouts(csv: Column) -> Column:
    """``6+`` stands for every layout from six rooms on."""
    return F.flatten(F.transform(F.split(csv, ","), lambda x: F.when(x == "6+", F.array(*map(F.lit, SIX_PLUS))).otherwise(F.array(x))))


def collapsed_layouts(values: Column) -> Column:
    six = F.array(*map(F.lit, SIX_PLUS))
    whole = F.size(F.array_except(six, values)) == 0
    return F.when(whole, F.concat(F.array(F.lit("6+")), F.array_except(values, six))).otherwise(values)


def source_name(source: Column, names: dict[str, str]) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), source)
    return F.coalesce(known, F.concat(F.upper(F.substring(source, 1, 1)), F.substring(source, 2, 1000)), F.lit(""))


def surface(path: Column) -> Column:
    return F.when(path == "/", "home").when(path.startswith("/search"), "search").when(path.startswith("/listing"), "modal_listing").when(path.startswith("/watchdog/manage"), "manage").otherwise("other")


def without_token(url: Column) -> Column:
    """The token parameter goes, on the pages of saved searches only."""
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])token=[^&#]*&?", "$1"), r"[?&](?=#|$)", "")
    return F.when(url.contains("/watchdog/manage"), bare).otherwise(url)


def age(then: Column, now: Column) -> Column:
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    n = lambda d: F.floor(s / d).cast("string")
    return F.when(s < 3600, F.concat(n(60), F.lit(" min"))).when(s < 86400, F.concat(n(3600), F.lit(" h"))).when(s < 7 * 86400, F.concat(n(86400), F.lit(" d"))).when(s < 30 * 86400, F.concat(n(7 * 86400), F.lit(" w"))).otherwise(F.concat(n(30 * 86400), F.lit(" m")))


def escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescaped(text: Column) -> Column:
    """Tags out, the common references decoded."""
    pairs = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, F.regexp_replace(text, "<[^>]*>", ""))


#: Detail pages of sources whose address is made from the listing.
DEAL_WORDS = {"sale": "prodej", "rent": "pronajem", "auction": "drazby"}
KIND_WORDS = {"flat": "byt", "house": "dum", "land": "pozemek", "commercial": "komercni", "other": "ostatni", "garage": "garaz"}


def portal_url(rows_source: Column, external_id: Column, source_url: Column, deal: Column, kind: Column, layout: Column) -> Column:
    """Where a listing stands at its source: made from its id without the source's prefix for three sources, else as stored."""
    word = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), c)
    bare = lambda source: F.nullif(F.replace(F.coalesce(external_id, F.lit("")), F.lit(source + "_"), F.lit("")), F.lit(""))
    slug = F.when((kind == "flat") & (F.coalesce(layout, F.lit("")) != ""), layout).otherwise("x")
    first = F.concat(F.lit("https://www.sreality.cz/detail/"), word(DEAL_WORDS, deal), F.lit("/"), word(KIND_WORDS, kind), F.lit("/"), slug, F.lit("/x/"), bare("sreality"))
    third = F.when(F.contains(source_url, F.lit("/nemovitosti-byty-domy/")), source_url).otherwise(F.concat(F.lit("https://www.bezrealitky.cz/nemovitosti-byty-domy/"), bare("bezrealitky")))
    second = F.concat(F.lit("https://www.ulovdomov.cz/inzerat/x/"), bare("ulovdomov"))
    return F.when(rows_source == "sreality", first).when(rows_source == "ulovdomov", second).when(rows_source == "bezrealitky", third).otherwise(F.nullif(source_url, F.lit("")))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(url)
