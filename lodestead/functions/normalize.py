"""One vocabulary for what sources call things differently. Rules are tried in order, the first that matches wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (pattern, word) in order; case does not matter.
CONDITION = [
    ("novostavba|^new$|^new_build$", "new"), (r"velmi\s+dobr|bezvad|very.?good", "very_good"), ("^dobr[ýy]|^good$", "good"),
    (r"po\s+rekonstrukci|after.?reconstruction", "after_reconstruction"), (r"p[řr]ed\s+rekonstrukc|before.?reconstruction|before.?renovation", "before_reconstruction"),
    (r"ve\s+v[ýy]stavb|under.?construction|rozestav", "under_construction"), ("^projekt|^project$", "project"), ("[šs]patn|^poor$|^bad$", "poor"), (r"k\s+demolici|demolition", "demolition"),
]
CONSTRUCTION = [
    ("cihlo?v|cihla|zd[eě]n|^brick$", "brick"), ("panel", "panel"), ("d[řr]ev|^wood$", "wood"), ("skelet|^skeleton$", "skeleton"), ("montovan|^prefab$", "prefab"),
    ("sm[íi][šs]en|^mixed$", "mixed"), ("kamen|^stone$", "stone"), ("modul[áa]rn", "modular"), ("^other$|^ostatn", "other"),
]
OWNERSHIP = [("osobn[íi]|^personal$|^private$|soukrom", "personal"), ("dru[žz]stevn|^cooperative$", "cooperative"), ("st[áa]tn[íi]|obecn[íi]|^state$", "state"), ("^other$|^ostatn", "other")]
FURNISHING = [
    (r"[čc][áa]ste[čc]n|^partially$|^partlyfurnished$|polo\s*vybav", "partially"), (r"^za[řr][íi]zen|^vybaven|^furnished$|^yes$|^true$|^ano$|pln[eě]\s+vybav", "furnished"),
    ("neza[řr][íi]zen|nevybaven|^unfurnished$|^no$|^false$|^ne$", "unfurnished"),
]
AMENITIES = {
    "balkón": "balcony", "balkon": "balcony", "terasa": "terrace", "lodžie": "loggia", "lodzie": "loggia", "sklep": "cellar", "sklepní": "cellar", "sklepni": "cellar",
    "výtah": "lift", "vytah": "lift", "elevator": "lift", "garáž": "garage", "garaz": "garage", "garážové": "garage", "garazove": "garage", "garážové stání": "garage", "garazove stani": "garage",
    "parkování": "parking", "parkovani": "parking", "parking": "parking", "zahrada": "garden", "bezbariérový": "barrier_free", "bezbarierovy": "barrier_free", "barrier_free": "barrier_free",
    "bazén": "pool", "bazen": "pool", "klimatizace": "air_conditioning",
}


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]++$", "")


def first_match(raw: Column, rules: list[tuple[str, str]]) -> Column:
    text, found = trimmed(raw), None
    for pattern, word in rules:
        test = text.rlike(f"(?iu){pattern}")
        found = F.when(test, word) if found is None else found.when(test, word)
    return found


def condition(raw: Column) -> Column:
    return first_match(raw, CONDITION)


def construction(raw: Column) -> Column:
    return first_match(raw, CONSTRUCTION)


def ownership(raw: Column) -> Column:
    return first_match(raw, OWNERSHIP)


def energy(raw: Column) -> Column:
    """Class letter: after the word for class, as the head of a code, alone, or anywhere on its own."""
    text = trimmed(raw)
    tries = [r"(?iu)T[řr][íi]da\s+([A-G])", r"(?i)^([A-G])[_\s-]", r"(?i)^([A-G])$", r"(?i)(?<![A-Za-z0-9_])([A-G])(?![A-Za-z0-9_])"]
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries]))


def energy_first_letter(raw: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(raw, "(?i)([A-G])", 1), F.lit("")))


def furnishing(raw: Column) -> Column:
    """The rules, then a list of furniture: four items or more furnish, fewer do partially."""
    text = trimmed(raw)
    items = F.size(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))
    listed = text.contains(",") | text.contains("linka") | text.contains("Led")
    return F.coalesce(first_match(raw, FURNISHING), F.when(listed & (items >= 4), "furnished").when(listed & (items >= 1), "partially"))


def layout(raw: Column) -> Column:
    text = F.nullif(F.lower(trimmed(raw)), F.lit(""))
    return F.when(text.rlike("(?iu)garsoni[eé]|garsonka"), "1+kk").when(text.rlike("(?iu)atypick[ýy]|^jin[ýy]$"), "atypicky").otherwise(F.coalesce(F.nullif(F.regexp_extract(text, r"(\d+\+(?:kk|\d))", 1), F.lit("")), text))


def amenity_items(raw: Column) -> Column:
    """Items of a JSON array or a comma-separated list."""
    text = trimmed(raw)
    return F.when(text.startswith("["), F.coalesce(F.from_json(text, "array<string>"), F.array(text))).otherwise(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def amenity(item: Column) -> Column:
    """The English key: exact words first, then contained ones in the order of the table.

    Contained words are looked for only where no whole one is known.
    """
    text = F.lower(F.trim(F.regexp_replace(item, r"(?i)\s*\d+[\s,.]*m[²2]?\s*$", "")))
    table = F.create_map(*[F.lit(x) for pair in AMENITIES.items() for x in pair])
    known = F.when(text.isin(*sorted(set(AMENITIES.values()))), text)
    words = F.array(*map(F.lit, AMENITIES))
    contained = F.try_element_at(table, F.get(F.filter(words, lambda w: F.contains(text, w)), F.lit(0)))
    return F.when(text != "", F.coalesce(F.try_element_at(table, text), contained, known))


def amenities(raw: Column) -> Column:
    """Sorted distinct keys as JSON; null where none is known."""
    keys = F.array_sort(F.array_distinct(F.filter(F.transform(amenity_items(raw), amenity), lambda x: x.isNotNull())))
    return F.when(F.size(keys) > 0, F.to_json(keys))


def by_value(rows: DataFrame, column: str, name: str, rule: Callable[[Column], Column]) -> DataFrame:
    """``rule`` of a column whose values repeat, worked out once for each value."""
    values = rows.select(column).distinct().where(F.col(column).isNotNull())
    return rows.join(values.withColumn(name, rule(F.col(column))), column, "left")


def amenities_read(raw: Column) -> Column:
    """Read side: JSON where it parses, else comma-separated."""
    text = trimmed(raw)
    return F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
