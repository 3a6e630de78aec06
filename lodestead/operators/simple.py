"""The older, simpler interface: its search conditions, its matching of saved searches, its rows and statistics.

It differs from the newer one: hidden members of clusters are found too, lists keep blanks and empty values, a place is found
anywhere in its text, saved searches compare whole values, and places without a name are counted.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.schemas import EXACT_FILTERS, TRANSACTION_TYPES
from . import stats

#: Filters that compare whole values when listings come in.
WHOLE = ("property_type", "transaction_type", "source", "layout")
#: Parts into which the listings of searches of any place are dealt.
SALTS = 16
#: Listings, and searches, that meet in one group when matches are only counted.
TILE = 1 << 16


def _contains(column: str, part: str) -> Column:
    """Case counts for all letters but A to Z; ``%`` and ``_`` are wildcards."""
    fold = F.translate(F.col(column), string.ascii_uppercase, string.ascii_lowercase)
    pattern = part.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    return F.coalesce(fold.like(f"%{pattern}%"), F.lit(False))


def conditions(filters: dict, cutoff: Column) -> Column:
    """What a saved search finds among active listings made since a moment."""
    tests = [F.col("is_active"), F.col("created_at") > cutoff]
    tests += [F.col(n).isin(*str(filters[n]).split(",")) for n in EXACT_FILTERS if filters.get(n)]
    for name, column in (("price", "price"), ("size", "size_m2")):
        if filters.get(f"{name}_min") is not None:
            tests.append(F.col(column) >= float(filters[f"{name}_min"]))
        if filters.get(f"{name}_max") is not None:
            tests.append(F.col(column) <= float(filters[f"{name}_max"]))
    if filters.get("amenities"):
        tests += [_contains("amenities", a.strip()) for a in str(filters["amenities"]).split(",")]
    if filters.get("location"):
        tests.append(reduce(Column.__or__, [_contains(c, filters["location"]) for c in ("city", "district", "region", "address")]))
    return reduce(Column.__and__, tests)


def _cities(dogs: DataFrame, listings: DataFrame) -> DataFrame:
    """(needle, city): the cities in whose names the parts of names stand that searches look for.

    The distinct names are multiplied by their parts of those lengths that searches have, and met by equality.
    """
    needles = dogs.where("needle <> ''").select("needle").distinct()
    names = listings.where("city IS NOT NULL").select("city", F.lower("city").alias("name")).distinct()
    cut = names.where("name <> ''").select("city", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("n")).join(needles.select(F.length("needle").alias("n")).distinct(), "n")
    parts = F.transform(F.sequence(F.lit(1), F.length("name") - F.col("n") + 1), lambda at: F.substring("name", at, F.col("n")))
    return cut.select("city", F.explode(F.array_distinct(parts)).alias("needle")).join(needles, "needle")


def _searches(watchdogs: DataFrame) -> DataFrame:
    f = lambda n: F.col(f"filters.{n}")
    ranges = ("price_min", "price_max", "size_min", "size_max")
    return watchdogs.where("active").select(F.col("id").alias("watchdog_id"), F.lower(f("city")).alias("needle"), *[f(n).alias(f"w_{n}") for n in (*WHOLE, *ranges)])


def _keyed(dogs: DataFrame, new: DataFrame, anywhere: Column) -> DataFrame:
    """The searches once for each place and deal where their listings are; ``anywhere``: the places of those without a city."""
    free = dogs.where("needle IS NULL OR needle = ''").withColumn("place", F.explode(anywhere))
    named = dogs.join(_cities(dogs, new), "needle").withColumn("place", F.concat(F.lit("c|"), "city")).drop("city")
    every = F.array(*[F.lit(t) for t in TRANSACTION_TYPES], F.lit(""))
    wanted = F.when(F.col("w_transaction_type").isNull(), every).otherwise(F.array(_deal(F.col("w_transaction_type"))))
    return free.unionByName(named).withColumn("deal", F.explode(wanted))


def _deal(c: Column) -> Column:
    return F.when(c.isin(*TRANSACTION_TYPES), c).otherwise("")


def _offered(new: DataFrame, part: Column) -> DataFrame:
    places = F.array_compact(F.array(part, F.concat(F.lit("c|"), "city")))
    return new.select("id", *WHOLE, "price", "size_m2", _deal(F.col("transaction_type")).alias("deal"), F.explode(places).alias("place"))


def matches(new: DataFrame, watchdogs: DataFrame) -> DataFrame:
    """(watchdog_id, id): the new listings that each active search takes; a search without filters takes all.

    An equi-join on place and deal. A search has a key for each city that its text is part of, or for all parts into which
    the listings are dealt; a listing has its city's key and its part's.
    """
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.concat(F.lit("w|"), k.cast("string")))
    keyed = _keyed(_searches(watchdogs), new, salts)
    offered = _offered(new, F.concat(F.lit("w|"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("string")))
    same = [F.col(f"w_{n}").isNull() | (F.col(f"w_{n}") == F.col(n)) for n in WHOLE]
    bounds = [F.col(f"w_{n}_min").isNull() | (F.col(c) >= F.col(f"w_{n}_min")) for n, c in (("price", "price"), ("size", "size_m2"))]
    bounds += [F.col(f"w_{n}_max").isNull() | (F.col(c) <= F.col(f"w_{n}_max")) for n, c in (("price", "price"), ("size", "size_m2"))]
    return keyed.join(offered, ["place", "deal"]).where(reduce(Column.__and__, same + bounds)).select("watchdog_id", "id")


def _ranks(values: pa.ChunkedArray, low: pa.ChunkedArray, high: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ranks of values (null: the last), and for each search the ranks from and below which it takes; the number of ranks."""
    known = values.is_valid().to_numpy()
    plain = values.to_numpy()
    distinct = np.unique(plain[known])
    ranks = np.where(known, np.searchsorted(distinct, plain), len(distinct))
    least, most = low.is_valid().to_numpy(), high.is_valid().to_numpy()
    begin = np.where(least, np.searchsorted(distinct, low.to_numpy(), "left"), 0)
    end = np.where(most, np.searchsorted(distinct, high.to_numpy(), "right"), np.where(least, len(distinct), len(distinct) + 1))
    return ranks, begin, np.maximum(begin, end), len(distinct) + 1


def _within(second: np.ndarray, ids: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """For each search the number and the sum of ids at positions from ``begin`` to ``end`` whose second rank is in its range.

    Blocks of one, two, four ... positions, each ordered by the second rank; a search takes at most two blocks of a size.
    """
    n, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    at, size = np.arange(len(second)), 0
    left, right = begin.copy(), end.copy()
    while (open_ := left < right).any():
        keys = (at >> size) * (wide + 1) + second
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], np.concatenate([[0], np.cumsum(ids[order])])
        for mine, block in ((np.flatnonzero(open_ & (left & 1 == 1)), left), (np.flatnonzero(open_ & (right & 1 == 1)), right - 1)):
            a = np.searchsorted(keys, block[mine] * (wide + 1) + low[mine])
            b = np.searchsorted(keys, block[mine] * (wide + 1) + high[mine])
            n[mine] += b - a
            total[mine] += sums[b] - sums[a]
        left, right, size = (left + 1) >> 1, right >> 1, size + 1
    return n, total


def _tile(offered: pa.Table, keyed: pa.Table) -> pa.Table:
    """What each search of a tile takes of its listings."""
    n, total = np.zeros(len(keyed), np.int64), np.zeros(len(keyed), np.int64)
    if len(offered) and len(keyed):
        ids = offered["id"].fill_null(0).to_numpy()
        price, from_, below, wide = _ranks(offered["price"], keyed["w_price_min"], keyed["w_price_max"])
        size, low, high, deep = _ranks(offered["size_m2"], keyed["w_size_min"], keyed["w_size_max"])
        asked = {c: keyed[f"w_{c}"].is_valid().to_numpy() for c in WHOLE}
        pattern = sum((asked[c].astype(np.int64) << k for k, c in enumerate(WHOLE)), np.zeros(len(keyed), np.int64))
        for p in np.unique(pattern):  # the filters that are given; each such kind of searches by itself
            mine = np.flatnonzero(pattern == p)
            key, wanted = np.zeros(len(offered), np.int64), np.zeros(len(mine), np.int64)
            held, known = np.ones(len(offered), bool), np.ones(len(mine), bool)
            for c in (c for k, c in enumerate(WHOLE) if p >> k & 1):
                values = offered[c].unique().drop_null()
                has, code = offered[c].is_valid().to_numpy(), pc.index_in(offered[c], values).fill_null(0).to_numpy()
                want = pc.index_in(keyed[f"w_{c}"].take(pa.array(mine)), values)
                key, wanted = key * len(values) + code, wanted * len(values) + want.fill_null(0).to_numpy()
                held, known = held & has, known & want.is_valid().to_numpy()
            rows, mine, wanted = np.flatnonzero(held), mine[known], wanted[known]
            first = key[rows] * (wide + 1) + price[rows]
            rows = rows[order := np.argsort(first, kind="stable")]
            first = first[order]
            begin, end = (np.searchsorted(first, wanted * (wide + 1) + x[mine]) for x in (from_, below))
            n[mine], total[mine] = _within(size[rows], ids[rows], begin, end, low[mine], high[mine], deep)
    taken = np.flatnonzero(n)
    return pa.table({"watchdog_id": keyed["watchdog_id"].take(pa.array(taken)), "n": n[taken], "ids": total[taken]})


def match_totals(new: DataFrame, watchdogs: DataFrame, tile: int = TILE) -> DataFrame:
    """(watchdog_id, n, ids): the number and the sum of ids of the listings in ``matches`` for each search that takes any.

    No pair is made. Listings and searches of a place and deal are dealt into tiles of about ``tile`` each, and a tile counts
    by ordered blocks: its time grows with its rows, not with its pairs.
    """
    keyed = _keyed(_searches(watchdogs), new, F.array(F.lit("w"))).drop("needle")
    offered = _offered(new, F.lit("w"))
    parts = lambda df, name: df.groupBy("place", "deal").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias(name))
    tiles = parts(offered, "n_listings").join(parts(keyed, "n_searches"), ["place", "deal"])
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = offered.join(tiles, ["place", "deal"]).withColumn("l", deal("id", "n_listings")).withColumn("s", numbers("n_searches"))
    right = keyed.join(tiles, ["place", "deal"]).withColumn("s", deal("watchdog_id", "n_searches")).withColumn("l", numbers("n_listings"))
    at = ["place", "deal", "l", "s"]
    left, right = left.select(*at, "id", *WHOLE, "price", "size_m2"), right.drop("n_listings", "n_searches")
    schema = f"watchdog_id {dict(keyed.dtypes)['watchdog_id']}, n long, ids long"
    counted = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_tile, schema)
    return counted.groupBy("watchdog_id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def lists(images: Column, amenities: Column) -> tuple[Column, Column]:
    """Images from JSON, none where it is no list; amenities from text with commas, which is not read as JSON."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.from_json(images, "array<string>"), none), F.when(amenities != "", F.split(amenities, ",")).otherwise(none)


def breakdowns(listings: DataFrame, cities: int = 10) -> DataFrame:
    """(dimension, value, cnt, position): totals, and each dimension's counts, largest first; nameless values and cities count.

    All of it from one pass; the cities are cut before they are ranked.
    """
    cells = listings.groupingSets([[F.col(c)] for c in (*stats.DIMENSIONS, "city")] + [[]], *stats.DIMENSIONS, "city").agg(
        F.count_if("is_active").alias("cnt"), F.count("*").alias("all"), F.grouping_id(*stats.DIMENSIONS, "city").alias("g"))
    names = {15 - (8 >> k): c for k, c in enumerate((*stats.DIMENSIONS, "city"))}
    dimension = F.coalesce(*[F.when(F.col("g") == g, F.lit(c)) for g, c in names.items()])
    value = F.coalesce(*[F.when(F.col("g") == g, F.col(c)) for g, c in names.items()])
    counted = cells.where("g < 15 AND cnt > 0").select(dimension.alias("dimension"), value.alias("value"), "cnt")
    first = [F.desc("cnt"), F.asc_nulls_first("value")]
    top = counted.where("dimension = 'city'").orderBy(*first).limit(cities)
    ranked = counted.where("dimension <> 'city'").unionByName(top).withColumn("position", F.row_number().over(Window.partitionBy("dimension").orderBy(*first)))
    parts = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("long").alias("cnt")) for n, c in (("total", F.col("cnt")), ("total_all", F.col("all")), ("inactive", F.col("all") - F.col("cnt")))])
    totals = cells.where("g = 15").select(F.inline(parts)).select("dimension", F.lit(None).cast("string").alias("value"), "cnt", F.lit(1).alias("position"))
    return ranked.unionByName(totals)
