"""Matches by title, follow-up lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stage


#: Rows of the sweep: ``part`` is the range of titles that a row lies in.
SWEPT = "title string, own long, near long"


def by_title(cards: DataFrame, offers: DataFrame) -> DataFrame:
    """(card_id, offer_id, rank): the same title, else one a prefix of the other; the first of the best rank wins.

    Sorted, titles that begin alike lie side by side: a title's extensions follow it at once. So both sides' distinct titles
    are dealt to ranges and each range is read once in order, with a stack of the titles that are prefixes of the current one.
    What lies before a range and reaches into it can only be a prefix of the range's first title: these few rows are looked
    up and put before the range, and a title that reaches over several ranges is settled by the least of what they found.
    No title is multiplied and no key is hot, however many titles share a beginning.
    """
    spark = cards.sparkSession
    stage = Stage(spark, "titles")
    sides = cards.select("title", F.lit(True).alias("card"), F.lit(None).cast("long").alias("offer"))
    sides = sides.unionByName(offers.select("title", F.lit(False).alias("card"), F.col("id").cast("long").alias("offer"))).where("title IS NOT NULL")
    titles = sides.groupBy("title").agg(F.bool_or("card").alias("card"), F.min("offer").alias("offer"))
    ranged = stage.put(titles.repartitionByRange("title").withColumn("part", F.spark_partition_id()))
    starts = ranged.groupBy("part").agg(F.min("title").alias("first"))  # a row a range
    prefixes = F.transform(F.sequence(F.lit(0), F.length("first") - 1), lambda n: F.substring("first", F.lit(1), n))
    reaching = starts.where("length(first) > 0").select(F.col("part").alias("into"), F.explode(prefixes).alias("title"))
    carried = ranged.join(reaching, "title").where("part < into").select("title", "card", "offer", F.col("into").alias("part"))
    rows = ranged.unionByName(carried).repartition("part").sortWithinPartitions("part", "title")
    found = rows.select("part", "title", "card", "offer").mapInArrow(_sweep, SWEPT)
    best = found.groupBy("title").agg(F.min("own").alias("own"), F.min("near").alias("near")).where("own IS NOT NULL OR near IS NOT NULL")
    best = best.select("title", F.coalesce("own", "near").alias("offer_id"), F.when(F.col("own").isNotNull(), 0).otherwise(1).alias("rank"))
    return cards.select(F.col("id").alias("card_id"), "title").join(best, "title").select("card_id", "offer_id", "rank")


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cards of sorted ranges with the least offer of their own title, and of titles above and below them on the stack."""
    stack, at = [], None  # [title, card, own offer, least offer of its prefixes, least offer of its extensions]
    for batch in batches:
        done = []
        for part, title, card, offer in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            while stack and (part != at or not title.startswith(stack[-1][0])):
                _close(stack, done)
            above = _least(stack[-1][2], stack[-1][3]) if stack else None
            stack.append([title, card, offer, above, None])
            at = part
        yield _closed(done)
    done = []
    while stack:
        _close(stack, done)
    yield _closed(done)


def _close(stack: list, done: list) -> None:
    title, card, own, above, below = stack.pop()
    if stack:
        stack[-1][4] = _least(stack[-1][4], _least(own, below))
    if card:
        done.append((title, own, _least(above, below)))


def _closed(done: list) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["title", "own", "near"])


def needs_detail(page: DataFrame, known: DataFrame) -> DataFrame:
    """Listings of a page that are unknown, or known without description and seller."""
    facts = known.select("external_id", F.lit(True).alias("_known"), F.col("description").alias("_d"), F.col("seller_name").alias("_s"))
    rows = page.select("external_id").distinct().join(facts, "external_id", "left")
    return rows.where(F.col("_known").isNull() | (F.col("_d").isNull() & F.col("_s").isNull())).select("external_id")


def new_since(listings: DataFrame, start: Column, n: int) -> DataFrame:
    """The newest ids since a moment, and one more to tell whether there are others."""
    return listings.where(F.col("created_at") >= start).orderBy(F.desc("id")).limit(n + 1).select("id")


def latest_with_images(listings: DataFrame, failed: DataFrame, fetched: int = 28, shown: int = 20) -> DataFrame:
    """More than are shown are fetched; those whose image failed drop out."""
    newest = listings.where("is_active AND is_canonical").orderBy(F.col("listed_at").desc_nulls_last(), "id").limit(fetched)
    return newest.join(failed.select("id"), "id", "left_anti").orderBy(F.col("listed_at").desc_nulls_last(), "id").limit(shown).select("id")


def property_type(code: Column, path: Column) -> Column:
    """From a numeric category, else from a path segment."""
    by_code = F.when(code == 1, "flat").when(code == 2, "house").when(code == 3, "land").when(code == 4, "commercial").when(code == 5, "other")
    by_path = F.when(path.contains("/byty/"), "flat").when(path.contains("/domy/"), "house").when(path.contains("/pozemky/"), "land").when(path.contains("/garaze/"), "garage").when(path.contains("/chaty/"), "cottage")
    return F.coalesce(by_code, by_path, F.lit("other"))


def amenity_flags(**flags: Column) -> Column:
    """Names of the flags that are set, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(set_, F.lit(name)) for name, set_ in flags.items()])))


def leftover(params: Column, used: list[str]) -> Column:
    """What is left of a parameter map once columns have been made of it."""
    return F.map_filter(params, lambda k, _: ~k.isin(*used))


def position(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
