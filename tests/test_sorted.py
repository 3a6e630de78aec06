"""Titles matched by sorted ranges against one loop; snapshots along a curve and what a box reads of them."""

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestead.operators import matching
from lodestead.sources import files


def by_loop(cards, offers):
    found = {}
    for card, title in cards:
        ranked = [(0 if title == other else 1, offer) for offer, other in offers if None not in (title, other) and (title.startswith(other) or other.startswith(title))]
        if ranked:
            found[card] = min(ranked)[::-1]
    return found


def matched(spark, cards, offers, ranges):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [spark.createDataFrame(side, "id long, title string") for side in (cards, offers)]
        return {r.card_id: (r.offer_id, r["rank"]) for r in matching.by_title(*rows).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_titles_of_few_letters(spark, seed):
    """Most titles are beginnings of others, and families reach over several ranges."""
    rng = random.Random(seed)
    word = lambda: None if rng.random() < 0.03 else "".join(rng.choice("abř") for _ in range(rng.randrange(0, 8)))
    cards, offers = [(k, word()) for k in range(150)], [(1000 + k, word()) for k in range(rng.choice([5, 150]))]
    rng.shuffle(offers)
    assert matched(spark, cards, offers, 9) == by_loop(cards, offers)


def test_one_beginning_of_all_titles(spark):
    """An empty title and one beginning that every title has are carried into all ranges."""
    cards = [(0, ""), (1, "prodej"), *[(k, f"prodej bytu {k:04d}") for k in range(2, 120)], (200, "x"), (201, None)]
    offers = [(5000 - k, f"prodej bytu {k:04d} - novinka") for k in range(0, 120, 3)] + [(7, "prodej"), (9000, "y")]
    assert matched(spark, cards, offers, 16) == by_loop(cards, offers)
    assert matched(spark, cards, [], 4) == {} and matched(spark, [], offers, 4) == {}


def test_a_card_reads_offers_of_later_ranges(spark):
    offers = [(k, f"byt {k:03d}") for k in range(300, 900)]
    assert matched(spark, [(1, "byt"), (2, "byt 7"), (3, "byt 450 s balkonem"), (4, "dum")], offers, 12) == {1: (300, 1), 2: (700, 1), 3: (450, 1)}


def groups(path):
    """Smallest and largest latitude and longitude of every row group below a path; None for a group without places."""
    for file in sorted(Path(path).rglob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for k in range(meta.num_row_groups):
            columns = {c.path_in_schema: c.statistics for c in (meta.row_group(k).column(j) for j in range(meta.num_columns))}
            yield None if not columns["latitude"].has_min_max else [columns["latitude"].min, columns["longitude"].min, columns["latitude"].max, columns["longitude"].max]


def test_a_box_reads_few_row_groups(spark, tmp_path):
    """A box of a hundredth of the area lies in under a tenth of the row groups, and Spark reads no other rows."""
    rows = spark.range(0, 200_000, 1, 8).select("id", (48 + F.rand(1) * 4).alias("latitude"), (12 + F.rand(2) * 6).alias("longitude"), F.repeat(F.md5(F.col("id").cast("string")), 4).alias("title"))
    rows = rows.withColumn("latitude", F.when(F.col("id") % 3 != 0, F.col("latitude")))
    path = files.write_snapshot(rows, str(tmp_path / "s"), area=(48.0, 12.0, 52.0, 18.0), block_bytes=200_000)
    found = list(groups(path))
    south, west, north, east = box = (49.1, 13.0, 49.5, 13.6)
    touched = [g for g in found if g and g[0] <= north and g[2] >= south and g[1] <= east and g[3] >= west]
    assert len(found) > 60 and 0 < len(touched) < len(found) / 10, (len(touched), len(found))
    assert any(g is None for g in found)
    inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    stored = files.snapshot(spark, str(tmp_path / "s"))
    assert sorted(r.id for r in stored.where(inside).select("id").collect()) == sorted(r.id for r in rows.where(inside).select("id").collect()), box
    sizes = [r.n for r in stored.where("latitude IS NULL").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 60_000  # rows without a place, a third of all, are in several files


def test_curve_keeps_halves_apart(spark):
    points = [(-90.0, -180.0), (-90.0, 179.9), (89.9, -180.0), (89.9, 179.9), (200.0, 400.0), (None, 1.0), (1.0, None)]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, a double, b double")
    got = [r[0] for r in rows.orderBy("k").select(files.curve(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0 and got[4] == (1 << 32) - 1 and got[5] is None and got[6] is None
    assert got[1] >> 30 == 1 and got[2] >> 30 == 2 and got[3] >> 30 == 3
