"""Kept figures against figures made anew, over several rounds of changes; block samples."""

import random

from pyspark.sql import functions as F

from lodestead.operators import materialised as I
from lodestead.operators import metrics

SCHEMA = "id long, is_active boolean, latitude double, longitude double, price double, source string, property_type string, transaction_type string, city string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_rounds_of_changes_equal_making_anew(spark):
    r = random.Random(4)
    some = lambda k: (k, r.random() < 0.8, r.choice([None, 50.0, 50.001, 50.0012]), r.choice([14.0, 14.003]), r.choice([None, 0.1, 7.25, 1e6]), r.choice("ab"), "flat", "sale", r.choice([None, "X", "Y"]))
    state = {k: some(k) for k in range(60)}
    make = lambda: spark.createDataFrame(list(state.values()), SCHEMA).coalesce(2)
    before = make()
    cells, counts = I.cells(before), I.counts(before)
    for _ in range(4):
        for k in r.sample(sorted(state), 20):
            state[k] = some(k)
        for k in sorted(state)[: r.randint(0, 5)]:  # least ids go
            del state[k]
        state |= {k: some(k) for k in (r.randint(-50, 90), r.randint(-50, 90))}
        after = make()
        changed = I.changes(before, after)
        cells, counts = (spark.createDataFrame(x.collect(), x.schema) for x in (I.refreshed_cells(cells, changed, after), I.refreshed_counts(counts, changed)))
        assert rows_of(cells) == rows_of(I.cells(after).select(*cells.columns))
        assert rows_of(counts.where("cnt > 0")) == rows_of(I.counts(after))
        before = after


def test_only_cells_without_a_sure_least_id_are_read(spark):
    place = lambda k, lat, price=1.0: (k, True, lat, 14.0, price, "a", "flat", "sale", None)
    before = spark.createDataFrame([place(1, 50.0), place(2, 50.0), place(3, 51.0), place(4, 51.0)], SCHEMA)
    after = spark.createDataFrame([place(2, 50.0), place(3, 51.0), place(4, 51.0, 9.0)], SCHEMA)
    changed = I.changes(before, after)
    assert {r.id for r in changed.collect()} == {1, 4}
    found = {r.lat: r.min_id for r in I.refreshed_cells(I.cells(before), changed, after).collect()}
    assert found == {50.0: 2, 51.0: 3}
    # Listings of the cell that is sure are not needed.
    assert {r.lat: r.min_id for r in I.refreshed_cells(I.cells(before), changed, after.where("latitude < 50.5")).collect()} == found
    nothing = I.changes(before, before)
    assert nothing.isEmpty() and rows_of(I.refreshed_cells(I.cells(before), nothing, before)) == rows_of(I.cells(before))


def test_block_sample_is_whole_blocks(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40_000).repartition(20).write.option("parquet.block.size", 65536).parquet(path)
    blocks = spark.read.parquet(path).select("id", F.concat_ws("@", "_metadata.file_name", "_metadata.file_block_start").alias("block"))
    sizes = {r.block: r["count"] for r in blocks.groupBy("block").count().collect()}
    taken = metrics.file_blocks(spark.read.parquet(path), 0.4, 7)
    found = {r.block: r["count"] for r in taken.select(F.concat_ws("@", "_metadata.file_name", "_metadata.file_block_start").alias("block")).groupBy("block").count().collect()}
    assert 0 < len(found) < len(sizes) and all(sizes[b] == n for b, n in found.items())
    ids = lambda seed: sorted(r.id for r in metrics.file_blocks(spark.read.parquet(path), 0.4, seed).collect())
    assert ids(7) == ids(7) != ids(8)
