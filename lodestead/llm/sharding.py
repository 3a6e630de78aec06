"""Sharding by best-fit-decreasing bin packing.

Indivisible groups (rows with equal texts) sorted by size, largest first, enter the bin with the tightest remaining
capacity that still holds them; a balanced tree over the remaining capacities finds it. ``pack`` opens as few bins of a
fixed capacity as it can, ``pack_into`` fills a fixed number.

At scale the packing is split. Groups that hold a visible share of all bytes or rows are few by construction (at most
``2 * LARGE`` of them) and are packed first, together. All others are dealt into cells by a hash of their key, and each cell
packs its groups into its proportional share of what the large groups left of every bin; a cell holds a bounded number of
groups, and its error is about one of its smallest groups.

Defined results: a null text has size 1 and shares a group with the empty text; rows that repeat, ids included, each get a
slot of their own; null ids sort first; an empty table gives an empty result; other columns are ignored. A group larger
than a bin's capacity gets the emptiest bin, which then exceeds the others by as much: groups are never split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import spread, stored, table

SHARDS = 16
#: A group with over 1 / LARGE of all bytes or rows is packed before the others.
LARGE = 1024
#: Groups in a cell.
CELL = 100_000


class Capacities:
    """Balanced search tree (a treap with hashed priorities) of (remaining capacity, bin)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below ``key`` and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = Capacities._split(node[2], key)
            return node, right
        left, node[1] = Capacities._split(node[1], key)
        return left, node

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = Capacities._join(a[2], b)
            return a
        b[1] = Capacities._join(a, b[1])
        return b

    def add(self, remaining: int, bin_: int) -> None:
        key = (remaining, bin_)
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, None, None, zlib.crc32(b"%d,%d" % key)]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node, parent = right, None
        while node[1] is not None:
            node, parent = node[1], node
        if parent is None:
            right = node[2]
        else:
            parent[1] = node[2]
        self.root = self._join(left, right)
        return node[0]

    def take_emptiest(self) -> tuple[int, int]:
        node, parent = self.root, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            self.root = node[1]
        else:
            parent[2] = node[1]
        return node[0]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, sizes in descending order, opening bins of ``capacity`` only where none fits."""
    tree, bins, out = Capacities(), 0, np.empty(len(sizes), np.int64)
    for k, size in enumerate(map(int, sizes)):
        found = tree.take_tightest(size)
        if found is None:
            found, bins = (max(capacity, size), bins), bins + 1
        out[k] = found[1]
        tree.add(found[0] - size, found[1])
    return out


def pack_into(sizes: np.ndarray, capacities: np.ndarray) -> np.ndarray:
    """Bin of each item, sizes in descending order, for given bins; what fits nowhere goes to the emptiest."""
    tree, out = Capacities(), np.empty(len(sizes), np.int64)
    for k, capacity in enumerate(map(int, capacities)):
        tree.add(capacity, k)
    for k, size in enumerate(map(int, sizes)):
        remaining, bin_ = tree.take_tightest(size) or tree.take_emptiest()
        out[k] = bin_
        tree.add(remaining - size, bin_)
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    rows = stored(rows, "sharding-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = stored(groups, "sharding-groups")
    total, n_rows, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    large = (F.col("bytes") * LARGE > total) | (F.col("n") * LARGE > n_rows)

    # At most LARGE groups hold 1 / LARGE of the bytes, and as many of the rows.
    first = sorted(((r.bytes, r.group) for r in groups.where(large).collect()), key=lambda x: (-x[0], x[1]))
    capacities = np.full(shards, -(-total // shards), np.int64)
    placed = pack_into(np.array([b for b, _ in first], np.int64), capacities)
    np.subtract.at(capacities, placed, np.array([b for b, _ in first], np.int64))
    rest = max(1, int(np.maximum(capacities, 0).sum()))
    share = np.maximum(capacities, 0) / rest

    cells = max(64, -(-n_groups // CELL))

    def pack_cell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        bins = pack_into(frame["bytes"].to_numpy(), np.ceil(share * frame["bytes"].sum()))
        return pd.DataFrame({"group": frame["group"], "shard": bins.astype(np.int32)})

    cell = F.pmod(F.xxhash64("group"), F.lit(cells))
    small = groups.where(~large).select("group", "bytes", cell.alias("cell")).groupBy("cell").applyInPandas(pack_cell, "group string, shard int")
    # Large groups reach their rows by a broadcast of at most 2 * LARGE rows, so no key of the other join is hot.
    known = spark.createDataFrame([(g, int(s)) for (_, g), s in zip(first, placed, strict=True)], "group string, shard int")
    by_large = rows.join(F.broadcast(known), "group")
    by_small = rows.join(F.broadcast(known), "group", "left_anti").join(small, "group")
    return _slots(by_large.unionByName(by_small).select("doc_id", "size", "text_crc32", "shard"), n_rows)


def _slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Gapless slots from 0 in each shard: counts by (shard, bucket) give each bucket its first slot."""
    buckets = spread(n_rows)
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")), "sharding-placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(order))
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at") - 1).alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of near equal bytes."""
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
