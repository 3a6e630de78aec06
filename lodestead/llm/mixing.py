"""Mixing sources to target weights.

Each source's words form one stream, cut into blocks of fixed length. The mix fills output shards of SLOTS slots. A
multinomial draw per shard says how many of its slots each source gets, in proportion to the targets; a source's slots are
numbered through the shards, and a pseudorandom permutation of its block indexes (a keyed Feistel network) maps the number
to a block, a new pass starting when all blocks are used. Blocks join by (source, index). Draws beyond a source's target go
to those short of theirs, and the last draw of a source is cut, so that its words meet the target.

Defined results: a null text has size 0; the null source is a source of its own, last in order; rows that repeat, ids
included, are separate stretches of the stream; an empty table, or one without words, takes nothing; other columns are
ignored. Order inside a stream, draws and permutations depend on the data and the seed alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import spread, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
#: Blocks in an output shard (the last one has what is left), shards that one task counts, and pools that they draw from.
SLOTS = 1 << 14
RUN = 8
POOLS = 4096
SEED = 20


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser; wraps."""
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """Pseudorandom permutation of range(n): four Feistel rounds on the next even number of bits, cycle walking."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.low = np.uint64((1 << self.half) - 1)
        self.keys = [int(_mix(np.array([(key * 4 + k) & 0xFFFFFFFFFFFFFFFF], np.uint64), SEED)[0]) for k in range(4)]

    def _rounds(self, x: np.ndarray, keys: list[int], inverse: bool) -> np.ndarray:
        half = np.uint64(self.half)
        a, b = x >> half, x & self.low
        for key in keys:
            if inverse:
                a, b = b ^ (_mix(a, key) & self.low), a
            else:
                a, b = b, a ^ (_mix(b, key) & self.low)
        return (a << half) | b

    def __call__(self, x: np.ndarray, inverse: bool = False) -> np.ndarray:
        keys = self.keys[::-1] if inverse else self.keys
        y = self._rounds(np.asarray(x, np.uint64), keys, inverse)
        while (out := y >= self.n).any():
            y[out] = self._rounds(y[out], keys, inverse)
        return y.astype(np.int64)


@F.pandas_udf(LongType())
def word_count(texts: pd.Series) -> pd.Series:
    return pd.Series([0 if x is None else len(x.encode("utf-8", "surrogatepass").split()) for x in texts], dtype="int64")


def ranked(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with ``rank`` from 0: ranges are numbered from the counts of those before them."""
    spark, n = sources.sparkSession, 16
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    ranges = stored(sources.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mixing-sources")
    counts = dict(ranges.groupBy("part").count().collect())  # one row per range
    starts = spark.createDataFrame([(p, sum(c for q, c in counts.items() if q < p)) for p in counts] or [(0, 0)], "part int, start long")
    within = Window.partitionBy("part").orderBy(*order)
    return ranges.join(F.broadcast(starts), "part").select(*sources.columns, (F.col("start") + F.row_number().over(within) - 1).alias("rank"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``weight`` and ``target``: shares by weight, none above MOST times its size."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("double")
    known = stored(ranked(sources).withColumn("weight", weight), "mixing-weights")
    cap, level = F.col("source_size") * F.lit(MOST), 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        total, taken, free = known.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        new = (SHARE * (total or 0) - (taken or 0.0)) / free if free else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return known.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def drawn_counts(shard: int, size: int, shares: np.ndarray, seed: int = SEED) -> np.ndarray:
    """How many of a shard's slots each pool gets: a multinomial draw of its own."""
    return np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, shares)


def budgets(sources: DataFrame) -> DataFrame:
    """(rank, blocks, n, full, rest): how many draws each source has; all are of BLOCK words but number ``full``, of ``rest``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                blocks, words = -(-r.source_size // BLOCK), int(r.target + 0.5)
                if not blocks or not words:
                    continue
                short, last = BLOCK * blocks - r.source_size, int(Permutation(blocks, r.rank)(np.array([blocks - 1]), inverse=True)[0])
                held = lambda n: n * BLOCK - short * ((n > last) + (n > last + blocks))  # noqa: B023, E731
                full = words // BLOCK
                while full < 2 * blocks and held(full + 1) <= words:
                    full += 1
                n = full + (words > held(full) and full < 2 * blocks)
                out.append((r.rank, blocks, n, full, words - held(full)))
            yield pd.DataFrame(out, columns=["rank", "blocks", "n", "full", "rest"])

    return sources.select("rank", "source_size", "target").mapInPandas(count, "rank long, blocks long, n long, full long, rest long")


DRAW = "rank long, block long, words long, turn long, shard long, slot long"


def draws(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(rank, block, words, turn, shard, slot): the block that each slot of each output shard holds.

    Sources with at least a POOLS-th of all draws are pools of their own, so at most POOLS of them; all others share one.
    Every shard draws its counts of pools. Pools number their slots through the shards; a pool that was drawn more often
    than it has draws gives the surplus to those that were drawn less, in order, so that all targets are met.
    """
    spark = sources.sparkSession
    known = stored(budgets(sources), "mixing-budgets")
    total = known.agg(F.sum("n")).first()[0] or 0
    large = known.where(F.col("n") * POOLS >= total).orderBy("rank").collect()  # at most POOLS rows
    small = total - sum(r.n for r in large)
    n = np.array([r.n for r in large] + [small] * bool(small), np.int64)
    shards, shares = -(-total // SLOTS), n / max(total, 1)
    sizes = lambda shard: min(SLOTS, total - shard * SLOTS)
    runs = -(-shards // RUN)
    tasks = max(1, min(runs, 2 * spark.sparkContext.defaultParallelism), -(-runs // 64))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for run in frame["id"]:
                counts = sum(drawn_counts(k, sizes(k), shares, seed) for k in range(run * RUN, min(run * RUN + RUN, shards)))
                yield pd.DataFrame({"run": run, "pool": np.arange(len(n)), "n": counts})

    sums = stored(spark.range(0, runs, 1, tasks).mapInPandas(add, "run long, pool long, n long"), "mixing-counts")
    drawn = np.zeros(len(n), np.int64)
    for r in sums.groupBy("pool").agg(F.sum("n").alias("n")).collect():  # a row per pool
        drawn[r.pool] = r.n
    before = Window.partitionBy("pool").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("pool", "start"))).alias("pools"))
    surplus, missing = np.maximum(drawn - n, 0), np.maximum(n - drawn, 0)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        permutes = [Permutation(r.blocks, r.rank) for r in large]
        for frame in frames:
            for run, pools in zip(frame["run"], frame["pools"], strict=True):
                at = np.array([x["start"] for x in pools], np.int64)
                for shard in range(run * RUN, min(run * RUN + RUN, shards)):
                    counts = drawn_counts(shard, sizes(shard), shares, seed)
                    pool = np.repeat(np.arange(len(n)), counts)
                    number = at[pool] + np.arange(len(pool)) - np.repeat(np.cumsum(counts) - counts, counts)
                    at = at + counts
                    over = np.flatnonzero(number >= n[pool])
                    place = (np.cumsum(surplus) - surplus - n)[pool[over]] + number[over]
                    pool[over] = np.searchsorted(np.cumsum(missing), place, side="right")
                    number[over] = (drawn - np.cumsum(missing) + missing)[pool[over]] + place
                    rank, block, words, turn = np.full(len(pool), -1), number.copy(), np.zeros(len(pool), np.int64), np.zeros(len(pool), np.int64)
                    for k in np.flatnonzero(counts[: len(large)] + missing[: len(large)]).tolist():
                        mine, r = np.flatnonzero(pool == k), large[k]
                        i = number[mine]
                        rank[mine], block[mine], words[mine], turn[mine] = r.rank, permutes[k](i % r.blocks), np.where(i < r.full, BLOCK, r.rest), i // r.blocks
                    yield pd.DataFrame({"rank": rank, "block": block, "words": words, "turn": turn, "shard": shard, "slot": Permutation(len(pool), shard)(np.arange(len(pool)))})

    slots = starts.repartition(tasks).mapInPandas(fill, DRAW)
    return slots.where("rank >= 0").unionByName(_shared(known, slots, total, small)) if small else slots


def _shared(known: DataFrame, slots: DataFrame, total: int, small: int) -> DataFrame:
    """The slots of the shared pool: its sources' draws stand one after another and are permuted as a whole."""
    rest = known.where(F.col("n") * POOLS < total)
    part = F.floor(F.col("rank") / F.lit(1 << 16))
    sums = rest.groupBy(part.alias("part")).agg(F.sum("n").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per 65,536 sources
    firsts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = rest.withColumn("part", part).join(firsts, "part").withColumn("first", F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    chunks = placed.where("n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS))))

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = Permutation(small, -1)
        for frame in frames:
            for r in frame.itertuples():
                i = np.arange(r.chunk * SLOTS, min(r.chunk * SLOTS + SLOTS, r.n))
                yield pd.DataFrame({"number": whole(r.first + i, inverse=True), "rank": r.rank, "block": Permutation(r.blocks, r.rank)(i % r.blocks), "words": np.where(i < r.full, BLOCK, r.rest), "turn": i // r.blocks})

    given = chunks.repartition(1 + small // (4 * SLOTS), "rank", "chunk").mapInPandas(take, "number long, rank long, block long, words long, turn long")
    free = slots.where("rank < 0").select(F.col("block").alias("number"), "shard", "slot")
    return given.hint("merge").join(free.hint("merge"), "number").select("rank", "block", "words", "turn", "shard", "slot")


def sized(docs: DataFrame, extra: list | None = None) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), *(extra or []))


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with rank, size and first word in their source's stream; rows that repeat are numbered by ``copy``."""
    rows = sized(docs, [F.xxhash64(F.col("text")).alias("text_hash")])
    # Rows that repeat as a whole are counted first, so that no group holds them all.
    known = stored(rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies")), "mixing-sizes")
    words = F.col("size") * F.col("copies")
    sources = stored(targets(known.groupBy("source").agg(F.sum(words).alias("source_size"))), "mixing-targets")
    n_rows = known.count()
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_hash"), F.lit(spread(n_rows))).cast("int")
    placed = known.withColumn("bucket", bucket)
    # Sums by (source, bucket) give each bucket its first word, so no source is ordered as a whole.
    sums = placed.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "text_hash")
    within = placed.withColumn("upto", F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(order))
    located = within.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    located = located.withColumn("first", F.col("start") + F.col("upto") - words).drop("s", "b", "start", "upto")
    facts = sources.select(F.col("source").alias("s"), "source_size", "target", "rank")
    located = located.join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    located = located.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("offset", F.col("first") + F.col("copy") * F.col("size"))
    return stored(located.drop("first", "copies"), "mixing-offsets"), sources


ROW = ["rank", "bucket", "n", "copy"]


def pieces(located: DataFrame, *extra: str) -> DataFrame:
    """The stretch of each block that each document fills: words ``low`` to ``high`` of the block."""
    span = F.sequence(F.floor(F.col("offset") / BLOCK), F.floor((F.col("offset") + F.col("size") - 1) / BLOCK))
    cut = located.where("size > 0").select(*ROW, *extra, "offset", "size", F.explode(span).alias("block"))
    low = F.greatest(F.col("offset") - F.col("block") * BLOCK, F.lit(0))
    high = F.least(F.col("offset") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    return cut.select(*ROW, *extra, "offset", "block", low.alias("low"), high.alias("high"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where the words went: n_slots, first_shard, first_slot (null: nowhere)."""
    located, sources = mixed(docs)
    # The planner takes the draws to be as small as the table of sources they come from, and would broadcast them; they
    # grow with the words, hence the hints.
    given = pieces(located).join(draws(sources).hint("merge"), ["rank", "block"]).where("low < words")
    given = given.groupBy(*ROW).agg(F.sum(F.least("high", "words") - F.col("low")).alias("taken"), F.count("*").alias("n_slots"), F.min(F.struct("shard", "slot")).alias("place"))
    rows = located.join(given.hint("merge"), ROW, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_slots")]
    return rows.select("doc_id", "size", "source_size", "target", *counts, F.col("place.shard").alias("first_shard"), F.col("place.slot").alias("first_slot"))


def shards(docs: DataFrame) -> DataFrame:
    """(shard, slot, rank, block, words): the mix itself, a row per slot; blocks count in their source's stream."""
    _, sources = mixed(docs)
    return draws(sources).select("shard", "slot", "rank", "block", "words")


SPAN = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def cut_text(text: str, runs: list[tuple[int, int]]) -> str:
    """The words of the given ranges; a text taken whole stays as it is."""
    joined: list[list[int]] = []
    for a, b in sorted(runs):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    words = [(m.start(), m.end()) for m in SPAN.finditer(text)]
    if joined == [[0, len(words)]]:
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row per document and turn, with the words the turn takes; a second turn repeats the id.

    Rows alike in id, source and text take their other columns from one of them.
    """
    columns = docs.columns
    key = [F.xxhash64("doc_id", "source", F.isnull("source").cast("int")).alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_text")]
    located, sources = mixed(docs)
    drawn = draws(sources).select("rank", "block", "words", "turn")
    given = pieces(located, "doc_id", "source", "text_hash").join(drawn.hint("merge"), ["rank", "block"]).where("low < words")
    first, last = (F.col("block") * BLOCK + x - F.col("offset") for x in (F.col("low"), F.least("high", "words")))
    turns = given.groupBy(*ROW, "doc_id", "source", "text_hash", "turn").agg(F.collect_list(F.struct(first.alias("first"), last.alias("last"))).alias("_runs"))
    turns = stored(turns.select(key[0], F.col("text_hash").alias("_text"), "_runs"), "mixing-turns")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_text(x, [(r["first"], r["last"]) for r in some]) for x, some in zip(texts, runs, strict=True)], dtype=object)

    # The inputs' own columns travel in one struct, so none of their names can clash.
    each = docs.where("text IS NOT NULL").select(F.struct(*columns).alias("_row"), *key).dropDuplicates(["_id", "_text"])
    rows = each.join(turns.hint("merge"), ["_id", "_text"])
    rows = rows.withColumn("_cut", cut(F.col("_row.text").cast("string"), F.col("_runs")))
    value = {c: F.col("_row").getField(c) for c in columns} | {"text": F.col("_cut")}
    if "n_chars" in columns:
        value["n_chars"] = F.char_length("_cut").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[value[c].alias(c) for c in columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words the production mix takes of each."""
    return taken(table(spark, sf_dir, "documents"))
