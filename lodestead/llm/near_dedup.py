"""MinHash near-dedup by an inverted join on signature coordinates.

A document's set holds its distinct word shingles. Its signature has ``MINIMA`` coordinates, each the least of one hash over
the set, so a coordinate agrees with probability ``similarity``. Documents with equal sets are one node from the start. A
node is posted under its (coordinate, value) pairs, and pairs of nodes that collide ``MATCHES`` times are retained.

Prefix: all pairs of coordinate and value have one order, rare ones first (counts in ``CELLS`` hashed cells; any order is
right, this one keeps lists short). Two nodes that collide in ``MATCHES`` of ``MINIMA`` coordinates share one of their first
``MINIMA - MATCHES + 1``, so only these are posted and open pairs. Skip: in a list, collisions are counted on, some
coordinates at a time, and a pair goes as soon as the rest cannot bring it to the threshold; lists of one node, or of nodes
that are already linked, are skipped. What is retained is confirmed on the full sets.

No list emits all its pairs. Short lists give the pairs over the threshold. Long ones first give those of their most
central member; where components are left apart, members outside the largest one meet all members: sizes and collisions
are compared first, then fingerprints, and one link per pair of components that meets the similarity is given. Both sides
are dealt to tiles and meet by pairs of tiles, so that a group holds about two tiles even where all members of a list stay apart. Thus
every pair of different components that shares a list, collides often enough and meets the similarity is found.

A pair at similarity 0.8 has fewer collisions than the threshold with probability below 1e-6.

Defined results: a null text, or one without words, has the empty set, size 0 and is linked with nothing; a text with fewer
words than a shingle has one shingle, the whole sequence; rows that repeat an id are one document with all their links;
rows with a null id that share no set with another are unlinked, kept, and have a null component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import stored, table

MINIMA = 40
#: Collisions that a pair needs: at similarity 0.8 fewer have a probability of 2e-7.
MATCHES = 18
#: Cells of the counts that order coordinates, whatever the corpus.
CELLS = 1 << 18
SIMILARITY = 80
WORDS = 5
#: Longest list that gives all pairs over the threshold, and the members of a tile of a long one.
SHORT = 32
TILE = 1024
#: Parts in which a list meets its count.
SALTS = 8


@cache
def _keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(96).integers(1, 2**63, (3, 128), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0][:MINIMA], draw[1], draw[2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's word shingles."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    window, weights = np.zeros(n, np.uint64), _keys()[1]
    for k in range(words):
        window += word[k : k + n] * weights[k]
    window = np.sort(mixed(window))
    return window[np.append(True, window[1:] != window[:-1])]


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(out, (found[None, at : at + 4096] * _keys()[0][:, None]).min(axis=1), out=out)
    return out


SKETCH = StructType([StructField("n_shingles", LongType()), StructField("set_hash", BinaryType()), StructField("signature", BinaryType())])


def sketcher(words: int):
    @F.pandas_udf(SKETCH)
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = shingles(text, words)
            rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), minima(found).tobytes()) if len(found) else (0, None, None))
        return pd.DataFrame(rows, columns=SKETCH.names)

    return sketch


def items(signatures: pd.Series) -> np.ndarray:
    """The (coordinate, value) pairs of each signature, as 64-bit hashes."""
    values = np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, MINIMA)
    return mixed(mixed(values + np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def cell(found: np.ndarray) -> np.ndarray:
    return (found % np.uint64(CELLS)).astype(np.int64)


def _count_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros(CELLS, np.int64)
    for frame in frames:
        if len(frame):
            np.add.at(counts, cell(items(frame["signature"])), 1)
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"cell": at, "n": counts[at]})


def prefixer(nodes: DataFrame):
    """Pandas UDF: signature -> the items to post; and the bytes of the signature that collisions are counted on."""
    found = nodes.select("signature").mapInPandas(_count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # a row per cell
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"]] = found["n"]
    often = nodes.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("keys array<long>, low binary")
    def prefix(signatures: pd.Series) -> pd.DataFrame:
        found = items(signatures)
        order = np.lexsort((found, often.value[cell(found)]), axis=-1)[:, : MINIMA - MATCHES + 1]
        low = np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, MINIMA) >> np.uint64(40)
        return pd.DataFrame({"keys": list(np.take_along_axis(found, order, axis=1).view(np.int64)), "low": [x.tobytes() for x in low.astype(np.uint8)]})

    return prefix


@F.pandas_udf(LongType())
def common_size(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def colliding(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) collide often enough; pairs that can no longer do so are not counted on."""
    at, count = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, MINIMA, 8):
        count = count + (low[a[at], k : k + 8] == low[b[at], k : k + 8]).sum(axis=1)
        reach = count + max(0, MINIMA - k - 8) >= MATCHES
        at, count = at[reach], count[reach]
    return at


def _short_lists(key, comp, size, low, similarity) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all lists of at most SHORT members, at once."""
    left, right = [], []
    for gap in range(1, SHORT):
        a = np.flatnonzero(key[gap:] == key[:-gap])
        if not len(a):
            break
        b = a + gap
        near = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]))
        a, b = a[near], b[near]
        near = colliding(low, a, b)
        left.append(a[near])
        right.append(b[near])
    return np.concatenate(left or [np.zeros(0, np.int64)]), np.concatenate(right or [np.zeros(0, np.int64)])


def _central(comp, size, low, similarity) -> tuple[int, np.ndarray]:
    """The member whose minima are the most usual ones, and the members that match it."""
    usual = np.array([np.bincount(column, minlength=256).argmax() for column in low.T], np.uint8)
    k = int((low == usual).sum(axis=1).argmax())
    near = np.flatnonzero((comp != comp[k]) & (100 * np.minimum(size, size[k]) >= similarity * np.maximum(size, size[k])))
    return k, near[colliding(low, near, np.full(len(near), k))]


def _links(comp: np.ndarray, size: np.ndarray, low: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, turn: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Pairs that join components, of rows that ask with rows that do not.

    Sizes and collisions come first. Where they leave a row of a component that is not joined yet, fingerprints in common
    are counted by merging posting lists. ``turn`` orders rows that stand on both sides of a list: such a pair is looked at
    once.
    """
    held = np.flatnonzero(~asks)
    names, member = np.unique(comp, return_inverse=True)
    lengths = np.fromiter((len(sets[j]) for j in held), np.int64, len(held))
    values, where = np.unique(np.concatenate([sets[j] for j in held]), return_inverse=True)
    posted = np.repeat(np.arange(len(held)), lengths)[np.argsort(where, kind="stable")]
    counts = np.bincount(where, minlength=len(values))
    starts = np.cumsum(counts) - counts
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.flatnonzero(asks).tolist():
        mine = find(member[k])
        near = np.flatnonzero((comp[held] != comp[k]) & ((turn[held] < 0) | (turn[held] >= turn[k])) & (100 * np.minimum(size[held], size[k]) >= similarity * np.maximum(size[held], size[k])))
        near = near[colliding(low, held[near], np.full(len(near), k))]
        apart = {c for c in np.unique(member[held[near]]).tolist() if find(c) != mine}
        if not apart:
            continue
        near = near[np.isin(member[held[near]], list(apart))]
        at = np.minimum(np.searchsorted(values, sets[k]), len(values) - 1)
        at = at[values[at] == sets[k]]
        stops = np.cumsum(counts[at])
        merged = posted[np.repeat(starts[at] - (stops - counts[at]), counts[at]) + np.arange(stops[-1] if len(at) else 0)]
        common = np.bincount(merged, minlength=len(held))[near]
        near = near[100 * common >= similarity * (size[k] + size[held[near]] - common)]
        for c, first in zip(*np.unique(member[held[near]], return_index=True), strict=True):
            a, b = find(member[k]), find(c)
            if a != b:
                root[a] = b
                out.append((k, int(held[near[first]])))
    return out


def _by_list(work):
    """mapInPandas function over rows sorted by key, whole lists at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            cut = int(np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1]))  # the last list may go on
            if cut:
                yield work(pd.concat([*held, frame.iloc[:cut]]))
                held = []
            held.append(frame.iloc[cut:])
        if held:
            yield work(pd.concat(held))

    return run


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return starts, np.diff(np.append(starts, len(key)))


def first_pairs(similarity: int):
    """All pairs of short lists over the threshold, and those of the central member of long ones."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        key, comp, size, node = (frame[c].to_numpy() for c in ("key", "comp", "n_shingles", "set_hash"))
        low = np.frombuffer(b"".join(frame["low"]), np.uint8).reshape(len(frame), -1)
        starts, lengths = _runs(key)
        at = np.flatnonzero(np.repeat(lengths <= SHORT, lengths))
        a, b = _short_lists(key[at], comp[at], size[at], low[at], similarity)
        left, right = [at[a]], [at[b]]
        for start, length in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
            rows = slice(start, start + length)
            k, near = _central(comp[rows], size[rows], low[rows], similarity)
            left.append(np.full(len(near), start + k))
            right.append(near + start)
        return pd.DataFrame({"a": node[np.concatenate(left)], "b": node[np.concatenate(right)]})

    return _by_list(work)


def last_links(similarity: int):
    """Links between the components that are left in long lists, within each pair of tiles."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        key, comp, size, node, prints, asks, turn = (frame[c].to_numpy() for c in ("key", "comp", "n_shingles", "set_hash", "prints", "asks", "turn"))
        low = np.frombuffer(b"".join(frame["low"]), np.uint8).reshape(len(frame), -1)
        out = []
        for start, length in zip(*_runs(key), strict=True):
            rows = slice(start, start + length)
            if asks[rows].any() and not asks[rows].all():
                found = _links(comp[rows], size[rows], low[rows], [np.frombuffer(x, np.uint32) for x in prints[rows]], asks[rows], turn[rows], similarity)
                out += [(node[start + a], node[start + b]) for a, b in found]
        return pd.DataFrame(out, columns=["a", "b"])

    return _by_list(work)


def tiled(rows: DataFrame, apart: DataFrame) -> DataFrame:
    """Members of long lists, as those that ask and those that are asked, under the pairs of tiles in which they meet.

    ``rows`` has (key, count, set_hash, comp, ...); ``apart`` the lists with several components: (key, salt, largest, asking),
    the last the number of members outside the largest component. Those that ask are dealt to tiles of their own, all members to
    tiles of their list, so that a group holds about two tiles, however many of a list's members are apart.
    """
    tiles, askers = F.ceil(F.col("count") / TILE), F.ceil(F.col("asking") / TILE)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("set_hash"), F.lit(SALTS)).cast("int")).join(apart, ["key", "salt"]).withColumn("outside", F.col("comp") != F.col("largest"))
    turn = F.when(F.col("outside"), F.shiftrightunsigned(F.xxhash64("set_hash"), 1)).otherwise(-1)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    asked = F.transform(every(askers), lambda a: F.struct(a.alias("x"), F.pmod(F.xxhash64("set_hash", "key"), tiles).cast("long").alias("y"), F.lit(False).alias("asks")))
    asking = F.transform(every(tiles), lambda t: F.struct(F.pmod(F.xxhash64("key", "set_hash"), askers).cast("long").alias("x"), t.alias("y"), F.lit(True).alias("asks")))
    places = F.when(F.col("outside"), F.concat(asked, asking)).otherwise(asked)
    rows = rows.withColumns({"turn": turn, "at": F.explode(places)})
    return rows.withColumns({"key": F.when(tiles * askers > 1, F.xxhash64("key", "at.x", "at.y")).otherwise(F.col("key")), "asks": F.col("at.asks")})


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, of each node in ``edges`` (a, b), by large-star and small-star steps."""
    both = lambda e: e.union(e.select("b", "a")).toDF("u", "v")
    star = lambda e: e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "near-edges")
    last = mark(edges)
    while last[0]:
        near = both(edges)
        edges = near.join(star(near), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = star(down)
        linked = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = stored(linked.union(low.select("u", "m")).where("a <> b").distinct(), "near-edges")
        if (now := mark(edges)) == last:
            break
        last = now
    stars = edges.groupBy("a").agg(F.min("b").alias("comp"))
    return stars.union(edges.select("b", "b").distinct()).toDF("node", "comp")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``; links need 100 * common >= similarity * union."""
    text = F.col("text").cast("string")
    sketches = stored(docs.select("doc_id", sketcher(words)(text).alias("s")).select("doc_id", "s.*"), "near-sketches")
    nodes = sketches.where("n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "near-nodes")
    prefix = prefixer(nodes)
    known = stored(nodes.where("rep IS NOT NULL").select("set_hash", "rep", "n_shingles", prefix("signature").alias("p")).select("set_hash", "rep", "n_shingles", "p.*"), "near-prefixes")
    postings = known.select("set_hash", F.explode("keys").alias("key")).withColumn("salt", F.pmod(F.xxhash64("set_hash"), F.lit(SALTS)).cast("int"))
    # Lists of several meet their counts in parts.
    parts = postings.groupBy("key", "salt").count().groupBy("key").agg(F.sum("count").alias("count"), F.collect_list("salt").alias("salts"))
    several = parts.where("count > 1").select("key", "count", F.explode("salts").alias("salt"))
    posted = stored(postings.join(several, ["key", "salt"]).drop("salt"), "near-posted")
    members = stored(known.drop("keys").join(posted.select("set_hash").distinct(), "set_hash"), "near-members")

    @F.pandas_udf("binary")
    def full(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, words).tobytes() for x in texts], dtype=object)

    wanted = members.select(F.col("rep").alias("doc_id"), F.col("set_hash").alias("wanted"))
    found = docs.select("doc_id", text.alias("text")).join(wanted, "doc_id").select("wanted", full("text").alias("shingles"))
    digest = F.pandas_udf(lambda xs: pd.Series([xxhash.xxh3_128_digest(x) for x in xs], dtype=object), "binary")
    same = found.where(digest("shingles") == F.col("wanted"))  # a repeated id may bring another text
    sets = stored(same.select(F.col("wanted").alias("set_hash"), "shingles"), "near-sets")

    # An id that brings several sets links them.
    named = sketches.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    many = named.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    bridges = named.join(many, "doc_id").join(nodes.select("set_hash", "rep"), "set_hash").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    tiles = F.ceil(F.col("count") / TILE)
    tile = F.pmod(F.xxhash64("set_hash", "key"), tiles)  # other lists deal the same members otherwise
    rows = posted.join(members.withColumnRenamed("rep", "comp"), "set_hash").withColumn("key", F.when(tiles > 1, F.xxhash64("key", tile)).otherwise(F.col("key")))
    rows = rows.select("key", "set_hash", "comp", "n_shingles", "low").repartition("key").sortWithinPartitions("key", "set_hash")
    edges = stored(bridges.union(_confirmed(rows.mapInPandas(first_pairs(similarity), "a binary, b binary"), sets, members, similarity)), "near-links")
    comps = stored(components(edges), "near-components")

    # Long lists whose members are not one component yet.
    facts = members.join(comps, members.rep == comps.node, "left").select("set_hash", "n_shingles", "low", F.coalesce("comp", "rep").alias("comp"))
    rows = posted.where(F.col("count") > SHORT).join(facts, "set_hash")
    sizes = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", "count").alias("largest"), F.count("*").alias("comps"), (F.sum("count") - F.max("count")).alias("asking"))
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    apart = sizes.where("comps > 1").select("key", "largest", "asking", each)

    @F.pandas_udf("binary")
    def brief(found: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.uint64).astype(np.uint32).tobytes() for x in found], dtype=object)

    rows = tiled(rows, apart).join(sets.select("set_hash", brief("shingles").alias("prints")), "set_hash")
    rows = rows.select("key", "set_hash", "comp", "n_shingles", "low", "prints", "asks", "turn").repartition("key").sortWithinPartitions("key", "set_hash")
    more = _confirmed(rows.mapInPandas(last_links(similarity), "a binary, b binary"), sets, members, similarity)
    # What is linked already counts as one edge each.
    edges = stored(comps.select("node", "comp").union(more), "near-links").toDF("a", "b")
    comps = stored(components(edges), "near-components")

    classes = nodes.select("set_hash", "rep").join(comps, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("comp", "rep").alias("class"))
    rows = sketches.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left")
    component = F.coalesce("class", "doc_id")
    kept = F.when(F.col("doc_id").isNull(), component.isNull()).otherwise(F.col("doc_id") == component)
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _confirmed(pairs: DataFrame, sets: DataFrame, members: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough, as edges between document ids."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    known = sets.join(members.select("set_hash", "rep", "n_shingles"), "set_hash")
    side = lambda c: known.select(F.col("set_hash").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("n_shingles").alias(f"n_{c}"), F.col("shingles").alias(f"set_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", common_size("set_a", "set_b"))
    linked = joined.where(100 * F.col("common") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("common")))
    return linked.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles), with its columns unchanged."""
    found = near_duplicates(docs)  # rows without an id cannot be told apart, and stay
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM d),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, u.b FROM r JOIN u ON r.reached = u.a),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m ON m.node = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
