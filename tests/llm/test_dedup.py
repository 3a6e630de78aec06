import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import as_rows

from lodestead.llm import near_dedup, suffix_dedup


# -- suffix arrays


def laid_out(pieces):
    lengths = np.array([len(p) for p in pieces])
    return np.frombuffer(b"".join(pieces), np.uint8), lengths, np.repeat(np.cumsum(lengths), lengths)


@pytest.mark.parametrize("letters", [1, 2, 6])
def test_suffix_array_and_prefixes(letters):
    r = np.random.default_rng(letters)
    for _ in range(60):
        pieces = list({bytes(r.integers(97, 97 + letters, r.integers(1, 40)).astype(np.uint8)) for _ in range(r.integers(1, 20))})
        text, lengths, ends = laid_out(pieces)
        order, rank = suffix_dedup.suffix_array(text, ends)
        suffix = [bytes(text[i : ends[i]]) for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffix[i], i)) and (rank[order] == np.arange(len(text))).all()
        limit = int(r.integers(2, 9))
        common = suffix_dedup.common_prefixes(text, ends, np.cumsum(lengths) - lengths, order, rank, limit)
        for a in range(1, len(order)):
            x, y = suffix[order[a - 1]], suffix[order[a]]
            same = next((h for h in range(limit) if h >= min(len(x), len(y)) or x[h] != y[h]), limit)
            assert common[a] == (same if len(y) >= limit else 0)


@pytest.mark.parametrize("positions", [60000, 64, 7])
def test_least_ids_in_one_array_and_in_several(positions):
    r = np.random.default_rng(5)
    for _ in range(40):
        pieces = [bytes(r.integers(97, 99, r.integers(4, 30)).astype(np.uint8)) for _ in range(r.integers(1, 30))]
        pieces += pieces[:3] + [b"\0\0\0\0", b"a\0\0\0\0"]
        ids, first = r.integers(0, 50, len(pieces)), {}
        for p, i in zip(pieces, ids, strict=True):
            for a in range(len(p) - 3):
                first[p[a : a + 4]] = min(first.get(p[a : a + 4], 99), i)
        found = suffix_dedup.least_ids(np.frombuffer(b"".join(pieces), np.uint8), np.array(list(map(len, pieces))), ids, 4, positions)
        assert found.tolist() == [first[p[a : a + 4]] for p in pieces for a in range(len(p) - 3)]


def brute_passages(rows, n=50):
    number = lambda d: suffix_dedup.LAST if d is None else d
    first, out = {}, Counter()
    for d, t in rows:
        for k in range(len(t) - n + 1):
            first[t[k : k + n]] = min(first.get(t[k : k + n], suffix_dedup.LAST), number(d))
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - n + 1):
            if first[t[k : k + n]] < number(d):
                gone[k : k + n] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def as_bytes(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def line_in_other_surroundings(n):
    """Documents with one line of 40 bytes, most of them with surroundings of their own."""
    r = np.random.default_rng(3)
    some = lambda: bytes(r.integers(97, 123, 60).astype(np.uint8))
    twice = [some() for _ in range(4)]
    return [(k, (twice[k % 4] if k % 5 == 0 else some()) + b"Share this page with your friends today!" + some()) for k in range(n)]


def test_contexts_of_a_crowded_anchor_are_dealt_by_window():
    rows = line_in_other_surroundings(300)
    chunk = suffix_dedup.Chunk(None, [d for d, _ in rows], [t for _, t in rows])
    _, _, prints, doc = chunk.runs()
    every = np.unique(suffix_dedup.brief(prints, 1))
    anchors, counts = np.unique(prints, return_counts=True)
    crowded = anchors[counts >= 100]
    assert len(crowded)
    part = suffix_dedup.Part()
    first, windows, _, context = part.add(chunk, every, 1, 64, crowded)
    # All windows are still there, and equal ones are one context in one bucket.
    whole = sum(max(len(t) - 49, 0) for _, t in rows)
    assert windows.sum() == whole and len(part.index) == len(part.bucket)
    of_crowd = np.bincount(np.array(part.bucket)[np.array(list(map(len, part.index))) == 50], minlength=64)
    assert of_crowd.max() < 0.1 * of_crowd.sum()


def test_passages_with_a_crowded_anchor(spark, labelled):
    rows = line_in_other_surroundings(300)
    docs = spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id long, text string").repartition(3)
    for crowd in (20, 1):
        assert Counter(tuple(r) for r in suffix_dedup.repeated_passages(docs, crowd=crowd).collect()) == brute_passages(rows)
    assert Counter(tuple(r) for r in suffix_dedup.repeated_passages(labelled, crowd=2).collect()) == brute_passages(as_bytes(labelled))


def test_passages(docs, clashing, empty, labelled):
    found = suffix_dedup.repeated_passages(docs)
    assert Counter(tuple(r) for r in found.collect()) == brute_passages(as_bytes(docs))
    assert as_rows(suffix_dedup.repeated_passages(clashing)) == as_rows(found)
    assert suffix_dedup.repeated_passages(empty).collect() == []
    assert Counter(tuple(r) for r in suffix_dedup.repeated_passages(labelled).collect()) == brute_passages(as_bytes(labelled))


def test_many_shards_and_arrays(spark, docs, labelled, monkeypatch):
    """Row groups of a few documents are shards of their own, with arrays of a few contexts and small buckets."""
    for name, value in (("GROUP", 4096), ("MERGED", 3000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    for rows in (docs.coalesce(1), labelled.coalesce(2)):
        again = rows.union(rows.withColumn("doc_id", F.col("doc_id") + 7))  # a third or more are copies
        for some in (rows, again.coalesce(2)):
            assert Counter(tuple(r) for r in suffix_dedup.repeated_passages(some, positions=300).collect()) == brute_passages(as_bytes(some))


def test_shards_are_dealt_evenly(spark):
    shards = suffix_dedup.numbered(spark.range(40).select(F.col("id").cast("string").alias("path"), F.lit(0).alias("group")), 40)
    assert shards.repartition(40, "shard").groupBy(F.spark_partition_id()).count().where("count = 1").count() == 40


def test_small_parts_and_blocks_change_nothing(docs):
    """Contexts sent off often, and hashed in short blocks."""
    rows = as_bytes(docs)
    texts, ids = [t for _, t in rows], [d for d, _ in rows]
    whole = suffix_dedup.Chunk(None, ids, texts)
    lengths = whole.stops - whole.starts
    usual = suffix_dedup.anchored(whole.text, np.repeat(whole.stops, lengths))
    block, suffix_dedup.BLOCK = suffix_dedup.BLOCK, 1000
    try:
        short = suffix_dedup.anchored(whole.text, np.repeat(whole.stops, lengths))
    finally:
        suffix_dedup.BLOCK = block
    spread = lambda runs: [(k, p) for a, b, p in zip(*map(np.ndarray.tolist, runs), strict=True) for k in range(a, b + 1)]
    assert spread(usual) == spread(short)
    assert sum(len(t) >= 50 and len(t) - 49 for t in texts) == len(spread(usual))


def test_passage_stage(docs, clashing, empty, spark):
    out = suffix_dedup.stage(spark, docs, "")
    assert out.schema == docs.schema and out.count() == docs.count()
    kept = {r.doc_id: r.text for r in out.where("doc_id IS NOT NULL").collect()}
    assert kept[12] and kept[13] == "" and kept[21] is None and kept[0] == next(r.text for r in docs.collect() if r.doc_id == 0)
    assert suffix_dedup.stage(spark, empty, "").collect() == []
    assert suffix_dedup.stage(spark, clashing, "").columns == clashing.columns


# -- near-duplicates


def word_sets(rows, n):
    out = []
    for d, t in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, frozenset(tuple(found[k : k + n]) for k in range(len(found) - n + 1)) if len(found) >= n else frozenset([tuple(found)] if found else [])))
    return out


def brute_classes(rows, n):
    sets = word_sets(rows, n)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (d, x) in enumerate(sets):
        for b, (e, y) in enumerate(sets[:a]):
            same_id = d is not None and d == e and x and y
            if x and y and (same_id or 100 * len(x & y) >= 80 * len(x | y)):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(sets):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return Counter((d, len(x), least.get(find(k)), least.get(find(k)) == d if d is not None else least.get(find(k)) is None) for k, (d, x) in enumerate(sets))


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(n, docs, labelled):
    for table in (docs, labelled):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        assert Counter(tuple(r) for r in near_dedup.near_duplicates(table, n).collect()) == brute_classes(rows, n)


def test_long_lists(spark, monkeypatch):
    """A large family around the threshold, with lists longer than a tile."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "TILE", 40)
    r = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        edited = list(base)
        for at in r.choice(120, int(r.integers(0, 9)), replace=False):
            edited[at] = f"x{k}_{at}"
        rows.append((k, " ".join(edited)))
    rows += [(200 + k, " ".join(base[:30] + [f"y{k}_{j}" for j in range(60)])) for k in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    assert Counter(tuple(x) for x in found.collect()) == brute_classes(rows, 4)


def test_near_edges(clashing, docs, empty, spark):
    assert as_rows(near_dedup.near_duplicates(clashing)) == as_rows(near_dedup.near_duplicates(docs))
    assert near_dedup.near_duplicates(empty).collect() == []
    out = near_dedup.stage(spark, docs, "")
    kept = Counter(r.doc_id for r in out.collect())
    assert out.columns == docs.columns and 12 in kept and 13 not in kept and kept[None] == 3 and 21 in kept
    assert near_dedup.stage(spark, clashing, "").columns == clashing.columns


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [tuple(map(int, r.integers(0, 400, 2))) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)]
    found = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_lists_that_stay_apart_make_bounded_groups(spark, monkeypatch):
    """A list of many members, all components of their own: groups stay at two tiles, and all pairs meet once."""
    monkeypatch.setattr(near_dedup, "TILE", 64)
    n = 1500
    rows = spark.range(n).selectExpr("7L AS key", f"{n}L AS count", "sha2(string(id), 256) AS set_hash", "id AS comp")
    apart = spark.range(near_dedup.SALTS).selectExpr("7L AS key", "int(id) AS salt", "3L AS largest", f"{n - 1}L AS asking")
    found = near_dedup.tiled(rows, apart).select("key", "comp", "asks", "turn").collect()
    groups = {}
    for r in found:
        groups.setdefault(r.key, []).append(r)
    assert max(map(len, groups.values())) <= 4 * 64
    met = {}
    for members in groups.values():
        held = [r for r in members if not r.asks]
        for a in (r for r in members if r.asks):
            for b in held:
                if b.comp != a.comp and (b.turn < 0 or b.turn >= a.turn):
                    pair = (min(a.comp, b.comp), max(a.comp, b.comp))
                    met[pair] = met.get(pair, 0) + 1
    assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}


def test_links_between_tiles(spark, monkeypatch):
    """Chains of near copies among texts that share half their words and stay apart, over many tiles."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "TILE", 8)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(k, f"{shared} " + " ".join(f"t{k}_{j}" for j in range(45))) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} tail{k}") for k in range(0, 60, 7)]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {d: d - 100 if d >= 100 else d for d in found}
