import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from rows import as_rows

from lodestead.llm import mixing, registry, sharding
from lodestead.llm.common import spread


def naive_best_fit(sizes, capacity):
    free, out = [], []
    for size in sizes:
        fits = [(f, k) for k, f in enumerate(free) if f >= size]
        if fits:
            k = min(fits)[1]
        else:
            free.append(max(capacity, size))
            k = len(free) - 1
        free[k] -= size
        out.append(k)
    return out


def test_pack_is_best_fit():
    r = np.random.default_rng(0)
    for _ in range(200):
        sizes = np.sort(r.integers(1, 80, r.integers(0, 60)))[::-1]
        assert sharding.pack(sizes, 64).tolist() == naive_best_fit(sizes.tolist(), 64)


def test_pack_into_never_overfills_when_all_fits():
    out = sharding.pack_into(np.array([6, 5, 5, 4]), np.array([10, 10]))
    assert np.bincount(out, [6, 5, 5, 4]).tolist() == [10, 10]
    assert sharding.pack_into(np.array([9, 9, 9]), np.array([10, 10])).tolist() == [0, 1, 1]


def check_shards(rows, texts, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        of_text[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_shards(docs, clashing, empty, labelled):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_shards(sharding.assign(docs).collect(), texts)
    assert as_rows(sharding.assign(clashing)) == as_rows(sharding.assign(docs))
    assert sharding.assign(empty).collect() == []
    rows = sharding.assign(labelled).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in labelled.collect()])
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * sum(load.values()) / 16


def test_sharding_query(spark, sf):
    rows = registry.queries()["op2_sharding"](spark, sf).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert {r.law for r in rows} == {"bytes"}


def naive_into(sizes, capacities):
    free, out = list(capacities), []
    for size in sizes:
        fits = [(f, k) for k, f in enumerate(free) if f >= size]
        _, k = min(fits) if fits else max((f, k) for k, f in enumerate(free))
        free[k] -= size
        out.append(k)
    return out, free


def hashed(*values):
    """The engine's 64-bit hash of integers or one text, as a number below 2 ** 64."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def naive_assign(rows, shards=16):
    """{(doc_id, size, crc, shard, slot)} by plain lists: large groups first, then the cells one by one, then rows in order."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    known = [(len(ids) * (len(t.encode()) + 1), hashlib.md5(t.encode()).hexdigest(), t, len(ids)) for t, ids in groups.items()]
    total, n_rows = sum(b for b, *_ in known), len(rows)
    known.sort(key=lambda g: (-g[0], g[1]))
    large = [g for g in known if g[0] * sharding.LARGE > total or g[3] * sharding.LARGE > n_rows]
    bins, free = naive_into([g[0] for g in large], [-(-total // shards)] * shards)
    of_text = {g[2]: k for g, k in zip(large, bins, strict=True)}
    rest, cells = max(1, sum(max(f, 0) for f in free)), defaultdict(list)
    for g in known:
        if g[2] not in of_text:
            cells[hashed(g[1]) % max(64, -(-len(known) // sharding.CELL))].append(g)
    for cell in cells.values():
        size = sum(g[0] for g in cell)
        bins, _ = naive_into([g[0] for g in cell], [math.ceil(max(f, 0) / rest * size) for f in free])
        of_text |= {g[2]: k for g, k in zip(cell, bins, strict=True)}
    placed = defaultdict(list)
    for doc_id, text in rows:
        data = (text or "").encode()
        row = (doc_id, zlib.crc32(data), len(data) + 1)
        placed[of_text[text or ""]].append((hashed(*row) % spread(n_rows), *row))
    return {(doc_id, size, crc, shard, slot) for shard, of_shard in placed.items() for slot, (_, doc_id, crc, size) in enumerate(sorted(of_shard))}, len(cells)


def test_shards_equal_plain_packing(spark, sf, labelled, monkeypatch):
    """The registered query, and the operator with parameters that put most groups into cells, row by row."""
    shown = lambda rows: {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows}
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert shown(registry.queries()["op2_sharding"](spark, sf).collect()) == naive_assign(documents)[0]
    for large, cell in ((8, 100_000), (1, 3), (40, 2)):
        monkeypatch.setattr(sharding, "LARGE", large)
        monkeypatch.setattr(sharding, "CELL", cell)
        expected, n_cells = naive_assign([(r.doc_id, r.text) for r in labelled.collect()])
        assert n_cells > 10 and shown(sharding.assign(labelled).collect()) == expected


def test_permutation():
    for n in (1, 2, 3, 5, 100, 1025):
        p = mixing.Permutation(n, 7)
        y = p(np.arange(n))
        assert sorted(y.tolist()) == list(range(n)) and (p(y, inverse=True) == np.arange(n)).all()


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        rest = total - sum(2 * sizes[s] for s in capped)
        over = {s for s in order if s not in capped and free and rest * weight[s] / free > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else rest * weight[s] / free if free else 0.0 for s in order}
        capped |= over


def check_mix(df, docs):
    rows = df.collect()
    plain = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, n) for d, _, n in plain)
    sizes = Counter()
    for _, s, n in plain:
        sizes[s] += n
    goal = expected_targets(dict(sizes))
    by_target, seen = defaultdict(list), {(sizes[s], round(goal[s], 6)) for s in sizes}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (r.source_size, round(r.target, 6)) in seen
        by_target[r.source_size, r.target].append(r.taken)
    for (size, target), taken in by_target.items():
        same = sum(1 for s in sizes if sizes[s] == size and abs(goal[s] - target) < 1e-6)
        assert abs(sum(taken) - same * target) <= same


def naive_mix(rows, slots, pools):
    """Counter of (doc_id, size, taken, n_slots, place) and {(shard, slot): (rank, block, words)}, one word at a time.

    ``rows``: (doc_id, source, size, located first word); only the draws and permutations are the operator's own.
    """
    order = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s))
    sizes = Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    goal = expected_targets(dict(sizes))
    drawn = {}
    for rank, s in enumerate(order):
        blocks, left, draws = -(-sizes[s] // mixing.BLOCK), int(goal[s] + 0.5), []
        turn = mixing.Permutation(blocks, rank)(np.arange(blocks)).tolist() if blocks else []
        for block in turn * 2:
            if left > 0:
                draws.append((rank, block, mixing.BLOCK))
                left -= min(mixing.BLOCK, sizes[s] - block * mixing.BLOCK, left)
        if draws:  # the last one is cut to what was left before it
            spent = sum(min(mixing.BLOCK, sizes[s] - b * mixing.BLOCK) for _, b, _ in draws[:-1])
            rest = int(goal[s] + 0.5) - spent
            if rest < min(mixing.BLOCK, sizes[s] - draws[-1][1] * mixing.BLOCK):
                draws[-1] = (rank, draws[-1][1], rest)
        drawn[rank] = draws
    total = sum(map(len, drawn.values()))
    large = [r for r in sorted(drawn) if drawn[r] and len(drawn[r]) * pools >= total]
    lists = [drawn[r] for r in large]
    tail = [d for r in sorted(drawn) if r not in large for d in drawn[r]]
    if tail:
        lists.append([tail[k] for k in mixing.Permutation(len(tail), -1)(np.arange(len(tail)))])
    shares = np.array(list(map(len, lists))) / total if total else None
    waiting, places, out = [iter(x) for x in lists], [], {}
    for shard in range(-(-total // slots)):
        size = min(slots, total - shard * slots)
        counts = mixing.drawn_counts(shard, size, shares)
        positions = mixing.Permutation(size, shard)(np.arange(size)).tolist()
        for k, pool in enumerate(np.repeat(np.arange(len(lists)), counts).tolist()):
            places.append((pool, (shard, positions[k])))
    surplus = [[] for _ in lists]
    for pool, place in places:
        if (draw := next(waiting[pool], None)) is None:
            surplus[pool].append(place)
        else:
            out[place] = draw
    for place, draw in zip([p for x in surplus for p in x], [d for x in waiting for d in x], strict=True):
        out[place] = draw
    streams = {rank: {} for rank in range(len(order))}
    for k, (_, s, n, first) in enumerate(rows):
        for w in range(n):
            streams[order.index(s)][first + w] = k
    got, at = Counter(), defaultdict(set)
    for place, (rank, block, words) in out.items():
        for w in range(block * mixing.BLOCK, block * mixing.BLOCK + words):
            if w in streams[rank]:
                got[streams[rank][w]] += 1
                at[streams[rank][w]].add(place)
    found = Counter((d, n, got[k], len(at[k]), min(at[k], default=(None, None))) for k, (d, _, n, _) in enumerate(rows))
    return found, out


def test_mix_equals_naive_draws(docs, labelled, monkeypatch):
    for slots, run, pools in ((mixing.SLOTS, mixing.RUN, mixing.POOLS), (50, 2, mixing.POOLS), (50, 2, 6), (33, 1, 1)):
        monkeypatch.setattr(mixing, "SLOTS", slots)
        monkeypatch.setattr(mixing, "RUN", run)
        monkeypatch.setattr(mixing, "POOLS", pools)
        for table in (docs, labelled):
            located, sources = mixing.mixed(table)
            rows = [(r.doc_id, r.source, r.size, r.offset) for r in located.select("doc_id", "source", "size", "offset").collect()]
            found, placed = naive_mix(rows, slots, pools)
            assert {(r.shard, r.slot): (r.rank, r.block, r.words) for r in mixing.draws(sources).collect()} == placed
            assert Counter((r.doc_id, r.size, r.taken, r.n_slots, (r.first_shard, r.first_slot)) for r in mixing.taken(table).collect()) == found


def test_mix_query(spark, sf):
    check_mix(registry.queries()["op7_mixing"](spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))
    placed = mixing.shards(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted((r.shard, r.slot) for r in placed) == [(k // mixing.SLOTS, k % mixing.SLOTS) for k in range(len(placed))]


def test_mix_plan(docs):
    _, sources = mixing.mixed(docs)
    plan = mixing.draws(sources)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_mix(docs, clashing, empty, labelled):
    check_mix(mixing.taken(docs), docs)
    check_mix(mixing.taken(labelled), labelled)
    assert as_rows(mixing.taken(docs)) == as_rows(mixing.taken(clashing.repartition(5)))
    assert mixing.taken(empty).collect() == []


def test_mix_stage(docs, clashing, empty, spark):
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns
    taken = Counter()
    for r in mixing.taken(docs).collect():
        taken[r.doc_id] += r.taken
    given = Counter()
    for r in out.collect():
        given[r.doc_id] += len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert given == Counter({d: n for d, n in taken.items() if n})
    assert mixing.stage(spark, empty, "").collect() == []
    assert mixing.stage(spark, clashing, "").columns == clashing.columns


def test_cut_text():
    assert mixing.cut_text(" a b\tc d ", [(0, 2), (2, 4)]) == " a b\tc d "
    assert mixing.cut_text(" a b\tc d ", [(3, 4), (0, 2)]) == "a b\nd"
