"""Exact repeated passages by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id, judged on the input.

The corpus is written once as shard files in the shared folder; a row group, of bounded size, is a shard. The tasks of each
pass read their shard from there; only small facts about it are shuffled, never texts:

1. Anchors: of the 35 16-byte strings inside a window of 50 bytes, the one with the least fingerprint. Equal windows have
   equal anchors, whatever surrounds them. Fingerprints that occur in two documents are found by (bucket, 32 bits).
2. Contexts: the stretch of text whose windows share a shared anchor, with the smallest and largest id that holds it in the
   shard. They are dealt by the anchor's fingerprint, so equal windows meet in one bucket. Contexts are counted first: those
   of an anchor with very many (a frequent short line whose surroundings differ) are taken apart into windows, which are
   dealt by their own fingerprints, so equal windows still meet and no bucket holds all of them.
3. Arrays: in a bucket, the contexts of a few shards at a time get a suffix array by Larsson-Sadakane refinement and common
   prefixes by Kasai's method; runs of common prefixes of 50 bytes are classes of equal windows. The sorted windows of the
   arrays are merged two and two by binary search. Each class keeps its smallest id. Nothing else decides which windows
   are equal: anchors only leave out windows that no other document has.
4. Each shard marks the windows whose class has a smaller id than their document.

A passage in a third of all documents is one context per shard in steps 2 and 3, however often the shard repeats it.

Defined results: a null text is the empty text; a null id comes after every other id (it removes nothing elsewhere, and
loses what others repeat); rows with equal ids remove nothing from one another; texts under 50 bytes stay whole; an empty
table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import filesystem, scratch, stored, table
from .files import listed

LENGTH = 50
GRAM = 16
#: Bytes hashed at a time (arrays that fit a cache), and after which a shard's contexts are sent off.
BLOCK, PART = 1 << 17, 32 << 20
#: Positions of a suffix array (three ranks must fit in 63 bits) and, about, of the arrays that a task merges.
POSITIONS, MERGED = 1 << 18, 1 << 22
#: Contexts of one anchor, about two million bytes, from which on they are dealt window by window.
CROWD = (1 << 21) // 85
#: Bytes of a row group, before compression; each is a shard.
GROUP = 64 << 20
LAST = np.iinfo(np.int64).max
_DRAW = np.random.default_rng(50).integers(1, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE, FACTOR = _DRAW[:256], _DRAW[256:264]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i]."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(x)] if len(x) else []
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def spread_out(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers: differences, byte by byte, so that the leading bytes are zeros in a row."""
    return squeezed(np.diff(x, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(spread_out(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


# -- suffix arrays -------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of all suffixes of pieces; ``ends`` gives the end of each position's piece.

    Larsson-Sadakane refinement: suffixes sorted by 4 bytes, then groups that are still tied are sorted by the rank of the
    suffix 4, 8, 16, ... bytes on. A suffix that ends comes before its extensions; equal suffixes keep their text order.
    """
    n = len(text)
    position = np.arange(n, dtype=np.int64)
    left = (ends - position).astype(np.int32)
    symbol = np.zeros(n + 4, np.int64)
    symbol[:n] = text
    symbol[:n] += 1
    key = symbol[:n] << 27
    for k in range(1, 4):
        key |= np.where(left > k, symbol[k : n + k], 0) << (9 * (3 - k))
    packed = (key << 21) | position
    packed.sort()
    order = (packed & 0x1FFFFF).astype(np.int32)
    packed >>= 21
    first = np.empty(n + 1, bool)
    first[0] = first[n] = True
    np.not_equal(packed[1:], packed[:-1], out=first[1:n])
    heads = np.flatnonzero(first[:n])
    start = np.repeat(heads, np.diff(np.append(heads, n)))
    rank = np.empty(n, np.int32)
    rank[order] = start
    slots = np.flatnonzero(~(first[:-1] & first[1:]))
    group = start[slots]
    longest, step = int(left.max()), 4
    while step < longest and len(slots):
        at = order[slots]
        inside = left[at] > step
        second = np.where(inside, rank[np.where(inside, at + step, 0)] + 1, 0)
        packed = (group << 42) | (second.astype(np.int64) << 21) | at
        packed.sort()
        at = (packed & 0x1FFFFF).astype(np.int32)
        order[slots] = at
        packed >>= 21
        new = np.empty(len(slots) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(packed[1:], packed[:-1], out=new[1:-1])
        heads = np.flatnonzero(new[:-1])
        group = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        rank[at] = group
        tied = ~(new[:-1] & new[1:])
        slots, group = slots[tied], group[tied]
        step *= 2
    rank[order] = position
    return order.astype(np.int64), rank.astype(np.int64)


def common_prefixes(text: np.ndarray, ends: np.ndarray, pieces: np.ndarray, order: np.ndarray, rank: np.ndarray, limit: int = LENGTH) -> np.ndarray:
    """Common prefix, up to ``limit``, of each suffix of at least that length with the one before it, in suffix order.

    Kasai's method, all pieces in step: in text order a common prefix is at most one shorter than the previous one. Shorter
    suffixes come last in a piece, so nothing after them depends on theirs; they keep 0.
    """
    common = np.zeros(len(text), np.int64)
    pieces = pieces[ends[pieces] - pieces >= limit]
    at, end, stop, held = pieces.copy(), ends[pieces], ends[pieces] - limit + 1, np.zeros(len(pieces), np.int64)
    while len(at):
        before = rank[at] - 1
        other = order[before]
        a, b = at + held, other + held
        more = (before >= 0) & (held < limit) & (a < end) & (b < ends[other])
        more[more] = text[a[more]] == text[b[more]]
        held[more] += 1
        done = ~more
        common[rank[at[done]]] = np.where(before[done] >= 0, held[done], 0)
        held[done] = np.maximum(held[done] - 1, 0)
        at[done] += 1
        alive = at < stop
        if not alive.all():
            at, end, stop, held = at[alive], end[alive], stop[alive], held[alive]
    return common


def window_classes(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal windows of pieces: (windows in sorted order, class of each, smallest id of each class)."""
    stops = np.cumsum(lengths)
    ends = np.repeat(stops, lengths)
    order, rank = suffix_array(text, ends)
    common = common_prefixes(text, ends, stops - lengths, order, rank, length)
    whole = order + length <= ends[order]
    windows = order[whole]
    fresh = common[whole] < length
    if len(fresh):
        fresh[0] = True
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(np.repeat(ids, lengths)[windows], heads) if len(heads) else np.zeros(0, np.int64)
    return windows, np.cumsum(fresh) - 1, least


def least_ids(text: np.ndarray, lengths: np.ndarray, ids: np.ndarray, length: int = LENGTH, positions: int = POSITIONS) -> np.ndarray:
    """Smallest id of the class of each window of pieces, windows in piece order; pieces may repeat.

    Pieces are cut into shards of bounded size with an array each. The sorted windows of the shards are merged by binary
    search, two and two; where each shard's windows come to stand is kept on the way.
    """
    stops = np.cumsum(lengths)
    cuts, at = [0], 0
    while at < len(lengths):
        at = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + positions, side="right")))
        cuts.append(at)
    shards = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        begin, end = stops[a] - lengths[a], stops[b - 1]
        windows, classes, least = window_classes(text[begin:end], lengths[a:b], ids[a:b], length)
        heads = windows[np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))] + begin if len(windows) else windows
        words = np.ndarray((len(text) - length + 1,), f"S{length}", text, strides=(1,))[heads] if len(heads) else np.zeros(0, f"S{length}")
        shards.append((windows + begin, classes, words, least))
    level = [(words, least, [(k, np.arange(len(words)))]) for k, (_, _, words, least) in enumerate(shards)]
    while len(level) > 1:
        level = [joined(*level[k : k + 2]) for k in range(0, len(level), 2)]
    out = np.full(len(text), LAST)
    for _, least, places in level:
        for k, place in places:
            windows, classes, _, _ = shards[k]
            out[windows] = least[place][classes]
    return out[ragged(stops - lengths, np.maximum(lengths - length + 1, 0))]


def joined(a: tuple, b: tuple | None = None) -> tuple:
    """Two sorted lists of distinct windows, their smallest ids and the places of the shards' windows in them, as one."""
    if b is None:
        return a
    if len(a[0]) < len(b[0]):
        a, b = b, a
    place = np.searchsorted(a[0], b[0])
    same = place < len(a[0])
    same[same] = a[0][place[same]] == b[0][same]
    least = a[1].copy()
    least[place[same]] = np.minimum(least[place[same]], b[1][same])
    new = place[~same]
    of_a = np.arange(len(a[0])) + np.cumsum(np.bincount(new, minlength=len(a[0]) + 1))[: len(a[0])]
    of_b = np.empty(len(place), np.int64)
    of_b[same], of_b[~same] = of_a[place[same]], new + np.arange(len(new))
    words, least = np.insert(a[0], new, b[0][~same]), np.insert(least, new, b[1][~same])
    return words, least, [*((k, of_a[x]) for k, x in a[2]), *((k, of_b[x]) for k, x in b[2])]


# -- anchors -------------------------------------------------------------------------------------------------------------


def anchored(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (first window, last window, anchor's fingerprint). Windows stay inside pieces."""
    firsts, lasts, prints = [], [], []
    width = LENGTH - GRAM + 1
    for at in range(0, len(text), BLOCK):
        part = text[at : at + BLOCK + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            break
        grams = BYTE[part]
        for k in range(4):
            step = 1 << k
            grams = grams[:-step] * FACTOR[k] + grams[step:]
        grams = mixed(grams)
        low = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if width > step:
            low = np.minimum(low[: step - width], low[width - step :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        inside = np.arange(at, at + n) + LENGTH <= ends[at : at + n]
        change = np.append(True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]))
        first = np.flatnonzero(change)
        last = np.append(first[1:], n) - 1
        first, last = first[inside[first]], last[inside[first]]
        firsts.append(first + at)
        lasts.append(last + at)
        prints.append(mixed(grams[anchor[first]] + FACTOR[7]))
    empty = np.zeros(0, np.int64)
    return np.concatenate(firsts or [empty]), np.concatenate(lasts or [empty]), np.concatenate(prints or [empty.view(np.uint64)])


def fingerprints(text: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints of strings of 8 bytes to twice ``LENGTH``."""
    out = lengths.astype(np.uint64)
    if len(firsts):
        eights = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
        for k in range(0, 2 * LENGTH, 8):
            out = mixed(out * FACTOR[5] + eights[firsts + np.minimum(k, lengths - 8)])
    return out


# -- passes over shards --------------------------------------------------------------------------------------------------


class Chunk:
    """Some documents of a shard: their rows, ids, and bytes one after another."""

    def __init__(self, rows: pa.RecordBatch | None, ids: list, texts: list[bytes]):
        self.rows, self.texts = rows, texts
        self.ids = np.array([LAST if x is None else x for x in ids], np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(lengths)
        self.starts = self.stops - lengths
        self.buffer = b"".join(texts)
        self.text = np.frombuffer(self.buffer, np.uint8)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, fingerprint and document of the runs of windows with one anchor."""
        first, last, print_ = anchored(self.text, np.repeat(self.stops, self.stops - self.starts))
        return first, last, print_, np.searchsorted(self.stops, first, side="right")


def chunks(path: str, group: int, whole_rows: bool = False) -> Iterator[Chunk]:
    import pyarrow.parquet as pq

    fs, inner = filesystem(path)
    with fs.open_input_file(inner) as file:
        reader = pq.ParquetFile(file)
        for batch in reader.iter_batches(batch_size=512, row_groups=[group], columns=None if whole_rows else ["doc_id", "text"]):
            names = batch.schema.names
            ids = batch.column(names.index("doc_id")).to_pylist()
            texts = [(x or "").encode("utf-8", "replace") for x in batch.column(names.index("text")).to_pylist()]
            yield Chunk(batch if whole_rows else None, ids, texts)


SIDE = "shard long, kind string, number long, part long, a binary, b binary, c binary, d binary"


def shared_prints(side: pd.DataFrame, buckets: int) -> np.ndarray:
    """Sorted (bucket, 32 bits) of a shard's anchors that other documents have too."""
    rows = side[side["kind"] == "shared"]
    found = [np.frombuffer(r.a, np.uint32).astype(np.uint64) | (np.uint64(r.number) << np.uint64(32)) for r in rows.itertuples()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def brief(prints: np.ndarray, buckets: int) -> np.ndarray:
    """(bucket, low 32 bits) in one number."""
    return (((prints >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (prints & np.uint64(0xFFFFFFFF))


def holds(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


class Part:
    """Distinct contexts of a stretch of a shard, in order of appearance."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bucket: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.bytes = 0

    def add(self, chunk: Chunk, shared: np.ndarray, buckets: int, dealt: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take a chunk's contexts in; returns first window, windows, document and context of each run.

        Runs of crowded anchors are taken apart: each window is a context, dealt by its own fingerprint.
        """
        first, last, prints, doc = chunk.runs()
        keep = holds(shared, brief(prints, buckets))
        first, last, prints, doc = first[keep], last[keep], prints[keep], doc[keep]
        if (apart := holds(crowded, prints)).any():
            count = np.where(apart, last - first + 1, 1)
            apart, last, prints, doc = (np.repeat(x, count) for x in (apart, last, prints, doc))
            first = ragged(first, count)
            last[apart] = first[apart]
            prints[apart] = fingerprints(chunk.text, first[apart], np.full(int(apart.sum()), LENGTH))
        where = ((prints >> np.uint64(7)) % np.uint64(dealt)).tolist()
        buffer, index, found = chunk.buffer, self.index, []
        for a, b, w, d in zip(first.tolist(), (last + LENGTH).tolist(), where, chunk.ids[doc].tolist(), strict=True):
            context = buffer[a:b]
            k = index.setdefault(context, len(index))
            if k == len(self.low):
                self.bucket.append(w)
                self.low.append(d)
                self.high.append(d)
            elif d < self.low[k]:
                self.low[k] = d
            elif d > self.high[k]:
                self.high[k] = d
            found.append(k)
        self.bytes += len(buffer)
        return first, last - first + 1, doc, np.array(found, np.int64)

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray]]:
        bucket = np.array(self.bucket, np.int64)
        order = np.argsort(bucket, kind="stable")
        for a, b in stretches(bucket[order]):
            yield int(bucket[order[a]]), order[a:b]


def _collect_anchors(buckets: int):
    def run(key, left):
        held, owners = [], []
        for row in left.itertuples():
            for chunk in chunks(row.path, row.group):
                _, _, prints, doc = chunk.runs()
                short = brief(prints, buckets)
                order = np.lexsort((doc, short))
                short, doc = short[order], doc[order]
                new = np.append(True, (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])) if len(short) else np.zeros(0, bool)
                short = short[new]
                head = np.append(True, short[1:] != short[:-1]) if len(short) else new
                at = np.flatnonzero(head)
                held.append(short[head])
                owners.append(np.diff(np.append(at, len(short))) > 1)
        if not held:
            return pd.DataFrame({"bucket": [], "shard": [], "once": [], "more": []})
        prints, many = np.concatenate(held), np.concatenate(owners)
        order = np.argsort(prints, kind="stable")
        prints, many = prints[order], many[order]
        head = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(prints)))
        several = (size > 1) | np.logical_or.reduceat(many, head) if len(head) else np.zeros(0, bool)
        prints = prints[head]
        bucket = (prints >> np.uint64(32)).astype(np.int64)
        rows = []
        for a, b in stretches(bucket):
            low = (prints[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows.append((int(bucket[a]), key[0], packed(low[~several[a:b]]), packed(low[several[a:b]])))
        return pd.DataFrame(rows, columns=["bucket", "shard", "once", "more"])

    return run


def _find_shared(key, rows):
    """Of one bucket: for each shard, its fingerprints that two documents have."""
    once, more = ([unpacked(x) for x in rows[c]] for c in ("once", "more"))
    every = np.sort(np.concatenate([*once, *more]))
    twice = every[1:][every[1:] == every[:-1]]
    shared = np.sort(np.concatenate([twice, *more]))
    out = [np.concatenate([m, o[holds(shared, o)]]).tobytes() for o, m in zip(once, more, strict=True)]
    found = pd.DataFrame({"shard": rows["shard"], "kind": "shared", "number": key[0], "part": 0, "a": out, "b": None, "c": None, "d": None})
    return found[found["a"].str.len() > 0]


def _count_contexts(buckets: int, least: int):
    """Of each shard: bytes of its contexts, and its anchors with at least so many contexts, with their contexts and windows."""

    def run(key, left, side):
        shared = shared_prints(side, buckets)
        held, sizes, size, done = [], [], 0, 0
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            nonlocal done
            prints, marks, lengths = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.lexsort((marks, prints))
            prints, marks, lengths = prints[order], marks[order], lengths[order]
            new = np.append(True, (prints[1:] != prints[:-1]) | (marks[1:] != marks[:-1])) if len(prints) else np.zeros(0, bool)
            prints, lengths = prints[new], lengths[new]
            done += int(lengths.sum())
            found, at, counts = np.unique(prints, return_index=True, return_counts=True)
            held.append(found)
            sizes.append(np.stack([counts, np.add.reduceat(lengths - LENGTH + 1, at) if len(at) else counts]))
            waiting.clear()

        for row in left.itertuples():
            for chunk in chunks(row.path, row.group):
                first, last, prints, _ = chunk.runs()
                keep = holds(shared, brief(prints, buckets))
                first, lengths, prints = first[keep], last[keep] - first[keep] + LENGTH, prints[keep]
                waiting.append((prints, fingerprints(chunk.text, first, lengths), lengths))
                size += len(chunk.buffer)
                if size > PART:
                    close()
                    size = 0
        if waiting:
            close()
        if not held:
            return pd.DataFrame({"bytes": [], "anchors": [], "contexts": [], "windows": []}, dtype=object)
        found, at = np.unique(np.concatenate(held), return_inverse=True)
        contexts, windows = (np.bincount(at, x, len(found)).astype(np.int64) for x in np.concatenate(sizes, axis=1))
        many = contexts >= least
        return pd.DataFrame({"bytes": [done], "anchors": [found[many].view(np.int64).tolist()], "contexts": [contexts[many].tolist()], "windows": [windows[many].tolist()]})

    return run


def _collect_contexts(buckets: int, dealt: int, crowded: np.ndarray):
    def run(key, left, side):
        shared = shared_prints(side, buckets)
        rows, number, part = [], 0, Part()

        def send() -> None:
            texts, low, high = list(part.index), np.array(part.low, np.int64), np.array(part.high, np.int64)
            for bucket, at in part.by_bucket():
                some = [texts[k] for k in at.tolist()]
                lengths = np.fromiter(map(len, some), np.uint8, len(some))
                rows.append((bucket, key[0], number, squeezed(b"".join(some)), lengths.tobytes(), squeezed(low[at].tobytes()), squeezed(high[at].tobytes())))

        for row in left.itertuples():
            for chunk in chunks(row.path, row.group):
                part.add(chunk, shared, buckets, dealt, crowded)
                if part.bytes > PART:
                    send()
                    number, part = number + 1, Part()
        send()
        return pd.DataFrame(rows, columns=["bucket", "shard", "part", "texts", "lengths", "low", "high"])

    return run


def _settle(positions: int):
    """Of one bucket of contexts: for each part of a shard, the smallest ids of the windows that some document loses.

    A context is a piece for each part that holds it, so that equal contexts meet in the arrays like all other windows.
    """

    def run(key, rows):
        lengths = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["lengths"]]).astype(np.int64)
        text = np.frombuffer(b"".join([spread_out(x) for x in rows["texts"]]), np.uint8)
        ids = np.concatenate([np.frombuffer(spread_out(x), np.int64) for x in rows["low"]])
        stops = np.cumsum([len(x) for x in rows["lengths"]])
        members = [np.arange(b - len(x), b) for b, x in zip(stops.tolist(), rows["lengths"], strict=True)]
        counts = lengths - LENGTH + 1
        each = least_ids(text, lengths, ids, positions=positions)
        starts = np.cumsum(counts) - counts
        lowest = np.minimum.reduceat(each, starts)
        owner = np.repeat(np.arange(len(counts)), counts)
        change = np.append(True, (each[1:] != each[:-1]) | (owner[1:] != owner[:-1]))
        heads = np.flatnonzero(change)
        run_length, run_id = np.diff(np.append(heads, len(each))), each[heads]
        runs = np.bincount(owner[heads], minlength=len(counts))
        run_start = np.cumsum(runs) - runs
        out = []
        for row, mine in zip(rows.itertuples(), members, strict=True):
            lost = np.flatnonzero(lowest[mine] < np.frombuffer(spread_out(row.high), np.int64))
            if len(lost):
                some = mine[lost]
                at = ragged(run_start[some], runs[some])
                out.append((row.shard, "lost", key[0], row.part, lost.astype(np.uint32).tobytes(), runs[some].astype(np.uint8).tobytes(), run_length[at].astype(np.uint8).tobytes(), run_id[at].tobytes()))
        return pd.DataFrame(out, columns=["shard", "kind", "number", "part", "a", "b", "c", "d"])

    return run


def _apply(buckets: int, dealt: int, crowded: np.ndarray, make, schema: pa.Schema):
    """Recompute each shard's contexts, mark what the settled windows take, and give ``make`` each chunk and its mask."""

    def run(left: pa.Table, side: pa.Table) -> pa.Table:
        left, side = left.to_pandas(), side.to_pandas()
        shared, lost = shared_prints(side, buckets), {}
        for row in side[side["kind"] == "lost"].itertuples():
            lost.setdefault(int(row.part), {})[int(row.number)] = row
        out, waiting, number, part = [], [], 0, Part()

        def close() -> None:
            size = len(part.index)
            counts, starts, lengths, ids, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [], [], 0
            for bucket, members in part.by_bucket():
                if (row := lost.get(number, {}).get(bucket)) is None:
                    continue
                some, runs = members[np.frombuffer(row.a, np.uint32)], np.frombuffer(row.b, np.uint8).astype(np.int64)
                counts[some], starts[some] = runs, at + np.cumsum(runs) - runs
                lengths.append(np.frombuffer(row.c, np.uint8).astype(np.int64))
                ids.append(np.frombuffer(row.d, np.int64))
                at += len(ids[-1])
            lengths, ids = np.concatenate([np.zeros(0, np.int64), *lengths]), np.concatenate([np.zeros(0, np.int64), *ids])
            for chunk, (first, _, doc, context) in waiting:
                edge = np.zeros(len(chunk.text) + 1, np.int32)
                hit = counts[context] > 0 if size else np.zeros(0, bool)
                first, doc, context = first[hit], doc[hit], context[hit]
                each = ragged(starts[context], counts[context])
                span, origin = lengths[each], np.repeat(first, counts[context])
                total = np.cumsum(span) - span
                per = np.cumsum(counts[context]) - counts[context]
                begin = origin + total - np.repeat(total[per] if len(per) else per, counts[context])
                gone = (ids[each] < np.repeat(chunk.ids[doc], counts[context])) & (span > 0)
                np.add.at(edge, begin[gone], 1)
                np.add.at(edge, begin[gone] + span[gone] + LENGTH - 1, -1)
                out.append(make(chunk, np.cumsum(edge[:-1]) > 0, schema))
            waiting.clear()

        for row in left.itertuples():
            for chunk in chunks(row.path, row.group, whole_rows=True):
                waiting.append((chunk, part.add(chunk, shared, buckets, dealt, crowded)))
                if part.bytes > PART:
                    close()
                    number, part = number + 1, Part()
        close()
        return pa.Table.from_batches(out, schema)

    return run


def _digests(chunk: Chunk, gone: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    rows = []
    for k, text in enumerate(chunk.texts):
        mask = gone[chunk.starts[k] : chunk.stops[k]]
        n = int(mask.sum())
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text
        rows.append((None if chunk.ids[k] == LAST else int(chunk.ids[k]), len(text), n, spans, hashlib.sha256(kept).hexdigest()))
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _texts(chunk: Chunk, gone: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """The chunk's rows with what is left of their texts; all other columns are the input's own arrays."""
    columns = dict(zip(chunk.rows.schema.names, chunk.rows.columns, strict=True))
    texts = columns["text"].to_pylist()
    for k, text in enumerate(chunk.texts):
        mask = gone[chunk.starts[k] : chunk.stops[k]]
        if mask.any():  # a cut inside a character takes the rest of it along
            texts[k] = np.frombuffer(text, np.uint8)[~mask].tobytes().decode("utf-8", "ignore")
    columns["text"] = pa.array(texts, pa.string())
    if "n_chars" in columns:
        columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64())
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


DIGESTS = StructType([StructField(n, LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())])


def repeated_passages(docs: DataFrame, make=_digests, schema: StructType = DIGESTS, crowd: int = CROWD, positions: int = POSITIONS) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "suffix-shards")
    rows = docs.withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows.write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(folder)
    files = spark.createDataFrame([(path,) for path, _ in listed(folder, ".parquet")] or [("",)], "path string").where("path <> ''")
    found = stored(files.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_row_groups, "path string, group int, bytes long"), "suffix-groups")
    n_shards, total = found.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    tasks = max(1, n_shards)
    shards = stored(numbered(found.select("path", "group"), tasks), "suffix-numbers")
    left = shards.repartition(tasks, "shard").groupBy("shard")
    over = lambda side, run, out: left.cogroup(side.repartition(tasks, "shard").groupBy("shard")).applyInPandas(run, out)

    # About a million anchors in a bucket; one in 18 positions is an anchor.
    buckets = max(64, -(-total // (18 << 20)))
    anchors = left.applyInPandas(_collect_anchors(buckets), "bucket long, shard long, once binary, more binary")
    shared = stored(anchors.groupBy("bucket").applyInPandas(_find_shared, SIDE), "suffix-shared")

    # A shard reports anchors with at least its part of a crowd, so none with twice a crowd is missed.
    counted = stored(over(shared, _count_contexts(buckets, max(1, crowd // tasks)), "bytes long, anchors array<long>, contexts array<long>, windows array<long>"), "suffix-counts")
    by_anchor = counted.select(F.explode(F.arrays_zip("anchors", "contexts", "windows")).alias("x")).groupBy("x.anchors").agg(F.sum("x.contexts").alias("contexts"), F.sum("x.windows").alias("windows"))
    crowds = by_anchor.where(F.col("contexts") >= crowd).toPandas()  # few: all contexts over CROWD
    crowded = np.sort(crowds["anchors"].to_numpy(np.int64).view(np.uint64))
    size = counted.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] + LENGTH * int(crowds["windows"].sum())

    dealt = max(64, -(-size // MERGED))
    contexts = over(shared, _collect_contexts(buckets, dealt, crowded), "bucket long, shard long, part long, texts binary, lengths binary, low binary, high binary")
    lost = stored(contexts.groupBy("bucket").applyInPandas(_settle(positions), SIDE), "suffix-lost")
    whole = left.cogroup(shared.unionByName(lost).repartition(tasks, "shard").groupBy("shard"))
    return whole.applyInArrow(_apply(buckets, dealt, crowded, make, to_arrow_schema(schema)), schema)


def _row_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Row groups of the shard files with documents, and their bytes."""
    import pyarrow.parquet as pq

    for frame in frames:
        for path in frame["path"]:
            fs, inner = filesystem(path)
            with fs.open_input_file(inner) as file:
                footer = pq.ParquetFile(file).metadata
            sizes = [footer.row_group(k) for k in range(footer.num_row_groups)]
            yield pd.DataFrame([(path, k, x.total_byte_size) for k, x in enumerate(sizes) if x.num_rows], columns=["path", "group", "bytes"])


def numbered(shards: DataFrame, tasks: int) -> DataFrame:
    """Shards with numbers that a hash partitioning deals to different tasks."""
    spark = shards.sparkSession
    free = spark.range(0, 20 * tasks + 1000).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).agg(F.min("id").alias("shard"))
    in_order = shards.select("path", "group", (F.row_number().over(Window.orderBy("path", "group")) - 1).alias("task"))  # a row per shard
    return in_order.join(free, "task", "left").select("path", "group", F.coalesce("shard", F.col("task") + (20 * tasks + 1000)).cast("long").alias("shard"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated passages; every row stays, its text may become empty."""
    return repeated_passages(docs, _texts, docs.schema)


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
b AS MATERIALIZED (SELECT r, doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 100 <= len(x) THEN md5(substr(x, 2 * i + 1, 100)) END AS w FROM (SELECT r, doc_id, x, unnest(range(0, len(x) // 2)) AS i FROM d)),
f AS (SELECT w, min(doc_id) AS first FROM b WHERE w IS NOT NULL GROUP BY 1),
g AS (SELECT r, i, byte, CASE WHEN coalesce(first < doc_id, FALSE) THEN 1 ELSE 0 END AS hit FROM b LEFT JOIN f USING (w)),
m AS (SELECT r, i, byte, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
k AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS head FROM m),
a AS (SELECT r, sum(gone)::BIGINT AS n_removed, sum(head)::BIGINT AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY 1)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (r)
"""
