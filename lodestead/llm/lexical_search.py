"""Ranked lexical search over impact-ordered postings, score at a time.

Index: documents are dealt to blocks as they are read; within a block, each term of the queries has its postings (document
in the block, occurrences). Corpus counts (documents, terms, documents of a term) are sums over the blocks' rows. With them a
posting's impact is fixed: weight of the term times its quotient, in integers.

Search, per block and item: the postings of the item's terms are grouped by exact impact, a segment each, and segments are
processed in descending order of impact, each adding its impact to its documents' accumulators. What a term can still add
to a document is the impact of its next segment. As soon as these bounds prove that no document outside the candidates can reach the
block's k-th best (documents not met yet, and those met whose score plus what their missing terms can add stays below
it), processing stops and the candidates' scores are completed from the postings by document. Segments are taken in levels, so that the
proof is tried after each level and not after each segment; where it never holds, all segments are processed and the
scores are complete as they are. The best of all blocks are merged by rank; each block gives at most k rows an item.

Queries come in chunks of a bounded number of terms, each a pass over the postings of its terms; a chunk's terms and
weights are what tasks get beside their block. Which terms are indexed is decided by a bitmap of fixed size of hashed terms, which may let
others pass (they are then ignored) but loses none, whatever the number of queries.

Defined results: a null or empty text has no terms, is in no count and in no result; an item without terms has no results; repeated rows
are documents (items) each, of equal score and rank by doc_id, null first; scores of 0 are left out; other columns are
ignored, whatever their names; texts of any length are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

TOP = 50
#: Slots of the bitmap of query terms (4 MB as bytes).
SLOTS = 1 << 22
#: Postings after which a block of documents is closed, and (item, term) rows of a chunk of queries.
BLOCK, CHUNK = 1 << 20, 200_000
#: Rows of a batch of postings.
BATCH = 4096
#: Levels of impact at which the proof is tried: the share of an item's segments' postings processed by then.
LEVELS = (0.05, 0.15, 0.3, 0.5, 0.75)

#: Fixed value: the bytes of terms, upper-case letters as lower-case ones; all others separate.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLDED).split()


def _slot(term: bytes) -> int:
    return zlib.crc32(term) % SLOTS


def query_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term): the distinct terms of each row; ``item`` tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, n = sorted(set(terms(text))), n + 1
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([n] * len(found), pa.int64()), pa.array([item_id] * len(found), pa.int64()), pa.array(found, pa.binary()), pa.array([_slot(t) for t in found], pa.int64())], names=["item", "item_id", "term", "slot"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "item long, item_id long, term binary, slot long"), "query-terms")


INDEX = "block long, term binary, places binary, tf binary, df long, doc_ids binary, known binary, lengths binary, n_docs long, n_terms long"


def index(docs: DataFrame, slots: list[int], block: int = BLOCK) -> DataFrame:
    """Postings of the terms that the bitmap lets pass, by block: rows of a block and term, and one row a block (``term`` null).

    ``places`` and ``tf`` are 32-bit integers: the document in its block, in ascending order, and how often it holds the
    term. A block's own row has its documents' ids, whether they have one, their numbers of terms, and the sums of these.
    """
    bitmap = bytearray(SLOTS)
    for s in slots:
        bitmap[s] = 1
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))
    types = [pa.int64(), *[pa.binary()] * 3, pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def closed(name: int, doc_ids: list, lengths: list[int], postings: dict[bytes, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        pack = lambda x, t: np.array(x, t).tobytes()
        sums = [len(lengths) - lengths.count(0), sum(lengths)]
        own = [name, None, None, None, None, pack([d or 0 for d in doc_ids], "<i8"), pack([d is not None for d in doc_ids], "?"), pack(lengths, "<i8"), *sums]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(own, types, strict=True)], names=names)
        found = sorted(postings)
        for k in range(0, len(found), BATCH):
            some = found[k : k + BATCH]
            columns = [[name] * len(some), some, [pack(postings[t][0], "<i4") for t in some], [pack(postings[t][1], "<i4") for t in some], [len(postings[t][0]) for t in some]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, types, strict=False)], *[pa.nulls(len(some), t) for t in types[5:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, crc, name = shared.value, zlib.crc32, TaskContext.get().partitionId() << 32
        doc_ids, lengths, postings, size = [], [], {}, 0
        #: Whether a term passes, by term; starts afresh beyond a bound.
        passes: dict[bytes, bool] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                words = data.translate(_FOLDED).split()
                place = len(doc_ids)
                doc_ids.append(doc_id)
                lengths.append(len(words))
                for term, n in Counter(words).items():
                    known = passes.get(term)
                    if known is None:
                        if len(passes) >= 1 << 20:
                            passes.clear()
                        known = passes[term] = bool(wanted[crc(term) % SLOTS])
                    if known:
                        at = postings.get(term)
                        if at is None:
                            at = postings[term] = ([], [])
                        at[0].append(place)
                        at[1].append(n)
                        size += 1
                if size >= block or len(doc_ids) >= block:
                    yield from closed(name, doc_ids, lengths, postings)
                    doc_ids, lengths, postings, size, name = [], [], {}, 0, name + 1
        if doc_ids:
            yield from closed(name, doc_ids, lengths, postings)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, INDEX), "postings")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Block:
    """The postings of one block with their impacts, by impact and by document."""

    def __init__(self, n: int, total: int, lengths: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]], weights: dict[int, int]):
        self.size = len(lengths)
        m = 100 - 50 + (50 * lengths * n) // max(total, 1)
        self.by_doc, self.segments = {}, {}
        for term, (places, tf) in postings.items():
            impact = weights[term] * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m[places]))
            self.by_doc[term] = (places, impact)
            order = np.argsort(-impact, kind="stable")
            high = impact[order]
            begins = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(high) else np.empty(0, np.int64)
            #: Segments of equal impact, descending: the impacts, where each begins, the documents.
            self.segments[term] = (high[begins], np.append(begins, len(high)), places[order])

    def search(self, wanted: list[int], k: int, processed: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that hold all of the block's k best (and ties) for the terms ``wanted``, scores complete."""
        found = [t for t in wanted if t in self.segments and len(self.segments[t][0]) and self.segments[t][0][0] > 0]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        heads = [self.segments[t] for t in found]
        levels = self._levels(heads)
        scores, met = np.zeros(self.size, np.int64), np.zeros((len(found), self.size), bool)
        at = [0] * len(found)
        done = 0
        for level in levels:
            for i, (impacts, begins, places) in enumerate(heads):
                upto = int(np.searchsorted(-impacts, -level, side="right"))  # all segments of at least this impact
                if upto > at[i]:
                    some = places[begins[at[i]] : begins[upto]]
                    scores[some] += np.repeat(impacts[at[i] : upto], np.diff(begins[at[i] : upto + 1]))
                    met[i, some] = True
                    at[i], done = upto, done + len(some)
            rest = np.array([h[0][a] if a < len(h[0]) else 0 for h, a in zip(heads, at, strict=True)], np.int64)
            if not rest.any():
                break
            if np.count_nonzero(scores) < k:
                continue
            bar = np.partition(scores, -k)[-k]
            if rest.sum() >= bar:
                continue  # a document not met yet could still come in
            candidates = np.flatnonzero(scores + rest.sum() >= bar)
            candidates = candidates[scores[candidates] + rest @ ~met[:, candidates] >= bar]
            if len(candidates) <= max(4 * k, self.size // 64):
                if processed is not None:
                    processed.append(done)
                return candidates, self.complete(found, candidates)
        if processed is not None:
            processed.append(done)
        places = np.flatnonzero(scores)
        return places, scores[places]

    def _levels(self, heads: list) -> list[int]:
        """Impacts at which a share of the postings lies above, and the least of all."""
        impacts = np.concatenate([h[0] for h in heads])
        sizes = np.concatenate([np.diff(h[1]) for h in heads])
        order = np.argsort(-impacts, kind="stable")
        reached = np.cumsum(sizes[order])
        cut = [impacts[order][np.searchsorted(reached, share * reached[-1])] for share in LEVELS]
        return sorted({int(x) for x in [*cut, impacts.min()]}, reverse=True)

    def complete(self, found: list[int], candidates: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the postings by document."""
        scores = np.zeros(len(candidates), np.int64)
        for term in found:
            places, impact = self.by_doc[term]
            at = np.minimum(np.searchsorted(places, candidates), len(places) - 1)
            scores += np.where(places[at] == candidates, impact[at], 0)
        return scores


def _best(places: np.ndarray, scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, ties by ``order`` of the documents."""
    some = scores > 0
    places, scores = places[some], scores[some]
    if len(scores) > k:
        keep = scores >= np.partition(scores, -k)[-k]
        places, scores = places[keep], scores[keep]
    first = np.lexsort((order[places], -scores))[:k]
    return places[first], scores[first]


def _chunks(wanted: DataFrame) -> list[DataFrame]:
    """The (item, term) rows in parts of about CHUNK rows, whole items each."""
    n = max(1, -(-wanted.count() // CHUNK))
    return [wanted.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents."""
    spark = docs.sparkSession
    wanted = query_terms(items)
    slots = [r.slot for r in wanted.select("slot").distinct().collect()]  # at most SLOTS
    postings = index(docs, slots, block)
    own = postings.where("term IS NULL").select("block", "doc_ids", "known", "lengths")
    n, total = postings.where("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    listed = postings.where("term IS NOT NULL").select("block", "term", "places", "tf", "df")
    counts = stored(listed.groupBy("term").agg(F.sum("df").alias("df")).join(wanted.select("term").distinct(), "term"), "document-counts")
    found = [_pass(spark, own, listed, chunk.join(counts, "term"), int(n), int(total), k) for chunk in _chunks(wanted)]
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "block", "place")
    return merged.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _pass(spark: SparkSession, own: DataFrame, listed: DataFrame, chunk: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """The best of every block for one chunk of queries."""
    rows = chunk.select("item", "item_id", "term", "df").toPandas()  # about CHUNK rows
    names = sorted({bytes(t) for t in rows["term"]})
    number = {t: i for i, t in enumerate(names)}
    weights = {number[bytes(t)]: weight(n, int(df)) for t, df in zip(rows["term"], rows["df"], strict=True)}
    items: dict[int, list[int]] = {}
    ids: dict[int, int | None] = {}
    for r in rows.itertuples():
        items.setdefault(r.item, []).append(number[bytes(r.term)])
        ids[r.item] = None if pd.isna(r.item_id) else int(r.item_id)
    shared = spark.sparkContext.broadcast((number, weights, items, ids))

    def best(blocks: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        number, weights, items, ids = shared.value
        if not len(blocks):
            return pd.DataFrame(columns=columns)
        row = blocks.iloc[0]
        doc_ids, known, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], "?"), np.frombuffer(row["lengths"], "<i8")
        mine = {number[bytes(t)]: (np.frombuffer(p, "<i4"), np.frombuffer(f, "<i4")) for t, p, f in zip(postings["term"], postings["places"], postings["tf"], strict=True) if bytes(t) in number}
        searched = Block(n, total, lengths, mine, weights)
        order = np.empty(len(doc_ids), np.int64)
        order[np.lexsort((doc_ids, known))] = np.arange(len(doc_ids))
        out = []
        for item, wanted in items.items():
            places, scores = _best(*searched.search(wanted, k), order, k)
            out += [(item, ids[item], int(row["block"]), int(p), int(doc_ids[p]) if known[p] else None, int(s)) for p, s in zip(places, scores, strict=True)]
        return pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64", "item_id": "Int64"})

    columns = ["item", "item_id", "block", "place", "doc_id", "score"]
    chosen = listed.select(F.col("block").alias("of"), "term", "places", "tf")
    return own.groupBy("block").cogroup(chosen.groupBy("of")).applyInPandas(best, "item long, item_id long, block long, place long, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ranked for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all({_FOLD.format("text")}, '{_TERM}') AS words FROM documents),
 s AS (SELECT count(*) FILTER (len(words) > 0) AS nn, sum(len(words)) AS ll FROM d),
 q AS (SELECT DISTINCT uid AS item, item_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS uid, item_id, regexp_extract_all({_FOLD.format("text")}, '{_TERM}') AS words FROM benchmark)),
 p AS (SELECT uid, doc_id, len(words) AS n, unnest(words) AS term FROM d),
 t AS (SELECT uid, doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
 i AS (SELECT uid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))) AS impact FROM t JOIN f USING (term), s),
 r AS (SELECT item, item_id, uid, doc_id, sum(impact) AS score FROM q JOIN i USING (term) GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, uid) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= {TOP}"""
