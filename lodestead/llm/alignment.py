"""Alignment of two tokenizers by elementary intervals.

Every text is encoded by both tokenizers, and the byte ranges of their tokens are laid over each other. The union of both
arrays of ends cuts the text into elementary intervals; a binary search finds the one token of each side that owns an
interval, so that each interval is one overlap of an A token and a B token. An end that both sides share closes a group:
the least run of A tokens that spells the same bytes as a run of B tokens. ``expanded`` gives the product of each group;
the links that are counted are the pairs whose ranges end together.

What links have in common across the corpus is counted once per block of documents (about a million links each, found while
encoding), not per document: blocks send their distinct id pairs to the counts and get back one row a pair, however often
the pair stands in them. A pair that every text holds is thus as many rows as there are blocks. Documents keep their links as places in
their block's sorted pairs.

Defined results: a text that is null, empty, or whose tokens' joined bytes differ from space + text on either side (a text
with U+2581, say) has no tokens, zeros everywhere and the empty string as its groups; special tokens' strings in a text are
ordinary text; repeated rows (and null or repeated doc_ids) are documents each; other columns are ignored, whatever their
names; a text is never cut, a document longer than a block is a block of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe_automaton import byte_of_char
from .common import stored, table

#: Links after which a block of documents is closed.
BLOCK = 1 << 20
#: Rows of a batch that a task passes on, and bytes of one.
BATCH, BATCH_BYTES = 10_000, 16 << 20


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide:
    """The byte-level vocabulary of a tokenizer file, without special tokens, on space + text."""

    def __init__(self, file: bytes):
        import tiktoken

        from .bpe_automaton import load_data

        data = load_data(json.loads(file))
        to_byte = byte_of_char()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in data["vocabulary"].items() if token not in data["added"]}
        made = [data["vocabulary"][a + b] for a, b in data["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of the merges must ascend")
        self.spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.spelled[i] = token
        self.encode = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> list[int]:
        return self.encode(" " + text)


#: Fixed value: the pattern of the byte-level pre-tokeniser.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceSide:
    """The pieces of a sentencepiece model, which puts the space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteSide(a), PieceSide(b)
        self.sizes = [np.array([len(s) for s in side.spelled], np.int64) for side in (self.a, self.b)]
        # Ids as they stand in the written form of the groups, with the mark that follows: A "," or "|", B "," or ";".
        n, m = len(self.a.spelled), len(self.b.spelled)
        self.marks = [b"%d," % i for i in range(n)] + [b"%d|" % i for i in range(n)] + [b"%d," % i for i in range(m)] + [b"%d;" % i for i in range(m)]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the bytes of a side are not those of space + text."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        wanted, found = b" " + text.encode(), []
        for side in (self.a, self.b):
            ids = side.ids(text)
            if b"".join([side.spelled[i] for i in ids]) != wanted:
                return none, none
            found.append(np.array(ids, np.int64))
        return found[0], found[1]

    def align(self, text: str | None) -> Alignment:
        ids = self.tokens(text)
        return Alignment(*ids, *(np.cumsum(size[i]) for size, i in zip(self.sizes, ids, strict=True)))

    def written(self, x: Alignment) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``."""
        if not len(x.ids_a):
            return b""
        n, m = len(self.a.spelled), len(self.b.spelled)
        out = np.empty(len(x.ids_a) + len(x.ids_b), np.int64)
        # A group's A tokens stand after all B tokens of earlier groups, its B tokens after its own A tokens.
        out[np.arange(len(x.ids_a)) + np.append(0, x.last_b + 1)[x.group_a]] = x.ids_a + n * x.closes_a
        out[np.arange(len(x.ids_b)) + (x.last_a + 1)[x.group_b]] = x.ids_b + 2 * n + m * x.closes_b
        return b"".join([self.marks[i] for i in out.tolist()])[:-1]


class Alignment:
    """Two token runs over the same bytes, given by their ids and byte ends."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.ids_a, self.ids_b = ids_a, ids_b
        cuts = np.union1d(ends_a, ends_b)
        #: The owners of each elementary interval: one overlap.
        self.owner_a, self.owner_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        closed = (ends_a[self.owner_a] == cuts) & (ends_b[self.owner_b] == cuts)
        #: The tokens that end each group, and the byte it ends at.
        self.last_a, self.last_b, self.ends = self.owner_a[closed], self.owner_b[closed], cuts[closed]
        self.closes_a, self.closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        self.closes_a[self.last_a] = self.closes_b[self.last_b] = 1
        self.group_a, self.group_b = np.cumsum(self.closes_a) - self.closes_a, np.cumsum(self.closes_b) - self.closes_b

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pairs of tokens whose byte ranges end together."""
        return self.ids_a[self.last_a], self.ids_b[self.last_b]

    def groups(self) -> list[dict]:
        cut = lambda ids, last: np.split(ids, last[:-1] + 1) if len(last) else []
        starts = np.append(0, self.ends)
        return [{"start": s, "end": e, "a": a.tolist(), "b": b.tolist()} for s, e, a, b in zip(starts.tolist(), self.ends.tolist(), cut(self.ids_a, self.last_a), cut(self.ids_b, self.last_b), strict=False)]


@cache
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _files(spark: SparkSession, paths: tuple[str, str] | None):
    """The vocabulary files, a few MB whatever the corpus."""
    return spark.sparkContext.broadcast([open(p, "rb").read() for p in paths or default_paths()])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def aligned(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, overlaps, groups): per document the owners of each interval (places of tokens), and the groups with their byte ranges and ids."""
    files = _files(docs.sparkSession, paths)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = _aligner(*files.value)
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):  # one text's groups at a time
                x = aligner.align(text)
                overlaps = [{"a": a, "b": b} for a, b in zip(x.owner_a.tolist(), x.owner_b.tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": [doc_id], "overlaps": [overlaps], "groups": [x.groups()]}).astype({"doc_id": "Int64"})

    return _texts(docs).mapInPandas(run, "doc_id long, overlaps array<struct<a: int, b: int>>, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


def expanded(groups: DataFrame) -> DataFrame:
    """(doc_id, group, a, b): all pairs within each group of ``aligned``."""
    each = groups.select("doc_id", F.posexplode("groups").alias("group", "g"))
    return each.select("doc_id", "group", F.explode("g.a").alias("a"), "g.b").select("doc_id", "group", "a", F.explode("b").alias("b"))


ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, n long"


def blocks(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Rows of two kinds: documents with their figures and links (``pair`` null), and the distinct pairs of a block with their number.

    A pair is a * number of B ids + b; a document's links are places in the sorted pairs of its block, as 32-bit integers.
    """
    files = _files(docs.sparkSession, paths)
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])

    def closed(name: int, rows: list[tuple], links: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, places, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
        places, at = places.astype("<i4"), np.append(0, np.cumsum([len(x) for x in links]))
        begin, size = 0, 0
        for k in range(len(rows) + 1):
            if k == len(rows) or k - begin == BATCH or size > BATCH_BYTES:
                if k > begin:
                    columns = [[name] * (k - begin), *map(list, zip(*rows[begin:k], strict=True)), [np.sort(places[at[i] : at[i + 1]]).tobytes() for i in range(begin, k)]]
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)], pa.nulls(k - begin, pa.int64()), pa.nulls(k - begin, pa.int64())], schema=schema)
                begin, size = k, 0
            size += 4 * len(links[k]) if k < len(rows) else 0
        for i in range(0, len(pairs), BATCH):
            found = pairs[i : i + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), name)), *[pa.nulls(len(found), f.type) for f in list(schema)[1:8]], pa.array(found), pa.array(n[i : i + BATCH])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, name = _aligner(*files.value), TaskContext.get().partitionId() << 32
        width = len(aligner.b.spelled)
        rows, links, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = aligner.align(text.as_py())
                a, b = x.links()
                written = aligner.written(x)
                rows.append((doc_id, len(x.ids_a), len(x.ids_b), len(x.ends), len(a), hashlib.sha256(written).hexdigest() if written else ""))
                links.append(a * width + b)
                size += len(a)
                if size >= block or len(rows) >= block:
                    yield from closed(name, rows, links)
                    rows, links, size, name = [], [], 0, name + 1
        if rows:
            yield from closed(name, rows, links)

    return _texts(docs).mapInArrow(run, ROWS)


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): links of each id pair, and whether no other pair of its B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.col("pair") % width)))


FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block with the counts of its pairs."""
    pairs = pairs.sort_values("pair")
    count, best = pairs["count"].to_numpy(np.int64), pairs["best"].to_numpy(np.int64)
    places = [np.frombuffer(x, "<i4") for x in docs["links"]]
    return docs.assign(n_best=[int(best[x].sum()) for x in places], count_sum=[int(count[x].sum()) for x in places])[[c.split()[0] for c in FOUND.split(", ")]]


def figures(docs: DataFrame, paths: tuple[str, str] | None = None, block: int = BLOCK) -> DataFrame:
    """Per document the number of tokens, groups and links, how its links rank in the corpus, and a digest of its groups."""
    paths = paths or default_paths()
    with open(paths[1], "rb") as file:
        width = len(PieceSide(file.read()).spelled)
    rows = stored(blocks(docs, paths, block), "alignment")
    pairs = rows.where("pair IS NOT NULL").select("block", "pair", "n")
    known = pairs.select(F.col("block").alias("of"), "pair").join(pair_counts(pairs, width), "pair")
    mine = rows.where("pair IS NULL").drop("pair", "n")
    return mine.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(_scored, FOUND)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level and the piece vocabulary."""
    return figures(table(spark, sf_dir, "documents"))
