"""Token counts of flat token files.

A file is a run of fixed-width little-endian token ids, documents one after another, each ended by the end-of-document id;
there is no index. Tasks scan byte ranges for that id, all ids of a range at once. A prefix scan over the ranges of a file
(counts of separators, and the tokens since the last one) stitches documents that cross range boundaries, whatever number
of ranges they cross.

Defined results: a null text is the empty text (a document of no tokens); tokens after the last separator of a file are an
unfinished document, reported with ``finished`` false; empty files give nothing; ids are null-safe and rows that repeat are
separate documents; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .files import RangeFile, listed, placed, ranges

RANGE = 8 << 20
RANKS = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def layout(path: str | None = None) -> tuple[int, int]:
    """(bytes of an id, end-of-document id) of the files of a vocabulary: its first free id, and what all ids fit in."""
    with open(path or default_path(), "rb") as file:
        known = {int(line.split()[1]) for line in file if line.strip()}
    separator = next(k for k in range(len(known) + 1) if k not in known)
    return 2 if max(*known, separator) < 1 << 16 else 4, separator


_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes):
    import public_tokenizers
    import tiktoken

    if (key := hash(ranks)) not in _ENCODERS:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write every document's tokens to flat files below ``folder``; returns (doc_id, file, document): its place in its file."""
    width, separator = layout(path)
    with open(path or default_path(), "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, n = next((b for b in batches if b.num_rows), None), 0
        if batch is None:
            return
        encode = _encoder(ranks.value).encode_ordinary
        name = f"part-{TaskContext.get().partitionId():06d}.tokens"
        with placed(folder, name) as out:
            while batch is not None:
                for text in batch.column(1).to_pylist():
                    out.write(np.array([*encode(text or ""), separator], f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64())], names=["doc_id", "file", "document"])
                n += batch.num_rows
                batch = next(batches, None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(flat, "doc_id long, file string, document long"), "token-places")


def _scan(width: int, separator: int):
    """Per range: its tokens, separators, and the separators' places (in tokens from the start of the file)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                file = RangeFile(r.file)
                ids = np.frombuffer(file.read(r.start, (r.end - r.start) // width * width), f"<u{width}")
                file.close()
                at = np.flatnonzero(ids == separator) + r.start // width
                yield pd.DataFrame({"file": [r.file], "block": [r.block], "stop": [r.start // width + len(ids)], "n": [len(at)], "last": [int(at[-1]) if len(at) else None], "places": [at], "before": [np.append(-1, at[:-1])[: len(at)]]}).astype({"last": "Int64"})

    return run


def counts(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    """(file, document, first_token, n_tokens, finished) of every document in the token files of a vocabulary below ``folder``."""
    width, separator = layout(path)
    scanned = ranges(spark, listed(folder, ".tokens"), RANGE // width * width).mapInPandas(_scan(width, separator), "file string, block long, stop long, n long, last long, places array<long>, before array<long>")
    scanned = stored(scanned, "token-scan")
    # The prefix scan reads one small row per range, not the places.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("file").orderBy("block")
    carry = scanned.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open"), F.lead("block").over(after).isNull().alias("ends"), F.max("last").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))
    places = scanned.join(carry, ["file", "block"])
    each = places.select("file", "first", "open", F.posexplode(F.arrays_zip("places", "before")).alias("k", "x"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("x.before")) + 1
    finished = each.select("file", (F.col("first") + F.col("k")).alias("document"), start.alias("first_token"), (F.col("x.places") - start).alias("n_tokens"), F.lit(True).alias("finished"))
    since = F.coalesce("seen", F.lit(-1)) + 1
    rest = places.where(F.col("ends") & (F.col("stop") > since)).select("file", (F.col("first") + F.col("n")).alias("document"), since.alias("first_token"), (F.col("stop") - since).alias("n_tokens"), F.lit(False).alias("finished"))
    return finished.unionByName(rest)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat token files, with the counts a scan of the files finds."""
    folder = scratch(spark, "tokens")
    places = write(table(spark, sf_dir, "documents"), folder)
    found = counts(spark, folder).withColumn("file", F.element_at(F.split("file", "/"), -1))
    return places.join(found, ["file", "document"]).select("doc_id", "file", "document", "first_token", "n_tokens")
