"""WARC archives: writing, and reading by verified record boundaries.

Writing: one record per page. Among records with equal payloads of at least 1000 bytes the one with the largest id is a
``response``, the others are ``revisit`` records that name it and carry the digest and length of the full payload.

Reading: archives have no index, and a payload may contain what looks like a record. Tasks scan byte ranges for the record
magic and emit every candidate with the offset of its successor. Pointer jumping inside each range gives, for each
candidate, the candidate where its chain leaves the range; pointer jumping over those, from the start of each file, keeps
what is reachable. Only records on the chain from a file's start are parsed.

Defined results: a null html is an empty payload, always a response; a null url is left out; a null id is the smallest, and
reads back as null; rows that repeat the largest id are all responses; an empty table writes no archive and gives no rows.
Records of other types than the two are passed over, and foreign record ids are null. A file that does not start with a
record, a chain that leads to something else and a record that is cut short are errors that name file and offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table
from .files import RangeFile, listed, placed, ranges

LEAST = 1000
RANGE = 8 << 20
HEAD = 1 << 16
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.IGNORECASE)
ID = "urn:lodestead:page:"
PAGE = re.compile(f"<{ID}(-?\\d+)>")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda x: f"<{ID}{'' if x is None else x}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str) -> int:
    """Write all pages below ``folder``; returns the number of archives."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("_sha1", F.when(F.octet_length("html") >= LEAST, F.sha1(F.col("html").cast("binary"))))
    groups = rows.where("_sha1 IS NOT NULL").groupBy("_sha1").agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    # Stored, so that the planner knows its size: it is broadcast only if small, and else joined by a shuffle.
    repeated = stored(groups.where("_n > 1 AND _response IS NOT NULL").drop("_n"), "warc-repeated")
    # Short payloads have no digest here; a number of their own deals them out, where null would be one key.
    keyed = rows.withColumn("_sha1", F.coalesce("_sha1", F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))))
    joined = keyed.join(repeated, "_sha1", "left")
    revisit = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    decided = joined.select("page_id", "url", "html", F.when(revisit, F.col("_response")).alias("refers_to"), revisit.alias("revisit"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with placed(folder, f"part-{TaskContext.get().partitionId():06d}.warc") as out:
            while first is not None:
                for values in zip(*(column.to_pylist() for column in first.columns), strict=True):
                    page_id, url, text, refers_to, again = values
                    out.write(record(page_id, url, text.encode("utf-8", "replace"), refers_to, again))
                first = next(batches, None)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["archives"])

    return decided.mapInArrow(archive, "archives long").agg(F.coalesce(F.sum("archives"), F.lit(0))).first()[0]


def header(file: RangeFile, data: bytes, base: int, at: int) -> tuple[bytes, int, int] | None:
    """(header, offset of the block, its length) of a record at ``at``; ``data`` holds the file from ``base``."""
    head, length = data[at - base : at - base + HEAD], HEAD
    while (end := head.find(b"\r\n\r\n")) < 0:
        if at + length >= file.size or len(head) < length and at + len(head) >= file.size:
            return None
        head, length = file.read(at, 4 * length), 4 * length
    found = LENGTH.search(head, 0, end + 2)
    return (head[: end + 2], at + end + 4, int(found[1])) if found else None


def jump(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """For each candidate, where its chain leaves the range; -1 where the chain breaks."""
    n = len(offsets)
    at = np.minimum(np.searchsorted(offsets, successors), max(n - 1, 0))
    inside = successors < end
    linked = inside & (offsets[at] == successors) if n else inside
    following = np.where(linked, at, np.arange(n))
    for _ in range(max(1, n).bit_length()):
        following = following[following]
    exits = np.where(inside & ~linked, -1, successors)
    return exits[following]


def _candidates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            file = RangeFile(r.file)
            data = file.read(r.start, r.end - r.start + HEAD)
            offsets, successors = [], []
            for found in MAGIC.finditer(data):
                at = r.start + found.start()
                if at >= r.end:
                    break
                if (head := header(file, data, r.start, at)) is not None:
                    offsets.append(at)
                    successors.append(head[1] + head[2] + 4)
            file.close()
            offsets, successors = np.array(offsets, np.int64), np.array(successors, np.int64)
            yield pd.DataFrame({"file": r.file, "entry": offsets, "exit": jump(offsets, successors, r.end)})


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            file, at, end, base, data, rows = RangeFile(r.file), r.entry, (r.entry // RANGE + 1) * RANGE, 0, b"", []
            base, data = at, file.read(at, end - at + HEAD)
            while at < min(end, file.size):
                found = header(file, data, base, at) if MAGIC.match(data, at - base) else None
                if found is None:
                    raise ValueError(f"{r.file}: no record at {at}")
                head, start, length = found
                if start + length + 4 > file.size:
                    raise ValueError(f"{r.file}: record cut short at {at}")
                block = data[start - base : start - base + length]
                if len(block) < length:
                    block = file.read(start, length)
                if (row := parsed(head, block)) is not None:
                    rows.append(row)
                at = start + length + 4
            file.close()
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def parsed(head: bytes, block: bytes) -> tuple | None:
    """A record's row; None for types that hold no page."""
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    id_of = lambda name: int(found[1]) if (found := PAGE.fullmatch(fields.get(name, ""))) else None
    kind, (http, _, payload) = fields.get("WARC-Type"), block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size, digest = LENGTH.search(b"\r\n" + http + b"\r\n"), fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        return id_of("WARC-Record-ID"), int(size[1]) if size else None, base64.b32decode(digest).hex() if len(digest) == 32 else None, kind, id_of("WARC-Refers-To")
    if kind == "response":
        return id_of("WARC-Record-ID"), len(payload), hashlib.sha1(payload).hexdigest(), kind, None
    return None


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records on the verified chains of the archives below ``folder``."""
    files = listed(folder, ".warc")
    chains = stored(ranges(spark, files, RANGE).mapInPandas(_candidates, "file string, entry long, exit long"), "warc-candidates")
    reached = spark.createDataFrame([(f, 0) for f, size in files if size], "file string, entry long") if files else chains.select("file", "entry").limit(0)
    most = max((-(-size // RANGE) for _, size in files), default=1)
    hops = chains.where("exit >= 0")
    for _ in range((most - 1).bit_length()):  # after k rounds, all within 2 ** k ranges of the start are known
        reached = stored(reached.join(hops, ["file", "entry"]).select("file", F.col("exit").alias("entry")).union(reached).distinct(), "warc-reached")
        ahead = hops.select("file", F.col("entry").alias("exit"), F.col("exit").alias("beyond"))
        hops = stored(hops.join(ahead, ["file", "exit"]).select("file", "entry", F.col("beyond").alias("exit")), "warc-hops")
    # What was reached and is no record is an error of the task that reads it, so that no record is lost unseen.
    entries = reached
    count = max(1, sum(-(-size // RANGE) for _, size in files))
    return entries.repartition(min(count, 100_000), "file", "entry").mapInPandas(_records, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    folder = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT h, max(page_id) AS response, count(*) AS c FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
 CASE WHEN c > 1 AND response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN c > 1 AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h AND p.n >= 1000
"""
