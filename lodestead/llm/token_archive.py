"""Token ids as files of separately compressed documents.

Every document's ids are one array of little-endian integers (two bytes where the vocabulary allows), ended by the
end-of-document id. A zstandard dictionary is trained on a bounded sample of such arrays, and each document is a frame of its
own under it, so that a short document is small and is read without its neighbours.

File: ``MAGIC``, the frames one after another, an index (four arrays of 64-bit integers, one entry a document: its id, whether it
has one, where its frame ends, its number of ids), and a tail of fixed length: documents, ids, place of the index, bytes of an
id, and the dictionary's SHA-256. The dictionary lies beside the files under its hash; a reader refuses a file whose hash it
cannot find. ``read`` goes through all files by blocks of frames; ``lookup`` reads single documents by their place.

Documents are in ascending order of doc_id over the files, null first; ties (repeated ids) by their number of ids and
checksum, then in any order, since they are then equal. Order comes from a range partitioning by all three, so a repeated id is not
one task's. A file that a lost task leaves is hidden, a task that runs again writes the same bytes.

Defined results: a null text is the empty text (the end id alone); repeated rows are documents each; an empty table writes no
file and gives no rows; where a sample is too small to train on, its bytes are the dictionary as they stand, and without any sample
there is none; other columns are ignored, whatever their names; texts are never cut. Special tokens' strings in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filesystem, scratch, stored, table
from .files import RangeFile, listed, placed

MAGIC, SUFFIX = b"LODETOK1", ".idz"
TAIL = "<4q32s"
END = 1
LEVEL = 3
#: The dictionary's size, and what it is trained on: at most so many arrays of at most so many bytes, those of least hash.
DICTIONARY, SAMPLES, SAMPLE_BYTES = 112 << 10, 2048, 8 << 10
#: Bytes of id arrays in a partition of the sorted documents, and of frames that a task reads at once.
PARTITION, BLOCK = 64 << 20, 8 << 20
#: Bytes of text that are encoded together.
TEXTS = 8 << 20
#: Chunks of text a worker remembers, the longest of them, how many are encoded at once and what stands between them.
REMEMBERED, LONGEST, TOGETHER, MARK = 1_200_000, 64, 2048, "\x00"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def separable(data: dict) -> bool:
    """Whether texts may be encoded piece by piece between ASCII white space: it is dropped, and nothing looks across it."""
    normalizers = data.get("normalizer") or {}
    steps = normalizers.get("normalizers", [normalizers])
    splits = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
    drops = bool(splits) and splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and r"[^\s" in splits[0]["pattern"].get("Regex", "")
    known = [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    return bool(drops and known and not data.get("post_processor") and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in data.get("added_tokens", [])))


class Encoder:
    """Texts (UTF-8) to arrays of ids, by a tokenizer file.

    Where texts are separable, each chunk between white space is encoded once and remembered. Chunks are told apart without
    the case of ASCII letters, which the file's normalizer drops, unless the text has combining marks that may compose
    with such a letter, or an added token in either case. A full stop or comma after an ASCII letter or digit is a
    piece of its own, so the chunk is remembered without it. New chunks are encoded many at a time, with a mark between
    them that has an id of its own. The memory is one Arrow array of chunks and one array of their ids; the older
    half goes when it is full.
    """

    def __init__(self, file: bytes, end: int = END):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        data = json.loads(file)
        if data.get("truncation") or data.get("padding"):
            raise ValueError("the tokenizer file must not cut or pad texts")
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.width = id_width(data)
        self.type = f"<u{self.width}"
        self.end = np.array([end], self.type).tobytes()
        self.added = [x["content"].lower().encode() for x in data.get("added_tokens", [])]
        single = [self.ids_of(x) for x in (MARK, ".", ",")]
        self.separable = separable(data) and all(len(x) == 1 for x in single)
        self.mark, *self.stops = [x[0] for x in single if len(x)]
        self.known = pa.array([], pa.large_string())
        self.ids, self.lengths = np.empty(0, self.type), np.empty(0, np.int64)

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The arrays of a batch."""
        if not self.separable:
            return [self.ids_of(text.decode()).tobytes() + self.end for text in texts]
        parted = pc.ascii_split_whitespace(pa.array([self.folded(t) for t in texts], pa.large_binary()).cast(pa.large_string()))
        words = parted.flatten().dictionary_encode()
        ids, lengths = self.of_chunks(words.dictionary)
        flat, until = _gathered(ids, lengths, words.indices.to_numpy())
        ends = until[parted.offsets.to_numpy()].tolist()
        return [flat[a:b].tobytes() + self.end for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def folded(self, text: bytes) -> bytes:
        low = text.lower()
        return text if b"\xcc" in low or b"\xcd" in low or any(x in low for x in self.added) else low

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after another, and how many each has."""
        stopped = pc.match_substring_regex(chunks, r"[0-9A-Za-z][.,]$").to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(stopped), pc.utf8_slice_codeunits(chunks, 0, -1), chunks).dictionary_encode()
        ids, lengths = self.of_stems(stems.dictionary)
        flat, until = _gathered(ids, lengths, stems.indices.to_numpy(), stopped)
        comma = pc.ends_with(chunks, ",").to_numpy(zero_copy_only=False)
        flat[until[1:][stopped] - 1] = np.where(comma[stopped], self.stops[1], self.stops[0])
        return flat, np.diff(until)

    def of_stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(stems, value_set=self.known)
        new = stems.filter(pc.is_null(at))
        made = self.made(new.to_pylist())
        lengths = np.fromiter(map(len, made), np.int64, len(made)) // self.width
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), self.type)])
        places = at.fill_null(0).to_numpy().astype(np.int64)
        places[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        flat, until = _gathered(ids, np.concatenate([self.lengths, lengths]), places)
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        kept = short.to_numpy(zero_copy_only=False)
        self.known = pa.concat_arrays([self.known, new.filter(short)])
        self.ids, self.lengths = np.concatenate([self.ids, np.frombuffer(b"".join([x for x, k in zip(made, kept.tolist(), strict=True) if k]), self.type)]), np.concatenate([self.lengths, lengths[kept]])
        if (n := len(self.known) // 2) > REMEMBERED // 2:
            self.known, self.ids, self.lengths = pa.concat_arrays([self.known.slice(n)]), self.ids[self.lengths[:n].sum() :].copy(), self.lengths[n:].copy()
        return flat, np.diff(until)

    def made(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks as bytes, many encoded at once."""
        out = []
        for k in range(0, len(chunks), TOGETHER):
            some = chunks[k : k + TOGETHER]
            if MARK in "".join(some):
                out += [self.ids_of(c).tobytes() for c in some]
                continue
            ids = self.ids_of(f" {MARK} ".join(some))
            at = self.width * np.flatnonzero(ids == self.mark)
            data = ids.tobytes()
            out += map(data.__getitem__, map(slice, [0, *(at + self.width).tolist()], [*at.tolist(), len(data)]))
        return out


def _gathered(ids: np.ndarray, lengths: np.ndarray, places: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The runs at ``places`` one after another, each with ``more`` ids behind it that are still to be set, and where they begin and end."""
    n = lengths[places] + more
    until = np.append(0, np.cumsum(n))
    if not len(ids):
        return np.zeros(until[-1], ids.dtype), until
    at = np.arange(until[-1]) + np.repeat((np.cumsum(lengths) - lengths)[places] - until[:-1], n)
    return ids[np.minimum(at, len(ids) - 1, out=at)], until


@cache
def _encoder(file: bytes) -> Encoder:
    """One a worker, which keeps its memory from task to task."""
    return Encoder(file)


def id_width(data: dict) -> int:
    """Bytes of an id: two where all ids fit."""
    ids = [*data["model"]["vocab"].values(), *(x["id"] for x in data.get("added_tokens", [])), END]
    return 2 if max(ids) < 1 << 16 else 4


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, crc32): arrays with their end id."""
    with open(path or default_path(), "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a few MB whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts, begin, size = batch.column(1), 0, 0
            for k in range(len(texts) + 1):
                if k == len(texts) or size > TEXTS:
                    if k > begin:
                        ids = encoder.encode([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[begin:k]])
                        arrays = [np.frombuffer(x, encoder.type) for x in ids]
                        yield pa.RecordBatch.from_arrays([batch.column(0)[begin:k], pa.array(ids, pa.binary()), pa.array([len(x) for x in arrays], pa.int64()), pa.array([crc(x) for x in arrays], pa.int64())], names=["doc_id", "ids", "n_tokens", "crc32"])
                    begin, size = k, 0
                size += (texts[k].as_buffer().size if texts[k].is_valid else 0) if k < len(texts) else 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n_tokens long, crc32 long")


def trained(arrays: DataFrame) -> bytes:
    """A dictionary from the sample: the distinct short arrays of least hash. Bounded by SAMPLES * SAMPLE_BYTES."""
    import zstandard

    short = arrays.where(F.octet_length("ids") <= SAMPLE_BYTES).select("ids", F.xxhash64("ids").alias("h"))
    least = [r.h for r in short.select("h").distinct().orderBy("h").limit(SAMPLES).collect()]
    found = {r.ids for r in short.where(F.col("h") <= least[-1]).dropDuplicates(["h"]).select("ids").collect()} if least else set()
    samples = sorted(map(bytes, found))
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few
        return b"".join(samples)[-DICTIONARY:]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write(docs: DataFrame, folder: str, path: str | None = None) -> DataFrame:
    """Write all documents below ``folder``; returns (doc_id, file, document): each one's place."""
    spark = docs.sparkSession
    arrays = stored(encoded(docs, path), "token-arrays")
    dictionary = trained(arrays)
    name = hashlib.sha256(dictionary).digest()
    with placed(folder, f"{name.hex()}.zdict") as out:
        out.write(dictionary)
    with open(path or default_path(), "rb") as file:
        width = id_width(json.load(file))
    shared = spark.sparkContext.broadcast(dictionary)
    size = arrays.agg(F.sum("n_tokens")).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value)).compress
        file, n, ids, ends, tokens = f"part-{TaskContext.get().partitionId():06d}{SUFFIX}", 0, [], [], []
        with placed(folder, file) as out:
            out.write(MAGIC)
            at = len(MAGIC)
            while batch is not None:
                for array in batch.column(1):
                    frame = compress(array.as_buffer())
                    out.write(frame)
                    at += len(frame)
                    ends.append(at)
                ids.append(batch.column(0))
                tokens.append(batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64())], names=["doc_id", "file", "document"])
                n += batch.num_rows
                batch = next(batches, None)
            found = pa.chunked_array(ids)
            lengths = np.concatenate(tokens)
            index = [found.fill_null(0).to_numpy(), found.is_valid().to_numpy(), ends, lengths]
            out.write(b"".join(np.asarray(x).astype("<i8").tobytes() for x in index))
            out.write(struct.pack(TAIL, n, int(lengths.sum()), at, width, name))

    parts = max(1, -(-size * width // PARTITION))
    ordered = arrays.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids", "n_tokens")
    return stored(ordered.mapInArrow(run, "doc_id long, file string, document long"), "token-places")


def _tail(file: RangeFile) -> tuple[int, int, int, int, bytes]:
    """(documents, ids, place of the index, bytes of an id, dictionary's hash); a file that is not whole is an error."""
    if file.size < len(MAGIC) + struct.calcsize(TAIL) or file.read(0, len(MAGIC)) != MAGIC:
        raise ValueError(f"{file.path}: not a token archive")
    found = struct.unpack(TAIL, file.read(file.size - struct.calcsize(TAIL), struct.calcsize(TAIL)))
    if found[2] + 32 * found[0] + struct.calcsize(TAIL) != file.size:
        raise ValueError(f"{file.path}: the index does not fit the file")
    return found


def _index(file: RangeFile, documents: int, at: int, first: int, last: int) -> list[np.ndarray]:
    """The four arrays of the index for documents ``first`` to ``last`` - 1; ends begin with where the first frame begins."""
    part = lambda k, a, b: np.frombuffer(file.read(at + 8 * (k * documents + a), 8 * (b - a)), "<i8")
    ends = part(2, max(0, first - 1), last)
    return [part(0, first, last), part(1, first, last), ends if first else np.append(len(MAGIC), ends), part(3, first, last)]


def _of_file(folder: str, name: bytes) -> bytes:
    """The dictionary of that hash beside the files."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{name.hex()}.zdict") as stream:
        data = stream.read()
    if hashlib.sha256(data).digest() != name:
        raise ValueError(f"{folder}: the dictionary {name.hex()} is damaged")
    return data


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, first, last, before): runs of documents of about BLOCK bytes of frames, with the ids before them in all files."""
    files = spark.createDataFrame(listed(folder, SUFFIX), "file string, size long").select("file")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["file"]:
                file = RangeFile(path)
                documents, _, at, *_ = _tail(file)
                ends, tokens = _index(file, documents, at, 0, documents)[2:]
                file.close()
                # A block ends with the document in which a multiple of BLOCK bytes lies.
                cut = np.unique(np.append(np.searchsorted(ends[1:], np.arange(BLOCK, ends[-1], BLOCK)) + 1, documents))
                cut = cut[cut <= documents]
                first = np.append(0, cut[:-1])
                total = np.append(0, np.cumsum(tokens))
                yield pd.DataFrame({"file": path, "block": np.arange(len(cut)), "first": first, "last": cut, "inside": total[first], "n": total[cut] - total[first]})

    found = stored(files.repartition(max(1, min(10_000, len(listed(folder, SUFFIX)))), "file").mapInPandas(run, "file string, block long, first long, last long, inside long, n long"), "token-blocks")
    # The prefix scan over files: one row each.
    total = found.groupBy("file").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return found.join(starts, "file").select("file", "block", "first", "last", (F.col("start") + F.col("inside")).alias("before"))


def _documents(folder: str):
    """Frames of runs of documents, decompressed one by one: (doc_id, file, document, start, ids as 32-bit integers)."""
    import zstandard

    readers: dict[bytes, object] = {}

    def run(path: str, first: int, last: int, before: int) -> Iterator[tuple]:
        file = RangeFile(path)
        documents, _, at, width, name = _tail(file)
        if name not in readers:
            readers[name] = zstandard.ZstdDecompressor(dict_data=_dictionary(_of_file(folder, name))).decompress
        ids, valid, ends, tokens = _index(file, documents, at, first, last)
        data = memoryview(file.read(int(ends[0]), int(ends[-1] - ends[0])))
        file.close()
        for k in range(last - first):
            found = np.frombuffer(readers[name](data[ends[k] - ends[0] : ends[k + 1] - ends[0]]), f"<u{width}")
            if len(found) != tokens[k]:
                raise ValueError(f"{path}: document {first + k} has {len(found)} of {tokens[k]} ids")
            yield int(ids[k]) if valid[k] else None, path, first + k, before, found.astype("<u4")
            before += len(found)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, file, document, start, n_tokens, ids_crc32[, ids]) of all documents below ``folder``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents, rows, size = _documents(folder), [], 0
        names = ["doc_id", "file", "document", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
        for frame in frames:
            for r in frame.itertuples():
                for doc_id, file, document, start, ids in documents(r.file, r.first, r.last, r.before):
                    rows.append((doc_id, file, document, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if with_ids else [])))
                    size += len(ids) * with_ids + 64
                    if size > BLOCK:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    work = blocks(spark, folder)
    runs = max(1, min(100_000, sum(size for _, size in listed(folder, SUFFIX)) // BLOCK + len(listed(folder, SUFFIX))))
    columns = "doc_id long, file string, document long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return work.select("file", "first", "last", "before", "block").repartition(runs, "file", "block").mapInPandas(run, columns)


def lookup(places: DataFrame, folder: str) -> DataFrame:
    """(doc_id, file, document, ids) of single documents by (file, document), as ``write`` gives them: one frame is read for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = _documents(folder)
        for frame in frames:
            for r in frame.itertuples():
                doc_id, _, document, _, ids = next(documents(f"{folder}/{r.file}", r.document, r.document + 1, 0))
                yield pd.DataFrame({"doc_id": [doc_id], "file": [r.file], "document": [document], "ids": [ids]}).astype({"doc_id": "Int64"})

    return places.select("file", "document").mapInPandas(run, "doc_id long, file string, document long, ids array<long>")


def op12_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as compressed id arrays and read back."""
    folder = scratch(spark, "token-archive")
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32", F.element_at(F.split("file", "/"), -1).alias("file"), "document")
