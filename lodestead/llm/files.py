"""Files in the shared folder: one per task, put in place when complete, read by byte range with retries."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem

TRIES = 4


@contextlib.contextmanager
def placed(folder: str, name: str) -> Iterator:
    """A stream to ``folder/name``. A task that runs again replaces the file with the same bytes; half files never show."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    hidden = f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as stream:
        yield stream
    fs.move(hidden, f"{path}/{name}")


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the complete files below a folder."""
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    host = folder[len(scheme) : folder.index(path)] if scheme and path in folder else ""
    return sorted((f"{scheme}{host}{x.path}", x.size) for x in found if x.is_file and x.path.endswith(suffix) and not x.base_name.startswith("_"))


class RangeFile:
    """A file read by (offset, length); a read that fails or comes short is tried again on a fresh handle."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.handle = None
        self.size = self.fs.get_file_info(self.path).size

    def read(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        for attempt in range(TRIES):
            try:
                if self.handle is None:
                    self.handle = self.fs.open_input_file(self.path)
                self.handle.seek(offset)
                data = self.handle.read(length)
                if len(data) == length:
                    return data
                error: OSError = OSError(f"{self.path}: {len(data)} of {length} bytes at {offset}")
            except OSError as failure:
                error = failure
            with contextlib.suppress(OSError):
                self.close()
            if attempt + 1 < TRIES:
                time.sleep(0.1 * 2**attempt)
        raise error

    def close(self) -> None:
        handle, self.handle = self.handle, None
        if handle is not None:
            handle.close()


def ranges(spark: SparkSession, files: list[tuple[str, int]], length: int, name: str = "file") -> DataFrame:
    """(file, size, block, start, end): the byte ranges of files, spread over the cluster."""
    known = spark.createDataFrame(files, f"{name} string, size long") if files else spark.createDataFrame([], f"{name} string, size long")
    cut = known.where("size > 0").select(name, "size", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(length))).alias("block", "start"))
    blocks = sum(-(-size // length) for _, size in files)
    return cut.select(name, "size", F.col("block").cast("long").alias("block"), "start", F.least(F.col("start") + length, F.col("size")).alias("end")).repartition(max(1, min(blocks, 100_000)), name, "start")
