"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests, one machine) a temporary one is set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        option = context._jsc.sc().getCheckpointDir()
        folder = option.get() if option.isDefined() else None
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestead-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Paths that this driver has handed out and not cleared.
WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    WRITTEN.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def clear(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete what was written below the paths from number ``since`` on; nothing that reads them may still be due."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in [p for p in WRITTEN[since:] if p not in keep]:
        folder = hadoop.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        WRITTEN.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, sizes are known to the planner."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; plain paths are local, Hadoop's names of S3 are read as its own."""
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        uri = uri.replace(name, "s3://", 1) if uri.startswith(name) else uri

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1) if uri.startswith("file:") else uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: int, per_bucket: int = 50_000, least: int = 64) -> int:
    """Number of buckets for ``rows`` rows: a function of the data alone, so that reruns agree on any cluster."""
    return max(least, -(-rows // per_bucket))


def unused(name: str, columns: list[str]) -> str:
    """A column name that the input does not have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
