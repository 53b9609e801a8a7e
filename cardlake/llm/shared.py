"""Where operators put files that the driver and all executors must see, and how tasks open them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that are named inside go at the end: what was computed from them has to be written by then."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        for uri in made:
            remove(spark, uri)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared place that spark.checkpoint.dir names.

    Only where no such place is set, as in tests on one machine, a local one is made and set; a cluster's machines wouldn't share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="cardlake-")
        spark.sparkContext.setCheckpointDir(base)
    uri = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(uri)
    return uri


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: it survives lost executors and isn't computed again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, uri: str) -> None:
    """Deletes a folder that shared_folder named, by Hadoop's file system for it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, for tasks."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
