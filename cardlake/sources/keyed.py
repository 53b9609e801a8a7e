"""A streaming sink of records by key, in which a batch appears whole or not at all; rows that can't be written go beside them, with a reason.

Tasks write files under names of their own and tell what they hold; at a batch's commit one small manifest names its files and counts, and readers
read what manifests name. What a failed task or an aborted batch leaves is named by none. A batch that is committed again replaces its manifest, so
its rows are there once."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = "key string, value binary, raw string, reason string"


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rejects: list[str] = field(default_factory=list)
    records: int = 0
    reasons: dict[str, int] = field(default_factory=dict)


class KeyedWriter(DataSourceStreamArrowWriter):
    def __init__(self, uri: str):
        self.uri = uri

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = self._place()
        told, open_files = Written(), {}

        def put(kind: str, t: pa.Table) -> None:
            if t.num_rows:
                if kind not in open_files:
                    name = f"{kind}/{uuid.uuid4().hex}.parquet"
                    where.create_dir(f"{base}/{kind}", recursive=True)
                    open_files[kind] = name, pq.ParquetWriter(where.open_output_stream(f"{base}/{name}"), t.schema)
                open_files[kind][1].write_table(t)

        try:
            for b in iterator:
                t = pa.Table.from_batches([b])
                good = t.column("reason").is_null()
                put("records", t.filter(good).select(["key", "value"]))
                bad = t.filter(pc.invert(good)).select(["raw", "reason"])
                put("rejects", bad)
                told.records += t.num_rows - bad.num_rows
                told.reasons = dict(Counter(told.reasons) + Counter(bad.column("reason").to_pylist()))
        finally:
            for _, f in open_files.values():
                f.close()
        told.files = [open_files["records"][0]] if "records" in open_files else []
        told.rejects = [open_files["rejects"][0]] if "rejects" in open_files else []
        return told

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        where, base = self._place()
        done = [m for m in messages if m]
        reasons = sum((Counter(m.reasons) for m in done), Counter())
        told = {
            "batch": batchId,
            "files": [f for m in done for f in m.files],
            "rejects": [f for m in done for f in m.rejects],
            "records": sum(m.records for m in done),
            "reasons": [{"reason": k, "n": v} for k, v in sorted(reasons.items())],
        }
        where.create_dir(f"{base}/commits", recursive=True)
        part, whole = f"{base}/commits/.{uuid.uuid4().hex}", f"{base}/commits/{batchId:020d}.json"
        with where.open_output_stream(part) as f:
            f.write(json.dumps(told, sort_keys=True).encode())
        where.move(part, whole)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        where, base = self._place()
        for m in messages:
            for name in [*m.files, *m.rejects] if m else []:
                where.delete_file(f"{base}/{name}")


class KeyedSink(DataSource):
    """Option: path, a URI that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "keyed_records"

    def streamWriter(self, schema: StructType, overwrite: bool) -> KeyedWriter:  # noqa: N802
        return KeyedWriter(self.options["path"])


def keyed(rows: DataFrame, key: Column, value: Column, reason: Column) -> DataFrame:
    """Rows for the sink: a record's key and value, or the row as JSON and why it can't be one."""
    bad = F.coalesce(reason, F.when(key.isNull(), "key: is required"), F.when(value.isNull(), "value: can't be encoded"))
    raw = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"})
    out = rows.select(key.cast("string").alias("key"), value.alias("value"), raw.alias("raw"), bad.alias("reason"))
    good = F.col("reason").isNull()
    return out.select(
        F.when(good, F.col("key")).alias("key"), F.when(good, F.col("value")).alias("value"), F.when(~good, F.col("raw")).alias("raw"), "reason"
    )


def write(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes a stream of ``keyed`` rows until nothing is left."""
    stream.sparkSession.dataSource.register(KeyedSink)
    stream.writeStream.format("keyed_records").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


MANIFEST = "batch long, files array<string>, rejects array<string>, records long, reasons array<struct<reason: string, n: long>>"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each committed batch."""
    return spark.read.schema(MANIFEST).json(f"{path}/commits/*.json")


def _named(spark: SparkSession, path: str, column: str, schema: str) -> DataFrame:
    files = [f"{path}/{r.f}" for r in manifests(spark, path).select(F.explode(column).alias("f")).collect()]  # names of files
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def records(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark, path, "files", "key string, value binary")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark, path, "rejects", "raw string, reason string")
