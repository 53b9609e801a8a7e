"""A change table as a stream: a source that tails it by version.

The table is a folder of Parquet files whose rows have a binary, big-endian version (``__$start_lsn``), written by ``write_changes`` in the order
of versions. An offset is the last version that was read. A batch takes the versions above the last batch's up to the greatest there is
then; the files' footers say which row groups have any of them, and each group of such is a partition of its own. The start is kept in the
query's checkpoint, so a stopped query goes on where it was. Versions that were cleaned up meanwhile are skipped: reading begins at the least one left."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

VERSION, SEQUENCE = "__$start_lsn", "__$seqval"
#: Rows of a partition, beyond which the next row group begins another one.
ROWS = 1_000_000


def write_changes(table: DataFrame, path: str) -> None:
    """Appends rows of a change table as files of ascending, mostly disjoint ranges of versions."""
    order = [f"`{c}`" for c in (VERSION, SEQUENCE) if c in table.columns]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    table.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.mode("append").parquet(path)


@dataclass
class Range(InputPartition):
    """Row groups of a file, and the versions above start and up to end."""

    path: str
    groups: tuple[int, ...]
    start: str
    end: str


class ChangeReader(DataSourceStreamReader):
    def __init__(self, uri: str, schema: StructType, start: str):
        self.uri, self.schema, self.first = uri, schema, start
        self.footers: dict[str, list[tuple[int, int, bytes, bytes]]] = {}

    def _files(self) -> dict[str, list[tuple[int, int, bytes, bytes]]]:
        """(row group, rows, least and greatest version) of each file; footers are read once."""
        where, path = fs.FileSystem.from_uri(self.uri)
        names = [f.path for f in where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet") and "/_" not in f.path]

        def footer(name: str) -> list[tuple[int, int, bytes, bytes]]:
            with where.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            at = meta.schema.names.index(VERSION)
            groups = [(i, meta.row_group(i)) for i in range(meta.num_row_groups)]
            return [(i, g.num_rows, (s := g.column(at).statistics).min, s.max) for i, g in groups if g.num_rows]

        new = [name for name in names if name not in self.footers]
        with ThreadPoolExecutor(16) as pool:
            self.footers |= dict(zip(new, pool.map(footer, new), strict=True))
        return {name: self.footers[name] for name in names}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"version": self.first}

    def latestOffset(self) -> dict:  # noqa: N802
        top = max((hi for groups in self._files().values() for *_, hi in groups), default=b"")
        return {"version": max(top.hex(), self.first)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        lo, hi = bytes.fromhex(start["version"]), bytes.fromhex(end["version"])
        out = []
        for name, groups in sorted(self._files().items()):
            mine: list[int] = []
            held = 0
            for i, rows, least, most in groups:
                if most <= lo or least > hi:
                    continue
                if mine and held + rows > ROWS:
                    out.append(Range(name, tuple(mine), start["version"], end["version"]))
                    mine, held = [], 0
                mine, held = [*mine, i], held + rows
            if mine:
                out.append(Range(name, tuple(mine), start["version"], end["version"]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.uri)
        kinds = to_arrow_schema(self.schema)
        lo, hi = (pa.scalar(bytes.fromhex(x), pa.binary()) for x in (partition.start, partition.end))
        with where.open_input_file(partition.path) as f:
            for b in pq.ParquetFile(f).iter_batches(row_groups=list(partition.groups), columns=kinds.names):
                version = b.column(b.schema.get_field_index(VERSION))
                t = pa.Table.from_batches([b.filter(pc.and_(pc.greater(version, lo), pc.less_equal(version, hi)))])
                yield from t.select(kinds.names).cast(kinds).to_batches()


class ChangeTable(DataSource):
    """Options: path, a URI that all machines share; start, the hexadecimal version after which to begin (none: the least one)."""

    @classmethod
    def name(cls) -> str:
        return "change_table"

    def schema(self) -> StructType:
        raise ValueError("a change table is read with a schema")

    def streamReader(self, schema: StructType) -> ChangeReader:  # noqa: N802
        return ChangeReader(self.options["path"], schema, self.options.get("start", ""))


def tail(spark: SparkSession, path: str, schema: StructType, start: bytes = b"") -> DataFrame:
    """The stream of a change table's rows."""
    spark.dataSource.register(ChangeTable)
    return spark.readStream.format("change_table").schema(schema).option("start", start.hex()).load(path)
