"""Shards by jump consistent hashing: a stable key and the number of shards decide, without a table of ring points.

Law `key`: a row's shard follows from its doc_id alone, and when a shard is appended a row stays or goes to the new one; of n + 1
shards it goes there with a chance of 1 / (n + 1). A key is the first 64 bits of the MD5 digest of the id in decimal, so that ids in any pattern
spread evenly; a null id counts as an empty one.

`with_shard` adds the shard to rows of any kind, without a shuffle; `moves` lists the rows that change their shard; `write` deals and writes
whole documents; `slots` numbers the documents of each shard without gaps, by ascending doc_id (null first), then by a hash of the text. Documents
that share a doc_id and a text are equal: they are counted before they are dealt, and each gets a slot of its own. Null texts count as empty
(size 1, crc 0). An empty table gives an empty one. In `with_shard` and `write`, other columns stay, and ones named like results are replaced;
`slots` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions, shared_folder, table

#: Equal documents that are numbered as one row.
COPIES = 1 << 16
_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: from shard b a key jumps to where the next of its random numbers says, while that is below shards."""
    key = keys.astype(np.uint64)
    out = np.zeros(len(key), dtype=np.int64)
    going = np.arange(len(key))
    while len(going):
        key = key * _STEP + np.uint64(1)
        to = ((out[going] + 1) * (float(1 << 31) / ((key >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        on = to < shards
        going, key = going[on], key[on]
        out[going] = to[on]
    return out.astype(np.int32)


def key(id: Column) -> Column:
    """The 64-bit key of an id, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit(""))), 1, 16), 16, -10).cast("long")


def shard(id: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy().view(np.uint64), shards))

    return of(key(id))


def with_shard(docs: DataFrame, shards: int, id: str = "doc_id") -> DataFrame:
    """docs and their shard."""
    return docs.withColumn("shard", shard(F.col(id), shards))


def moves(docs: DataFrame, shards: int, grown: int, id: str = "doc_id") -> DataFrame:
    """The rows whose shard changes from the first number of shards to the second: old_shard, shard."""
    both = docs.withColumns({"old_shard": shard(F.col(id), shards), "shard": shard(F.col(id), grown)})
    return both.where(F.col("old_shard") != F.col("shard"))


def write(docs: DataFrame, folder: str, shards: int, id: str = "doc_id", files: int = 8) -> None:
    """Writes the documents as Parquet, a folder for each shard and about that many files in it: whole rows, dealt by shard and a hash of the row's key and text."""
    spread = F.pmod(F.xxhash64(F.col(id), F.col("text"), F.spark_partition_id()), F.lit(files))
    rows = with_shard(docs, shards, id).withColumn("__file", spread).repartition(shards * files, "shard", "__file").drop("__file")
    rows.write.partitionBy("shard").parquet(folder)


ROWS = "part int, doc_id long, size long, text_crc32 long, shard int, grown_shard int, n long, before long"


def slots(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot, grown_shard (with one shard more): a row for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    equal = one.groupBy("doc_id", "size", "text_crc32", "hash").agg(F.count(F.lit(1)).alias("all"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / COPIES)))
    chunks = equal.withColumn("chunk", chunk).withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("all") - F.col("chunk") * COPIES))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """before: documents of the shard that this task has met before."""
        part, met = TaskContext.get().partitionId(), np.zeros(shards + 1, dtype=np.int64)
        for b in batches:
            keys, n = b.column(3).to_numpy().view(np.uint64), b.column(4).to_numpy()
            of = jump(keys, shards)
            before = np.empty(len(n), dtype=np.int64)
            for s in np.unique(of).tolist():
                at = np.flatnonzero(of == s)
                ends = met[s] + np.cumsum(n[at])
                before[at], met[s] = ends - n[at], ends[-1]
            cols = [np.full(len(n), part, np.int32), *b.columns[:3], of, jump(keys, shards + 1), b.column(4), before]
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names=[c.split()[0] for c in ROWS.split(", ")])

    order = ["doc_id", "hash", "size", "text_crc32", "chunk"]
    dealt = chunks.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    rows = table(dealt.select("doc_id", "size", "text_crc32", key(F.col("doc_id")).alias("key"), "n").mapInArrow(number, ROWS), "slots")
    counts = rows.groupBy("part", "shard").agg(F.sum("n").alias("all"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task and shard, not each document
    base = counts.select("part", "shard", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    placed = rows.join(base, ["part", "shard"]).withColumn("slot", F.col("base") + F.col("before"))
    out = ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
    # copies of one document are many rows in one task: they are dealt again, some at a time
    again = placed.where("n > 1").repartition(partitions(docs), "shard", "slot")
    each = again.withColumn("slot", F.explode(F.sequence("slot", F.col("slot") + F.col("n") - 1)))
    return placed.where("n = 1").select(*out).unionByName(each.select(*out))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return slots(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
