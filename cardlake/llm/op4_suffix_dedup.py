"""Suffix-array deduplication by a depth-limited radix sort.

Suffixes are ordered only through the threshold (100 bytes), by digits of eight bytes, most significant first. After each pass a
suffix that is alone in its group leaves the sort; the groups that are left after the last digit are exactly the repeated windows, and
all of a group's members but the first go.

A record for each suffix would be some thirty times the input. So most suffixes are first told apart, or known as copies, in runs of
neighbours that share their rarest gram (see ``repeats``): by 64-bit hashes of the gram and of the run's whole content, two digits
of a kind of their own. The suffixes of what is left, where passages begin, end or were edited, are ordered by their bytes here. They
come in pieces of up to eight neighbours, dealt by the bytes that all of a piece's suffixes share; pieces of a core with more than
GROUP of them are dealt by the bytes of each suffix instead, so that no core is one task's burden.

Nulls and empty texts: no bytes, nothing removed. Texts shorter than the threshold: nothing
removed. Rows of the same doc_id (or without one) and the same text count as one document; those of different texts are
documents of their own, in the order of xxhash64(text). A null doc_id counts as smaller than all others. Other columns pass through, whatever
their names, but those named like a result are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R

THRESHOLD = 100
GRAM = 24
BLOCK = 8
DIGIT = 8
#: Pieces of a core beyond which each suffix is dealt by itself.
GROUP = 2_000


def radix_groups(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, groups): those of data[start:] that equal another one through depth, in the order of their bytes, and their groups' numbers.

    Most significant digits first; each pass orders all groups at once, and the suffixes that are alone leave."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    digits = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    left, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for d in range(0, depth, DIGIT):
        digit = digits[start[left] + d].astype(np.uint64)
        if depth - d < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + d))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        more = np.bincount(group, minlength=1)[group] > 1 if len(group) else new
        left, group = left[more], group[more]
    return left, group


def radix_sort(pieces: DataFrame, n: int, depth: int = THRESHOLD, limit: int = GROUP) -> DataFrame:
    """Marks of the windows of open pieces that repeat."""
    large = pieces.groupBy("core").agg(F.count(F.lit(1)).alias("__of_core")).where(F.col("__of_core") > limit).select("core", F.lit(True).alias("__large"))
    every = pieces.join(large, "core", "left")
    # a suffix of a large core is a piece by itself, its core all of its bytes
    alone = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("n")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.col("n").alias("n")))
    cut = every.withColumn("p", F.explode(F.when(F.col("__large"), alone).otherwise(whole)))
    content = F.col("content").substr(F.col("p.i") + 1, F.col("p.n") - 1 + depth)
    cut = cut.select(
        F.when(F.col("__large"), F.xxhash64(content)).otherwise(F.col("core")).alias("core"),
        content.alias("content"),
        "doc",
        "tie",
        (F.col("start") + F.col("p.i")).alias("start"),
        F.col("p.n").alias("n"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in K.grouped(batches, ["core"], 1 << 16):
            data, offs = K.text_bytes(t.column("content"))
            doc, tie, first, size = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "tie", "start", "n"))
            row, at = np.repeat(np.arange(len(size)), size), K.ranges(offs[:-1], size)
            left, group = radix_groups(data, at, depth)
            row, at = row[left], at[left]
            doc, tie, start = doc[row], tie[row], first[row] + at - offs[row]
            order = np.lexsort((start, tie, doc, group))
            doc, tie, start, group = doc[order], tie[order], start[order], group[order]
            head = np.searchsorted(group, group, side="left")
            again = (doc != doc[head]) | (tie != tie[head]) | (start != start[head])
            yield R.as_marks(doc[again], tie[again], start[again])

    return cut.repartition(n, "core").sortWithinPartitions("core").mapInArrow(scan, R.MARKS)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, group: int = GROUP, *, texts: bool = True) -> DataFrame:
    """All columns of docs, and n_bytes, n_removed, n_spans, kept_sha256 and (if texts) kept.

    kept is what is left, without the partial characters that a cut leaves."""
    own = [c for c in docs.columns if c != "text"]
    rows = R.marked(R.keyed(docs), R.byte_elements, threshold, gram, BLOCK, lambda x, n: radix_sort(x, n, threshold, group))
    fields = [f"__{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches):
            data, offs = K.text_bytes(b.column("text"))
            keep = R.kept_elements(b, offs, threshold)
            gone = ~keep
            edge = gone.copy()
            edge[1:] &= keep[:-1]
            cut = offs[:-1][(offs[:-1] < len(gone))]
            edge[cut] = gone[cut]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offs])
            left = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offs]
            kept = data[keep].tobytes()
            parts = [kept[i:j] for i, j in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            cols = [
                np.diff(offs),
                total(gone),
                total(edge),
                [hashlib.sha256(x).hexdigest() for x in parts],
                [x.decode("utf-8", "ignore") if texts else None for x in parts],
            ]
            yield pa.record_batch(
                [
                    *(b.column(f"__own_{i}") for i in range(len(own))),
                    *(pa.array(c, kind) for c, kind in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)),
                ],
                names=[*(f"__own_{i}" for i in range(len(own))), *fields],
            )

    named = rows.select("text", *R.PASSES, *(f"__own_{i}" for i in range(len(own))))
    schema = named.select(*(f"__own_{i}" for i in range(len(own)))).schema
    for name, kind in zip(fields, ["long", "long", "long", "string", "string"], strict=True):
        schema = schema.add(name, kind)
    out = named.mapInArrow(scan, schema)
    new = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"}
    return out.select(
        *(F.col(f"__own_{i}").alias(c) for i, c in enumerate(own) if c not in new),
        *(F.col(f).alias(f[2:]) for f in fields if texts or f != "__kept"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
