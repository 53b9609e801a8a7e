"""Document fingerprints that tell how versions of a text differ: invertible Bloom lookup sketches.

A paragraph is a run of words of a line that ends with the line, a sentence, or a word whose hash says so (so that long lines
are divided too, and an insertion moves no later end). The set of a text's paragraph digests is hashed into cells of (count,
digests xored, checks xored), three cells a digest. Subtracting two sketches leaves the digests that differ; cells with one of them are
peeled off until none is left. A printed fingerprint holds all cells, so two of them tell by themselves how their texts differ
(``differences``). If peeling gets stuck, both texts' digests are hashed anew into twice the cells.

Likeness is the Jaccard similarity of the digest sets, from the numbers of digests and of those peeled. Texts without words have
no digests; two such are alike (1.0). Null counts as empty. Rows that repeat a doc_id follow one another, the greater text first. A null
doc_id is the last one. A lone document's next one is itself. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions

CELLS = 30
TIMES = 3
#: Beyond this many times the digests, sets are compared directly (peeling gets there by bad luck alone).
PATIENCE = 64
#: Bytes of text at a time (a longer text is alone): its words, copies and digests take many times as much.
TEXT_BYTES = 2 << 20
NULL = -(2**63)
ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?"]] = True


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paragraph digests of each row, and where each row's begin."""
    data, offs = K.text_bytes(column)
    start, end, first = K.word_spans(data, offs, K.SPACE)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    words = K.span_hashes(data, start, end)
    lines = np.searchsorted(np.flatnonzero(data == 10), start)
    last = STOPS[data[end - 1]] | (words % np.uint64(16) == 0)
    last[:-1] |= lines[1:] != lines[:-1]
    last[first[1:][first[1:] > 0] - 1] = True
    to = np.flatnonzero(last) + 1
    fro = np.concatenate([[0], to[:-1]])
    out = np.empty(len(to), dtype=np.uint64)
    i = 0
    while i < len(to):
        j = max(i + 1, int(np.searchsorted(to, fro[i] + K.BLOCK, side="right")))
        a = int(fro[i])
        out[i:j] = K.Hashes(words[a : to[j - 1]]).spans(fro[i:j] - a, to[i:j] - a)
        i = j
    row = np.searchsorted(first, fro, side="right") - 1
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    return out[keep], np.searchsorted(row[keep], np.arange(len(offs)))


def check(x: np.ndarray) -> np.ndarray:
    return K.mix(x + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)


def places(x: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third."""
    third = np.uint64(cells // TIMES)
    return np.stack(
        [(K.mix(x ^ np.uint64(cells * 7919 + i)) % third + np.uint64(i) * third).astype(np.int64) for i in range(TIMES)], axis=1
    )


class Sketches:
    """Sketches of many sets, or of the differences of many pairs of sets."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells = rows, cells
        self.count = np.zeros(rows * cells, dtype=np.int64)
        self.keys = np.zeros(rows * cells, dtype=np.uint64)
        self.checks = np.zeros(rows * cells, dtype=np.uint64)

    def add(self, row: np.ndarray, x: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        """Returns the cells."""
        at = (places(x, self.cells) + (row * self.cells)[:, None]).ravel()
        np.add.at(self.count, at, np.repeat(np.broadcast_to(np.asarray(sign, dtype=np.int64), x.shape), TIMES))
        np.bitwise_xor.at(self.keys, at, np.repeat(x, TIMES))
        np.bitwise_xor.at(self.checks, at, np.repeat(check(x), TIMES))
        return at

    def texts(self, sizes: np.ndarray) -> list[str]:
        """cells.size.base64 of all counts, keys and checks."""
        n = self.cells
        cells = (self.count.astype("<i4"), self.keys.astype("<u8"), self.checks.astype("<u4"))
        parts = np.concatenate([x.view(np.uint8).reshape(self.rows, -1) for x in cells], axis=1)
        return [f"{n}.{size}.{base64.b64encode(p.tobytes()).decode()}" for size, p in zip(sizes.tolist(), parts, strict=True)]

    @classmethod
    def parse(cls, texts: list[str]) -> tuple[Sketches, np.ndarray]:
        """Printed sketches of equally many cells, and their numbers of digests."""
        parts = [t.split(".", 2) for t in texts]
        if len({p[0] for p in parts}) > 1:
            raise ValueError("sketches of different sizes can't be subtracted")
        n = int(parts[0][0]) if parts else CELLS
        out = cls(len(texts), n)
        raw = np.frombuffer(b"".join(base64.b64decode(p[2]) for p in parts), dtype=np.uint8).reshape(len(texts), -1)
        fields = (raw[:, : 4 * n], "<i4", np.int64), (raw[:, 4 * n : 12 * n], "<u8", np.uint64), (raw[:, 12 * n :], "<u4", np.uint64)
        out.count, out.keys, out.checks = (np.ascontiguousarray(x).view(kind).astype(to).ravel() for x, kind, to in fields)
        return out, np.array([int(p[1]) for p in parts], dtype=np.int64)

    def minus(self, other: Sketches, mine: np.ndarray, others: np.ndarray) -> Sketches:
        """The differences of rows mine and the other's rows others."""
        out = Sketches(len(mine), self.cells)
        of = lambda s, x, rows: x.reshape(s.rows, -1)[rows].ravel()
        out.count = of(self, self.count, mine) - of(other, other.count, others)
        out.keys = of(self, self.keys, mine) ^ of(other, other.keys, others)
        out.checks = of(self, self.checks, mine) ^ of(other, other.checks, others)
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and sign (1: only the first set has it, -1: only the second) of what peels off, and of each row whether that is all."""
        rows, keys, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        at = np.arange(len(self.count))
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            at = at[self.checks[at] == check(self.keys[at])]
            if not len(at):
                break
            row, key, sign = at // self.cells, self.keys[at], self.count[at]
            _, one = np.unique(np.stack([row.astype(np.uint64), key]), axis=1, return_index=True)
            row, key, sign = row[one], key[one], sign[one]
            for held, x in ((rows, row), (keys, key), (signs, sign)):
                held.append(x)
            at = np.unique(self.add(row, key, -sign))
        clear = ((self.count == 0) & (self.keys == 0) & (self.checks == 0)).reshape(self.rows, -1).all(axis=1)
        return *(np.concatenate(x) for x in (rows, keys, signs)), clear


def sketched(x: np.ndarray, first: np.ndarray, cells: int = CELLS) -> Sketches:
    """A sketch of each row's digests."""
    s = Sketches(len(first) - 1, cells)
    s.add(np.repeat(np.arange(len(first) - 1), np.diff(first)), x, 1)
    return s


def differences(a: list[str], b: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray, np.ndarray]:
    """Of pairs of printed fingerprints: the digests that only the first and only the second text has, the likeness, and whether all
    were recovered (if not, the texts' digests have to be hashed into more cells, see ``likeness``)."""
    (one, nx), (two, ny) = Sketches.parse(a), Sketches.parse(b)
    every = np.arange(len(a))
    row, key, sign, clear = one.minus(two, every, every).peel()
    only = [[key[(row == r) & (sign == s)].tolist() for r in every] for s in (1, -1)]
    return *only, _likeness(nx, ny, row, sign), clear


def _likeness(nx: np.ndarray, ny: np.ndarray, row: np.ndarray, sign: np.ndarray) -> np.ndarray:
    mine, other = (np.bincount(row[sign == s], minlength=len(nx)) for s in (1, -1))
    union = nx + other
    return np.where(union > 0, (nx - mine) / np.maximum(union, 1), 1.0)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], difference: Sketches) -> np.ndarray:
    """Of each row of a (digests, where each row's begin) to the row of b, from the difference of their sketches; what doesn't peel is hashed anew."""
    (x, fx), (y, fy) = a, b
    nx, ny = np.diff(fx), np.diff(fy)
    row, _, sign, clear = difference.peel()
    out = _likeness(nx, ny, row, sign)
    left, cells = np.flatnonzero(~clear), difference.cells
    while len(left):
        cells *= 2
        tired = cells > PATIENCE * (nx[left] + ny[left] + CELLS)
        for r in left[tired]:
            both = len(np.intersect1d(x[fx[r] : fx[r + 1]], y[fy[r] : fy[r + 1]]))
            out[r] = both / (nx[r] + ny[r] - both)
        left, stuck = left[~tired], [np.zeros(0, np.int64)]
        step = max(1, (1 << 20) // cells)
        for i in range(0, len(left), step):
            rows = left[i : i + step]
            s, number = Sketches(len(rows), cells), np.arange(len(rows))
            s.add(np.repeat(number, nx[rows]), x[K.ranges(fx[rows], nx[rows])], 1)
            s.add(np.repeat(number, ny[rows]), y[K.ranges(fy[rows], ny[rows])], -1)
            row, _, sign, clear = s.peel()
            out[rows] = _likeness(nx[rows], ny[rows], row, sign)
            stuck.append(rows[~clear])
        left = np.concatenate(stuck)
    return out


def in_buckets(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """bucket, id, text: ranges of ids, found by binary search; equal ids share one."""
    cuts = sorted({float(x) for x in bounds})
    if not cuts:
        return rows.select(F.lit(0).alias("bucket"), "id", "text")
    find = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__id", outputCol="__bucket")
    return find.transform(rows.withColumn("__id", F.col("id").cast("double"))).select(
        F.col("__bucket").cast("int").alias("bucket"), "id", "text"
    )


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, id, text, extra, in partitions sorted so that each document's next one (descending id) is the next row.

    Buckets are ranges of ids; each ends with an extra row, the first of the next bucket."""
    tasks = partitions(docs)
    n = 4 * tasks  # so that tasks get about as many
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    bounds = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    rows = in_buckets(rows, bounds or [])
    heads = rows.groupBy("bucket").agg(F.max("id").alias("head"))  # a row for each bucket
    texts = rows.join(
        F.broadcast(heads.select(F.col("bucket").alias("of"), "head")), (F.col("id") == F.col("head")) & (F.col("bucket") == F.col("of"))
    ).groupBy("bucket", "id").agg(F.max("text").alias("text"))
    order = Window.orderBy("bucket")
    above = F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(order))
    ends = texts.select(above.alias("bucket"), "id", "text", F.lit(1).alias("extra"))
    every = rows.select("bucket", "id", "text", F.lit(0).alias("extra")).unionByName(ends)
    return every.repartition(tasks, "bucket").sortWithinPartitions(
        "bucket", "extra", F.desc("id"), F.desc("text")
    ).select("bucket", "id", "text", "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text: the last third replaced by the next document's beginning."""

    def rows(bucket: list, ids: list, texts: list, extra: list) -> pa.RecordBatch:
        """All rows but the last, each with the next one; extra rows only follow."""
        mine = [i for i in range(len(ids) - 1) if not extra[i]]
        edited = []
        for i in mine:
            k = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
        x, first = digests(pa.array(texts, pa.large_string()))
        y, edges = digests(pa.array(edited, pa.large_string()))

        def some(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = np.diff(first)[at]
            return x[K.ranges(first[:-1][at], size)], np.concatenate([[0], np.cumsum(size)])

        at = np.array(mine, dtype=np.int64)
        own, sizes = some(at), np.diff(first)
        every, changed = sketched(x, first), sketched(y, edges)
        prints = every.texts(sizes)
        near_edited = likeness(own, (y, edges), every.minus(changed, at, np.arange(len(at))))
        near_next = likeness(own, some(at + 1), every.minus(every, at, at + 1))
        cols = [
            pa.array([None if ids[i] == NULL else ids[i] for i in mine], pa.int64()),
            pa.array([len(texts[i]) for i in mine], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([prints[i] for i in mine], pa.string()),
            pa.array(changed.texts(np.diff(edges)), pa.string()),
            pa.array(near_edited),
            pa.array(near_next),
        ]
        return pa.record_batch(cols, names=[c.split()[0] for c in ROWS.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for b in K.small(batches, "text", TEXT_BYTES):
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                held = [[*h, *part.column(c).to_pylist()] for c, h in enumerate(held)]
                if len(held[0]) > 1:
                    if not all(held[3][:-1]):
                        yield rows(*held)
                    held = [h[-1:] for h in held]

    return with_next(docs).mapInArrow(scan, ROWS)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
