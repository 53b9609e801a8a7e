"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of digits, lower-case letters and non-ASCII bytes after lower-casing. Each mask takes some of
the positions of a window of tokens and ignores the others, so a substitution at an ignored position leaves the
seed intact; every stretch that the limits below allow holds a seed whole. Seeds of the benchmark and of the documents are joined by hash; around each hit the two token
sequences are compared place by place on the hit's diagonal. A stretch of it with at least 12 matches and 80 % matches
is a leak, and so is a whole item of fewer than 15 tokens with 80 % matches. Reported is the stretch that scores best (a match
counts 1, a mismatch -2) if it is a leak, else the leak with the most matches. Of several places in a document that with the most
matches is reported, on ties the first, then the shorter one.

The benchmark's seeds go to all tasks while its text has at most BROADCAST_BYTES, which is checked (its arrays take some twenty
times that); beyond, seeds are joined by a shuffle, with the same result. Of the documents' seeds only those go there that a bitmap of the
benchmark's seeds has, whose size is fixed. Items of up to WHOLE tokens are found whole and unchanged, by a hash of all their tokens, at their
first place in a document; a caller for whom such short ones are too common to tell gives a greater min_item. Null and
empty texts, on either side, match nothing. Repeated documents are each reported, and so are documents without a doc_id. Items without
an item_id are ignored, repeated items are each reported. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions

#: Positions that count. Any stretch of 12 or more matches of which 80 % match, of whatever length, holds one of the first four; any item
#: of 5 to SEEDED - 1 tokens, whole and with 80 % matches, one of the LIGHT ones (tests show both for all patterns). Of fewer tokens all must match:
#: the last masks take items of 1 to WHOLE tokens whole.
MASKS = ("111111", "11101011", "101001111", "1100010111", "111", "11011", "1", "11", "111", "1111")
HEAVY, LIGHT, WHOLE = 4, 2, 4
SEEDED = 14
MIN_MATCHES = 12
SHARE = 0.8
BROADCAST_BYTES = 2 << 20
#: Bits of a seed that say which bit of the bitmap (16 MB) is its own.
BITS = 27
LEAKS = "doc_id long, text_hash long, item_id long, doc_start int, n_tokens int, n_matched int, share double"
_rng = np.random.default_rng(1)
FACTORS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    start, end, first = K.word_spans(data, offs, K.PLAIN)
    return K.span_hashes(data, start, end), first


def seeds(x: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at each place."""
    m = MASKS[mask]
    n = len(x) - len(m) + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, mask + 1, dtype=np.uint64)
    for i, c in enumerate(m):
        if c == "1":
            h += x[i : n + i] * FACTORS[i]
    return K.mix(h)


def item_masks(n: int, least: int = 1) -> range:
    """The masks that seed an item of n tokens."""
    if n < max(least, 1):
        return range(0)
    if n <= WHOLE:
        return range(HEAVY + LIGHT + n - 1, HEAVY + LIGHT + n)
    return range(HEAVY, HEAVY + LIGHT) if n < SEEDED else range(HEAVY)


def first_places(mask: int, row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the seeds, in the order of rows and places, say something new: of a whole item only its first place in a row."""
    if mask < HEAVY + LIGHT:
        return np.arange(len(h))
    order = np.lexsort((np.arange(len(h)), h, row))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return np.sort(order[new])


def item_seeds(x: np.ndarray, first: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place of the seeds of all rows."""
    out = []
    for r in range(len(first) - 1):
        one = x[first[r] : first[r + 1]]
        for m in item_masks(len(one), least):
            h = seeds(one, m)
            out.append((h, np.full(len(h), r), np.arange(len(h))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def stretch(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Start in the document, length and matches of the best leak of a diagonal, if there is one."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi <= lo:
        return None
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    gain = sums - np.minimum.accumulate(sums)
    end = int(np.argmax(gain))
    start = int(np.argmin(sums[: end + 1]))
    n, matched = end - start, int(same[start:end].sum())
    if n and matched >= min(MIN_MATCHES, len(item)) and matched >= SHARE * n:
        return lo + start + shift, n, matched
    total = np.concatenate([[0], np.cumsum(same)])
    if total[-1] >= MIN_MATCHES:
        # 80 % match between two places if 5 x matches - 4 x places is no less at the second: the first place of all that allow an end has the most matches
        sums = 5 * total - 4 * np.arange(len(total))
        starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
        end = int(np.argmax(total - total[starts]))
        start = int(starts[end])
        matched = int(total[end] - total[start])
        if matched >= MIN_MATCHES:
            inside = np.flatnonzero(same[start:end])
            return lo + start + int(inside[0]) + shift, int(inside[-1] - inside[0]) + 1, matched
    if hi - lo == len(item) and total[-1] * 5 >= len(item) * 4:
        return lo + shift, len(item), int(total[-1])
    return None


def _leaks(hits: list[tuple[int, int, int]], doc_tokens, item_tokens, doc_id, item_id) -> list[tuple]:
    """The best leak of each (document, item) among hits (document, item, shift), in whatever order they come."""
    rank = lambda row: (-row[5], row[3], row[4])
    best: dict[tuple[int, int], tuple] = {}
    for d, i, shift in hits:
        item = item_tokens(i)
        if found := stretch(item, doc_tokens(d), shift):
            row = (*doc_id(d), item_id(i), *found, found[2] / len(item))
            if (d, i) not in best or rank(row) < rank(best[d, i]):
                best[d, i] = row
    return list(best.values())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return pa.record_batch(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in LEAKS.split(", ")]
    )


def _small_benchmark(docs: DataFrame, items: list, least: int) -> DataFrame:
    x, first = tokens(pa.array([r.text for r in items], pa.string()))
    ids = [r.item_id for r in items]
    hashes, rows, places = item_seeds(x, first, least)
    order = np.argsort(hashes, kind="stable")
    hashes, rows, places = hashes[order], rows[order], places[order]
    masks = sorted({m for n in np.diff(first).tolist() for m in item_masks(n, least)})
    bits = 20
    near = np.zeros(1 << bits, dtype=bool)
    near[hashes >> np.uint64(64 - bits)] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches, 1):
            doc, at = tokens(b.column(1))
            ids_, ties = b.column(0), b.column(2)
            found = [np.zeros((0, 3), np.int64)]
            for m in masks:
                h = seeds(doc, m)
                place = np.flatnonzero(near[h >> np.uint64(64 - bits)])
                row = np.searchsorted(at, place, side="right") - 1
                ok = place + len(MASKS[m]) <= at[row + 1]
                place, row = place[ok], row[ok]
                one = first_places(m, row, h[place])
                place, row = place[one], row[one]
                lo, hi = np.searchsorted(hashes, h[place], "left"), np.searchsorted(hashes, h[place], "right")
                seed, shift, row = K.ranges(lo, hi - lo), np.repeat(place - at[row], hi - lo), np.repeat(row, hi - lo)
                found.append(np.stack([row, rows[seed], shift - places[seed]], axis=1))
            hits = np.unique(np.concatenate(found), axis=0).tolist()
            out = _leaks(
                hits,
                lambda d: doc[at[d] : at[d + 1]],
                lambda i: x[first[i] : first[i + 1]],
                lambda d: (ids_[d].as_py(), ties[d].as_py()),
                lambda i: ids[i],
            )
            if out:
                yield _batch(out)

    return docs.mapInArrow(scan, LEAKS)


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Which values the first BITS bits of seeds have; 2 ** BITS bits, however many seeds there are."""
    top = F.shiftrightunsigned("seed", 64 - BITS)
    parts = seeds.groupBy(F.shiftright(top, 15).alias("part")).agg(
        F.bitmap_construct_agg(top.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits")
    )
    out = np.zeros((1 << (BITS - 15), 1 << 12), dtype=np.uint8)
    for r in parts.collect():  # 4096 rows of 4 kB at most
        out[r.part] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def _large_benchmark(docs: DataFrame, items: DataFrame, least: int) -> DataFrame:
    n = partitions(docs)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch(
                [pa.array(sorted({m for k in np.diff(tokens(b.column(1))[1]).tolist() for m in item_masks(k, least)}), pa.int32())],
                names=["mask"],
            )

    masks = sorted(r.mask for r in items.mapInArrow(used, "mask int").distinct().collect())

    def emit_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, row, place = item_seeds(*tokens(b.column(1)), least)
            yield pa.record_batch(
                [K.signed(h), b.column(0).take(pa.array(row)), b.column(2).take(pa.array(row)), place.astype(np.int32)],
                names=["seed", "item_id", "item_hash", "of"],
            )

    right = items.mapInArrow(emit_items, "seed long, item_id long, item_hash long, of int")
    known = seed_bitmap(right)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches, 1):
            x, at = tokens(b.column(1))
            for m in masks:
                h = seeds(x, m)
                bit = (h >> np.uint64(64 - BITS)).astype(np.int64)
                place = np.flatnonzero(known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                row = np.searchsorted(at, place, side="right") - 1
                ok = place + len(MASKS[m]) <= at[row + 1]
                place, row = place[ok], row[ok]
                one = first_places(m, row, h[place])
                place, row = place[one], row[one]
                yield pa.record_batch(
                    [
                        K.signed(h[place]),
                        b.column(0).take(pa.array(row)),
                        b.column(2).take(pa.array(row)),
                        (place - at[row]).astype(np.int32),
                    ],
                    names=["seed", "doc_id", "text_hash", "at"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, at), (y, of) = tokens(b.column("text")), tokens(b.column("item"))
            shifts = b.column("shifts").to_pylist()
            hits = [(r, r, s) for r in range(b.num_rows) for s in shifts[r]]
            whose = lambda d: (b.column("doc_id")[d].as_py(), b.column("text_hash")[d].as_py())  # noqa: B023, E731
            if out := _leaks(hits, lambda d: x[at[d] : at[d + 1]], lambda i: y[of[i] : of[i + 1]], whose, lambda i: b.column("item_id")[i].as_py()):
                yield _batch(out)

    left = docs.mapInArrow(emit, "seed long, doc_id long, text_hash long, at int")
    one, other = ["doc_id", "text_hash"], ["item_id", "item_hash"]
    hits = left.join(right, "seed").groupBy(*one, *other).agg(F.collect_set(F.col("at") - F.col("of")).alias("shifts"))
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "text")
    whole = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    whole = whole.join(items.withColumnRenamed("text", "item"), other).repartition(n, *one, *other)
    return whole.select("doc_id", "text_hash", "item_id", "shifts", "text", "item").mapInArrow(verify, LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, min_item: int = 1) -> DataFrame:
    """Items of fewer than min_item tokens aren't looked for. A row for each document and the benchmark item that it holds a passage of. text_hash tells documents of one doc_id, or none, apart."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long"), "text", F.xxhash64("text").alias("item_hash")
    )
    docs = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        return _small_benchmark(docs, items.collect(), min_item)
    return _large_benchmark(docs, items, min_item)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
