"""Candidates for repeated windows of fixed length: the groundwork of operators 4 and 6.

A window is T consecutive elements (bytes, or words) of one document. A record for each window would be some thirty times
the input, so most are told apart, or known as copies, many at a time. Every window is named by its rarest gram: of its grams
of k elements the one with the smallest hash (an arbitrary but fixed order), leftmost on ties. Equal windows have that gram at the
same offset, so windows next to each other that share it travel as one *run*: about one record for (T-k+2)/2 windows.

1. ``runs``: each Arrow batch emits its runs as (gram, whole content). Of runs with equal content
   only the batch's first competes; the later ones are copies there and then, so that a passage
   held by a third of all documents sends one record a batch, not one a document.
2. The competing runs are dealt by gram and sorted by (gram, content, document, place): all but a
   content's first are copies. The windows of a gram with a single content leave: nothing equals them.
3. The first runs of grams that have several contents (where passages begin, end or were edited) are cut into pieces of a
   few windows, named by what all windows of the piece share, and compared the same way.

What is still open then goes to the operator: it orders the pieces' windows by their elements.

A document is a (doc_id, text): KEY holds doc_id, TIE a hash of the text, and the order of documents is by both, a null doc_id
first. So rows that share a doc_id, or have none, but differ in their texts are documents of their own, and equal rows are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import partitions

KEY = "__key"
TIE = "__tie"
PASSES = ("__runs", "__pieces", "__windows")
RUNS = "gram long, content long, doc long, tie long, start long, size int, off int, settled boolean"
MARKS = "doc long, tie long, start long, size int, off int, open boolean"
MARK = ("start", "size", "off", "open")
OPEN = "core long, content binary, doc long, tie long, start long, n int"
LOW = np.uint64((1 << 20) - 1)

#: From a batch's text column to the hash values of its elements and each document's first element.
Elements = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def byte_elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.text_bytes(column)
    return data, offs


def word_elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.text_bytes(column)
    start, end, first = K.word_spans(data, offs, K.SPACE)
    return K.span_hashes(data, start, end), first


def window_runs(elements: np.ndarray, offs: np.ndarray, t: int, k: int) -> tuple[np.ndarray, ...]:
    """Start, number of windows, gram, content hash and the gram's offset of each run; places count from the batch's start."""
    out = []
    n = len(elements) - t + 1
    for a in range(0, max(n, 0), K.BLOCK):
        m = min(K.BLOCK, n - a)
        h = K.Hashes(elements[a : a + m + t - 1])
        gram = h.grams(k)
        owner = (K.sliding_min((gram & ~LOW) | np.arange(len(gram), dtype=np.uint64), t - k + 1) & LOW).astype(np.int64)
        ok = np.ones(m, dtype=bool)
        ends = offs[np.searchsorted(offs, a, side="right") : np.searchsorted(offs, a + m + t, side="left")] - a
        bad = (ends[:, None] - np.arange(1, t)).ravel()
        ok[bad[(bad >= 0) & (bad < m)]] = False
        new = np.ones(m, dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], m)
        start, end = start[ok[start]], end[ok[start]]
        p = owner[start]
        content = K.mix(
            h.spans(start, end - 1 + t) + (p - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (end - start).astype(np.uint64)
        )
        out.append((start + a, end - start, gram[p], content, p - start))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _later(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows whose keys equal those of a row of a smaller (doc, tie, start)."""
    order = np.lexsort((start, tie, doc, *keys[::-1]))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for x in keys:
        same[1:] &= x[order][1:] == x[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.any([x[order] != x[order][head] for x in (doc, tie, start)], axis=0)
    out = np.zeros(len(order), dtype=bool)
    out[order] = later
    return out


def runs(docs: DataFrame, elements: Elements, t: int, k: int) -> DataFrame:
    """docs has KEY, TIE and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches, size=16 << 20):
            ids, ties = _documents(b)
            x, offs = elements(b.column("text"))
            start, size, gram, content, off = window_runs(x, offs, t, k)
            if not len(start):
                continue
            row = np.searchsorted(offs, start, side="right") - 1
            doc, tie, place = ids[row], ties[row], start - offs[row]
            settled = _later([gram, content], doc, tie, place)
            gram[settled] = content[settled] = 0  # nothing is compared with them any more
            yield pa.record_batch(
                [K.signed(gram), K.signed(content), doc, tie, place, size.astype(np.int32), off.astype(np.int32), settled],
                schema=_schema(RUNS),
            )

    return docs.select(KEY, TIE, "text").mapInArrow(scan, RUNS)


def _documents(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (KEY, TIE))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], settle: Callable) -> Iterator[pa.RecordBatch]:
    """Feeds rows sorted by keys, doc, tie and start to settle(columns, later, first): only the last content's first row is carried over."""
    carry: dict[str, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        extra = 0
        if carry is not None:
            extra = 1
            x = {c: np.concatenate([carry[c], v]) for c, v in x.items()}
        n = len(x["doc"])
        same = np.ones(n, dtype=bool)
        same[0] = False
        for c in keys:
            same[1:] &= x[c][1:] == x[c][:-1]
        same &= ~x["settled"]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        later = same & np.any([x[c] != x[c][head] for c in ("doc", "tie", "start")], axis=0)
        at = int(head[-1])
        out = settle(x, later, ~same & ~x["settled"], extra)
        carry = {c: v[at : at + 1] for c, v in x.items()}
        if out is not None:
            yield out
    K.give_back()


def settle_runs(dealt: DataFrame, n: int) -> DataFrame:
    """Runs that repeat (open false), and the first runs of grams that have several contents (open true)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def settle(x: dict[str, np.ndarray], later: np.ndarray, first: np.ndarray, extra: int) -> pa.RecordBatch:
            # A first run is opened when a neighbouring first run has its gram; the carried one may
            # have been opened for the one before it.
            at = np.flatnonzero(first)
            gram = x["gram"][at]
            like = np.zeros(len(at), dtype=bool)
            twins = gram[1:] == gram[:-1]
            like[1:] |= twins
            like[:-1] |= twins
            if extra and len(at) and at[0] == 0:
                if seen.get("opened"):
                    like[0] = False  # told already
                seen["opened"] = bool(seen.get("opened")) or bool(like[0])
            last_opened = bool(len(at)) and bool(like[-1] or (len(at) == 1 and seen.get("opened")))
            if len(at) > 1 or not extra:
                seen["opened"] = last_opened
            opened = np.zeros(len(first), dtype=bool)
            opened[at[like]] = True
            mine = later | x["settled"]
            mine[:extra] = False
            pick = np.flatnonzero(mine | opened)
            return pa.record_batch(
                [
                    x["doc"][pick],
                    x["tie"][pick],
                    x["start"][pick],
                    x["size"][pick].astype(np.int32),
                    x["off"][pick].astype(np.int32),
                    opened[pick],
                ],
                schema=_schema(MARKS),
            )

        yield from _sorted_groups(batches, ["gram", "content"], settle)

    deal = F.when(F.col("settled"), F.xxhash64("doc", "tie")).otherwise(F.col("gram"))
    dealt = dealt.repartition(n, deal).sortWithinPartitions("settled", "gram", "content", "doc", "tie", "start")
    return dealt.select("gram", "content", "doc", "tie", "start", "size", "off", "settled").mapInArrow(scan, MARKS)


def by_document(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc", "tie").agg(F.collect_list(F.struct(*MARK)).alias("marks"))


def _marked(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row number of each element of a list-of-structs column, and the elements' fields."""
    col = b.column(name)
    sizes = np.nan_to_num(np.asarray(col.value_lengths().to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    flat = col.flatten()
    return np.repeat(np.arange(b.num_rows), sizes), {f: flat.field(f).to_numpy(zero_copy_only=False) for f in MARK}


def _opened(b: pa.RecordBatch, offs: np.ndarray, column: str, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document's row, start, size and gram offset of each opened run of a batch."""
    row, m = _marked(b, column)
    pick = m["open"].astype(bool)
    row, start, size, off = (x[pick].astype(np.int64) for x in (row, m["start"], m["size"], m["off"]))
    if not ((start >= 0) & (start + size - 1 + t <= np.diff(offs)[row])).all():
        raise ValueError("a run doesn't fit its text")
    return row, start, size, off


def open_blocks(docs: DataFrame, marks: DataFrame, elements: Elements, t: int, block: int) -> DataFrame:
    """Opened runs cut into pieces of up to block windows, at fixed offsets from the gram.

    A piece's gram is its core, what all windows of that place share (t-block+1 elements); off is where the core begins."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches, size=8 << 20):
            ids, ties = _documents(b)
            x, offs = elements(b.column("text"))
            row, start, size, off = _opened(b, offs, "marks", t)
            if not len(row):
                continue
            top = off // block
            count = top - (off - size + 1) // block + 1
            of = np.repeat(np.arange(len(row)), count)
            j = K.ranges(np.zeros(len(row), np.int64), count)
            j = top[of] - j
            high = np.minimum(off[of], block * j + block - 1)
            low = np.maximum((off - size + 1)[of], block * j)
            first, n = start[of] + off[of] - high, high - low + 1
            p = start[of] + off[of] - block * j + offs[row][of]
            core = K.mix(_spans(x, p, p - block + 1 + t) + j.astype(np.uint64))
            at = first + offs[row][of]
            content = K.mix(_spans(x, at, at + n - 1 + t) + (high * 1000003 + n).astype(np.uint64))
            doc, tie = ids[row][of], ties[row][of]
            settled = _later([core, content], doc, tie, first)
            core[settled] = content[settled] = 0
            yield pa.record_batch(
                [K.signed(core), K.signed(content), doc, tie, first, n.astype(np.int32), (p - at).astype(np.int32), settled],
                schema=_schema(RUNS),
            )

    return _with(docs, marks, "marks").mapInArrow(scan, RUNS)


def open_pieces(docs: DataFrame, marks: DataFrame, elements: Elements, t: int, block: int) -> DataFrame:
    """The pieces that are still open: the hash of the core, the elements of all n windows, and where they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.small(batches, size=8 << 20):
            ids, ties = _documents(b)
            x, offs = elements(b.column("text"))
            row, first, n, off = _opened(b, offs, "marks", t)
            if not len(row):
                continue
            at = first + offs[row]
            core = K.signed(_spans(x, at + off, at + off - block + 1 + t))
            raw, wide = x.astype(x.dtype.newbyteorder(">")).tobytes(), x.dtype.itemsize
            content = [raw[i * wide : (i + m - 1 + t) * wide] for i, m in zip(at.tolist(), n.tolist(), strict=True)]
            yield pa.record_batch(
                [core, pa.array(content, pa.binary()), ids[row], ties[row], first, n.astype(np.int32)], schema=_schema(OPEN)
            )

    return _with(docs, marks, "marks").mapInArrow(scan, OPEN)


def as_marks(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Single windows that repeat."""
    n = len(doc)
    return pa.record_batch([doc, tie, start, np.ones(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool)], schema=_schema(MARKS))


def _with(docs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """docs that have opened runs. All columns stay, so that each pass reads the same exchange of docs."""
    small = marks.where(F.exists("marks", lambda m: m["open"])).select("doc", "tie", F.col("marks").alias(name))
    return docs.join(small, (F.col(KEY) == F.col("doc")) & (F.col(TIE) == F.col("tie")))


def _spans(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short spans in any order."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], end[order]
    out = np.empty(len(s), dtype=np.uint64)
    i = 0
    while i < len(s):
        j = int(np.searchsorted(s, s[i] + K.BLOCK, side="left"))
        a = int(s[i])
        out[order[i:j]] = K.Hashes(x[a : int(e[i:j].max())]).spans(s[i:j] - a, e[i:j] - a)
        i = j
    return out


def kept_elements(b: pa.RecordBatch, offs: np.ndarray, t: int) -> np.ndarray:
    """Which of a batch's elements stay: the columns PASSES hold the repeated windows."""
    gone = np.zeros(int(offs[-1]), dtype=bool)
    for name in PASSES:
        row, m = _marked(b, name)
        if not len(row):
            continue
        pick = ~m["open"].astype(bool)
        row, start, size = row[pick], m["start"][pick].astype(np.int64), m["size"][pick].astype(np.int64)
        a = np.minimum(start, np.diff(offs)[row]) + offs[row]
        gone |= K.covered(a, np.minimum(a + size - 1 + t, offs[1:][row]), len(gone))
    return ~gone


def marked(docs: DataFrame, elements: Elements, t: int, k: int, block: int, order: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """docs (see ``keyed``) with the repeated windows' places in the columns PASSES.

    order takes the open pieces and the number of partitions, and gives those of their windows that repeat."""
    n = partitions(docs)
    runs_ = by_document(settle_runs(runs(docs, elements, t, k), n))
    blocks = by_document(settle_runs(open_blocks(docs, runs_, elements, t, block), n))
    windows = by_document(order(open_pieces(docs, blocks, elements, t, block), n))
    for name, marks in zip(PASSES, (runs_, blocks, windows), strict=True):
        own = marks.select(F.col("doc").alias("__doc"), F.col("tie").alias("__of"), F.col("marks").alias(name))
        docs = docs.join(own, (F.col(KEY) == F.col("__doc")) & (F.col(TIE) == F.col("__of")), "left").drop("__doc", "__of")
    return docs


def keyed(docs: DataFrame) -> DataFrame:
    """KEY, TIE, text, and the other columns under names that nothing clashes with (see ``own_columns``)."""
    own = [F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(x for x in docs.columns if x != "text")]
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias(KEY),
        F.xxhash64("text").alias(TIE),
        F.col("text").cast("string").alias("text"),
        *own,
    )
